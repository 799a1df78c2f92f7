"""Prompt tables over questions derived from orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.catalog import inputs
from plenum.catalog.registry import query
from plenum.operators import prompts

inputs.SQL_INPUTS["qa"] = """
SELECT sample_index, sample_id, ['bbh', 'passage', 'choices', 'open'][1 + (custkey % 4)::INT] AS kind,
       ['BBH', 'boolq', 'mmlu', 'gsm8k'][1 + (custkey % 4)::INT] AS dataset,
       CASE custkey % 4 WHEN 2 THEN 'multiple_choice' WHEN 3 THEN 'math' ELSE 'yes_no' END AS task_type,
       'Which order is ' || sample_index AS question, CASE WHEN custkey % 4 = 1 THEN 'Passage of ' || subject ELSE '' END AS passage,
       CASE WHEN custkey % 4 = 2 THEN ['red', 'green ' || custkey, 'blue'] ELSE [] END AS choices,
       CASE WHEN sample_index % 2 = 0 THEN ['X', 'Y', 'Z'] ELSE ['A', 'B', 'C'] END AS shown_labels,
       ['', 'evidence', 'verification'][1 + (sample_index % 3)::INT] AS role_name,
       CASE WHEN sample_index % 3 = 0 THEN '' ELSE 'Act with ' || ['', 'evidence', 'verification'][1 + (sample_index % 3)::INT] END AS actor_instruction,
       CASE WHEN sample_index % 3 = 0 THEN '' ELSE 'Review with ' || ['', 'evidence', 'verification'][1 + (sample_index % 3)::INT] END AS critic_instruction,
       'Previous answer ' || gold AS response, CASE WHEN custkey % 5 = 0 THEN ' ' ELSE 'Feedback ' || subject END AS feedback, gold AS target
FROM samples"""

ROLE_NAMES = ("", "evidence", "verification")


def qa(spark, d):
    index, cust = F.col("sample_index"), F.col("custkey")

    def pick(values, at):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))

    role = pick(ROLE_NAMES, index % 3)
    none = F.expr("cast(array() as array<string>)")
    return inputs.samples(spark, d).select(
        "sample_index", "sample_id",
        pick(("BBH", "boolq", "mmlu", "gsm8k"), cust % 4).alias("dataset"),
        pick(("yes_no", "yes_no", "multiple_choice", "math"), cust % 4).alias("task_type"),
        F.concat(F.lit("  Which order is "), index.cast("string"), F.lit("\n")).alias("question"),
        F.when(cust % 4 == 1, F.concat(F.lit("Passage of "), "subject", F.lit(" "))).alias("passage"),
        F.when(cust % 4 == 2, F.array(F.lit("red"), F.concat(F.lit("green "), cust.cast("string")), F.lit("blue"))).otherwise(none).alias("choices"),
        F.when((cust % 4 == 2) & (index % 2 == 0), F.array(F.lit("X"), F.lit("Y"), F.lit("Z"))).alias("choice_labels"),
        role.alias("role_name"),
        F.when(index % 3 > 0, F.concat(F.lit("Act with "), role)).otherwise("").alias("actor_instruction"),
        F.when(index % 3 > 0, F.concat(F.lit("Review with "), role)).alias("critic_instruction"),
        F.concat(F.lit("Previous answer "), "gold").alias("response"),
        F.when(cust % 5 == 0, " ").otherwise(F.concat(F.lit("Feedback "), "subject")).alias("feedback"),
        F.col("gold").alias("target"),
    )


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_fill(template: str, **names: str) -> str:
    names = {"question": "question", "passage": "passage", "response": "response", "feedback": "feedback", "target": "target", "options": OPTIONS_SQL, **names}
    return " || ".join(f"({names[p]})" if kind == "name" else quote(p) for kind, p in prompts.parts_of(template))


OPTIONS_SQL = "shown_labels[1] || ': red' || chr(10) || shown_labels[2] || ': ' || choices[2] || chr(10) || shown_labels[3] || ': blue'"


def sql_prompt(templates: dict[str, str], agent: str) -> str:
    prefix = f"CASE WHEN {agent}_instruction = '' THEN '' ELSE {sql_fill(prompts.ROLE_PREFIX, role='role_name', instruction=f'{agent}_instruction')} END"
    body = " ".join(f"WHEN '{k}' THEN {sql_fill(t)}" for k, t in templates.items())
    return f"{prefix} || CASE kind {body} END"


def compact(df, keys=("sample_index",), **columns):
    """Length and md5 of each prompt: whole texts are compared by hash."""
    out = []
    for name, column in columns.items():
        out += [F.length(column).cast("bigint").alias(f"{name}_size"), F.md5(column).alias(name)]
    return df.select(*keys, *out)


def sql_compact(source: str, keys: str = "sample_index", **columns: str) -> str:
    out = ", ".join(f"length({c}) AS {n}_size, md5({c}) AS {n}" for n, c in columns.items())
    return f"SELECT {keys}, {out} FROM {source}"


@query(
    "render_actor_prompts",
    sql_compact(
        "qa", initial=sql_prompt(prompts.ACTOR_INITIAL, "actor"), guided=sql_prompt(prompts.ACTOR_INITIAL_GUIDED, "actor"),
        revision=sql_prompt(prompts.ACTOR_REVISION, "actor"), guided_revision=sql_prompt(prompts.ACTOR_REVISION_GUIDED, "actor"),
    ),
)
def render_actor_prompts(spark, d):
    response, feedback, target = F.col("response"), F.col("feedback"), F.col("target")
    return compact(
        qa(spark, d), initial=prompts.actor_prompt(), guided=prompts.actor_prompt(target=target),
        revision=prompts.actor_prompt(response, feedback), guided_revision=prompts.actor_prompt(response, feedback, target),
    )


@query(
    "render_critic_prompts",
    sql_compact("qa", critic=sql_prompt(prompts.CRITIC, "critic"), guided=sql_prompt(prompts.CRITIC_GUIDED, "critic")),
)
def render_critic_prompts(spark, d):
    response = F.col("response")
    return compact(qa(spark, d), critic=prompts.critic_prompt(response), guided=prompts.critic_prompt(response, F.col("target")))


PROBLEM_SQL = (
    "CASE WHEN kind = 'open' THEN 'Problem:' ELSE 'Question:' END || chr(10) || question || CASE WHEN passage <> '' THEN chr(10) || chr(10) || 'Passage:' || chr(10) || passage ELSE '' END"
    " || CASE WHEN kind = 'choices' THEN chr(10) || chr(10) || 'Options:' || chr(10) || '(A) red' || chr(10) || '(B) ' || choices[2] || chr(10) || '(C) blue' ELSE '' END"
)
ANSWERS_SQL = """
SELECT q.*, round, a0, a1, a2, a3 FROM qa q JOIN (
  SELECT sample_index, round + 1 AS round, max(tail_text) FILTER (WHERE role_idx = 0) AS a0, max(tail_text) FILTER (WHERE role_idx = 1) AS a1,
         max(tail_text) FILTER (WHERE role_idx = 2) AS a2, max(tail_text) FILTER (WHERE role_idx = 3) AS a3
  FROM agent_completions WHERE round < 4 GROUP BY ALL) USING (sample_index)"""
PEER_SQL = sql_fill(
    prompts.PEER_HEAD,
    kind="CASE kind WHEN 'choices' THEN 'multiple choice' WHEN 'open' THEN 'question-answering' ELSE 'yes-no' END",
    responses="'Person 0 said: ' || a0 || chr(10) || 'Person 1 said: ' || a1 || chr(10) || 'Person 2 said: ' || a2 || chr(10) || 'Person 3 said: ' || a3",
) + (
    f" || CASE kind WHEN 'choices' THEN {quote(prompts.PEER_TASK['multiple choice'])} WHEN 'open' THEN {quote(prompts.PEER_TASK['question-answering'])} ELSE {quote(prompts.PEER_TASK['yes-no'])} END"
    " || chr(10) || 'Question: ' || question || CASE WHEN passage <> '' THEN chr(10) || 'Passage: ' || passage ELSE '' END"
    f" || CASE WHEN kind = 'choices' THEN chr(10) || 'Options:' || chr(10) || {OPTIONS_SQL} ELSE '' END"
)
SUMMARY_SQL = sql_fill(
    prompts.PEER_SUMMARY, target="'direct'", problem=PROBLEM_SQL,
    peers="'evidence response:' || chr(10) || a1 || chr(10) || chr(10) || 'elimination response:' || chr(10) || a2",
)
JUDGE_SQL = sql_fill(
    prompts.JUDGE, problem=PROBLEM_SQL,
    candidates="'direct final-round response:' || chr(10) || a0 || chr(10) || 'evidence final-round response:' || chr(10) || a1",
)


def with_answers(spark, d):
    """Questions with the responses of the round before, for every round from the second on."""
    rows = inputs.completions(spark, d, inputs.AGENTS, rounds=4).select(
        "sample_index", (F.col("round") + 1).alias("round"), F.col("role_idx").alias("agent"), F.col("tail_text").alias("response")
    )
    return qa(spark, d).join(prompts.responses_wide(rows, ["sample_index", "round"], 4).hint("merge"), "sample_index")


@query(
    "render_peer_prompts",
    sql_compact(f"({ANSWERS_SQL})", "sample_index, round", peer=PEER_SQL, summary=SUMMARY_SQL, alone=sql_fill(prompts.PEER_SUMMARY, target="'direct'", problem=PROBLEM_SQL, peers=quote(prompts.NO_PEERS)), judge=JUDGE_SQL),
)
def render_peer_prompts(spark, d):
    a = [F.col(f"response_{i}") for i in range(4)]
    return compact(
        with_answers(spark, d), ("sample_index", "round"), peer=prompts.peer_debate_prompt(a),
        summary=prompts.summary_prompt("direct", {"direct": a[0], "evidence": a[1], "elimination": a[2]}),
        alone=prompts.summary_prompt("direct", {"direct": a[0]}),
        judge=prompts.judge_prompt({"direct": a[0], "evidence": a[1]}),
    )


V1_ROLE_SQL = "CASE sample_index % 3 " + " ".join(f"WHEN {i} THEN {quote(t)}" for i, t in enumerate(prompts.V1_ROLES.values())) + " END"
V1_NAME_SQL = "['direct', 'evidence', 'elimination'][1 + (sample_index % 3)::INT]"
FEEDBACK_SQL = f"CASE WHEN trim(feedback) = '' THEN {quote(prompts.V1_NO_FEEDBACK)} ELSE feedback END"
SUMMARIZED_SQL = f"CASE WHEN trim(feedback) = '' THEN {quote(prompts.V1_NO_SUMMARY)} ELSE feedback END"
V1 = {"role": V1_ROLE_SQL, "problem": PROBLEM_SQL, "feedback": FEEDBACK_SQL}
V1C = {"critic": f"'critic_' || {V1_NAME_SQL}", "actor": V1_NAME_SQL, "problem": PROBLEM_SQL, "summary": SUMMARIZED_SQL}


@query(
    "render_role_prompts_v1",
    sql_compact(
        "qa", actor=f"CASE WHEN sample_index % 4 = 0 THEN {sql_fill(prompts.V1_INITIAL, **V1)} ELSE {sql_fill(prompts.V1_REVISION, **V1)} END",
        guided=sql_fill(prompts.V1_REVISION_GUIDED, **V1), critic=sql_fill(prompts.V1_CRITIC, **V1C), guided_critic=sql_fill(prompts.V1_CRITIC_GUIDED, **V1C),
    ),
)
def render_role_prompts_v1(spark, d):
    names = F.array(*[F.lit(n) for n in prompts.V1_ROLES])
    actor = F.element_at(names, (F.col("sample_index") % 3 + 1).cast("int"))
    response, feedback, target = F.col("response"), F.col("feedback"), F.col("target")
    earlier = F.when(F.col("sample_index") % 4 == 0, "").otherwise(response)
    return compact(
        qa(spark, d), actor=prompts.v1_actor_prompt(actor, earlier, feedback),
        guided=prompts.v1_actor_prompt(actor, response, feedback, target),
        critic=prompts.v1_critic_prompt(actor, response, feedback),
        guided_critic=prompts.v1_critic_prompt(actor, response, feedback, target),
    )


TYPES = ("mistral-7b", "Mistral-v0.3", "gemma2-2b", "qwen2.5-3b", "qwen3", "phi-4-mini", "llama3")
FAMILIES = ("mistral", "mistral_v03", "gemma2", "qwen25", "qwen3", "phi4", "raw")
TYPE_SQL = "[" + ", ".join(quote(t) for t in TYPES) + "][1 + (conv_id % 7)::INT]"
FAMILY_SQL = "[" + ", ".join(quote(t) for t in FAMILIES) + "][1 + (conv_id % 7)::INT]"
TRIMMED = f"trim(text, {inputs.SQL_BLANKS})"


@query(
    "render_chat_format",
    f"""SELECT conv_id, turn, family, md5(CASE family WHEN 'raw' THEN text WHEN 'mistral' THEN CASE WHEN turn % 2 = 1 THEN '[INST] done [/INST]' ELSE '[INST] ' || {TRIMMED} || ' [/INST]' END
              WHEN 'mistral_v03' THEN '<u>' || text || '</u>' ELSE '<u>' || {TRIMMED} || '</u>' END) AS prompt,
              md5(CASE WHEN family = 'mistral_v03' THEN ' ' || {TRIMMED} ELSE text END) AS completion
        FROM (SELECT *, {FAMILY_SQL} AS family FROM conversations)""",
)
def render_chat_format(spark, d):
    rows = inputs.table(spark, d, "conversations")
    model = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("conv_id") % 7 + 1).cast("int"))
    family = F.col("family")
    wrapped = F.when((family == "mistral") & (F.col("turn") % 2 == 1), " [INST] done [/INST] ").otherwise(F.col("text"))
    return rows.withColumn("family", prompts.chat_family(model)).select(
        "conv_id", "turn", "family",
        F.md5(prompts.chat_prompt(wrapped, family, F.lit("<u>"), F.lit("</u>"))).alias("prompt"),
        F.md5(prompts.chat_completion(F.col("text"), family)).alias("completion"),
    )


@query(
    "trim_middle",
    f"""SELECT doc_id, len(t)::INT AS tokens, md5(CASE WHEN len(t) <= cap THEN text WHEN cap <= 3 THEN array_to_string(t[len(t) - cap + 1:], ' ')
               ELSE array_to_string(t[1:(cap - 3) // 2], ' ') || chr(10) || '...[truncated ' || (len(t) - cap) || ' tokens]...' || chr(10) || array_to_string(t[len(t) - (cap - 3 - (cap - 3) // 2) + 1:], ' ') END) AS trimmed
        FROM (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 40 ELSE 101 END AS cap, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS t FROM documents)""",
)
def trim_middle(spark, d):
    cap = F.when(F.col("doc_id") % 3 == 0, 3).when(F.col("doc_id") % 3 == 1, 40).otherwise(101)
    return inputs.table(spark, d, "documents").select(
        "doc_id", F.size(prompts.tokens_of(F.col("text"))).alias("tokens"), F.md5(prompts.trim_middle(F.col("text"), cap)).alias("trimmed")
    )


SPECIAL = [("original", "", ""), ("evidence", "Use evidence", "Check evidence"), ("verification", "Verify", "Check steps")]


@query(
    "specialize_roles",
    """SELECT sample_id, role_name, actor_instruction, critic_instruction, 'acccollab_iclr2025_appendix_c_mmlu_v2' || CASE WHEN role_name = '' THEN '' ELSE '+acccollab_role_prefix_v1:' || role_name END AS prompt_version
       FROM samples CROSS JOIN (VALUES ('', '', ''), ('evidence', 'Use evidence', 'Check evidence'), ('verification', 'Verify', 'Check steps')) r(role_name, actor_instruction, critic_instruction)""",
)
def specialize_roles(spark, d):
    return prompts.specialize(inputs.samples(spark, d).select("sample_id"), SPECIAL)


def debate_rounds(spark, d):
    """Prompts of round t from the answers of round t-1, one role never seeing
    another's text: rounds are self-joined on (sample, role, round - 1).

    Merge joins, as sizes guessed before the grid is expanded would broadcast it.
    Answers and questions are dealt out by the sample, and all joins are by it alone, so
    that none shuffles or sorts the grid by more: role and round are compared beside
    the key, among the few answers of a sample, in a form that is no key of the join.
    """
    answers = inputs.completions(spark, d).select("sample_index", "role", "round", "tail_text")
    previous = answers.select(
        "sample_index", F.col("role").alias("__role"), (F.col("round") + 1).alias("__round"), F.col("tail_text").alias("response")
    )
    same = F.col("role").between(F.col("__role"), F.col("__role")) & F.col("round").between(F.col("__round"), F.col("__round"))
    rows = answers.select("sample_index", "role", "round").alias("a").join(
        previous.alias("p").hint("merge"), (F.col("a.sample_index") == F.col("p.sample_index")) & same, "left"
    ).select("a.sample_index", "role", "round", "response")
    known = qa(spark, d).drop("response").join(rows.hint("merge"), "sample_index")
    told = F.concat(F.lit("Feedback of "), "role")
    prompt = F.when(F.col("round") == 0, prompts.actor_prompt()).otherwise(prompts.actor_prompt(F.col("response"), told))
    return known.select("sample_index", "role", "round", prompt.alias("prompt"))


DEBATE_SQL = f"""
SELECT sample_index, role, round, length(prompt) AS size, md5(prompt) AS prompt
FROM (SELECT sample_index, role, round, CASE WHEN round = 0 THEN {sql_prompt(prompts.ACTOR_INITIAL, 'actor')} ELSE {sql_prompt(prompts.ACTOR_REVISION, 'actor')} END AS prompt
      FROM (SELECT q.* EXCLUDE (response, feedback), c.role, c.round, lag(c.tail_text) OVER (PARTITION BY c.sample_index, c.role ORDER BY c.round) AS response, 'Feedback of ' || c.role AS feedback
            FROM qa q JOIN completions c USING (sample_index)))"""


@query("job_debate_rounds", DEBATE_SQL)
def job_debate_rounds(spark, d):
    return debate_rounds(spark, d).select(
        "sample_index", "role", "round", F.length("prompt").cast("bigint").alias("size"), F.md5("prompt").alias("prompt")
    )


@query(
    "user_generator",
    "SELECT doc_id, 'Echo: ' || length(text) || ' ' || substr(text, 1, 5) AS raw_response FROM documents",
)
def user_generator(spark, d):
    from plenum.operators.generator import generate

    rows = inputs.table(spark, d, "documents").select("doc_id", F.col("text").alias("prompt"))
    return generate(rows, EchoGenerator()).select("doc_id", "raw_response")


class EchoGenerator:
    """A generator of the caller: prompts in, one text per prompt out."""

    def generate(self, prompts):
        return [f"Echo: {len(p)} {p[:5]}" for p in prompts]
