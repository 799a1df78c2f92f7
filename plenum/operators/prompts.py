"""Prompt tables: templates filled with columns.

A template is text with {names}.  It is cut at the names when the plan is
built, so values never get interpreted as template text.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.names import PROMPT_VERSION, ROLE_VERSION
from plenum.functions.targets import usable_labels
from plenum.functions.text import let, present, split_at, strip

# ---------------------------------------------------------------------------
# Fixed values (texts of the prompts)
# Kinds: bbh = yes/no without a passage, passage = yes/no with one,
# choices = multiple choice, open = free answer.
ROLE_PREFIX = "Role specialization ({role}): {instruction}\n\n"

ACTOR_INITIAL = {
    "bbh": (
        "You will be given a yes-no question. You should answer the question as "
        "accurately as possible. You should give an extremely brief justification "
        "for your answer, and you must provide a final answer of either Yes or No."
        "\nQuestion: {question}"
    ),
    "passage": (
        "You will be given a yes-no question which is based on a passage. "
        "You should use the passage to help you answer the question. "
        "You should give a brief justification for your answer, and you must provide "
        "a final answer of either Yes or No."
        "\nQuestion: {question}?\nPassage: {passage}"
    ),
    "choices": (
        "Please answer the following multiple choice question as accurately as possible. "
        "You must provide a extremely brief justification for your answer, and you must "
        'give your final answer as a letter by saying "Final Answer:".'
        "\nQuestion: {question},\nOptions:\n{options}"
    ),
    "open": (
        "Please answer the following question as accurately as possible. Give a brief "
        'justification and state your final answer by saying "Final Answer:".'
        "\nQuestion: {question}"
    ),
}
ACTOR_INITIAL_GUIDED = {
    "bbh": (
        "You will be given a yes-no question. You should answer the question with "
        "{target}. You should give an extremely brief justification for your answer "
        "of {target}, and you must state that your final answer is {target}."
        "\nQuestion: {question}"
    ),
    "passage": (
        "You will be given a yes-no question which is based on a passage. "
        "You should use the passage to help you answer the question "
        "with a {target}. You should give a brief justification for your answer of "
        "{target}, and you must state that your final answer is {target}."
        "\nQuestion: {question}?\nPassage: {passage}"
    ),
    "choices": (
        "Please answer the following multiple choice question with option {target}. "
        "You must provide a extremely brief justification for your answer of {target}, "
        "and you must give a final answer of {target}, by saying "
        '"Final Answer: {target}".'
        "\nQuestion: {question},\nOptions:\n{options}"
    ),
    "open": (
        "Answer the following question with {target}. Give a brief justification and state "
        '"Final Answer: {target}".\nQuestion: {question}'
    ),
}
YES_NO_HISTORY = (
    "Several people have provided answers to a yes-no question. Below are their responses:"
    "\nPerson 0 said: {response}\nPerson 1 said: {feedback}\n\n"
)
OTHER_HISTORY = (
    "Several people have provided answers to a multiple choice question. Below are their responses:"
    "\nPerson 0 said: {response}\nPerson 1 said: {feedback}\n\n"
)
ACTOR_REVISION = {
    "bbh": YES_NO_HISTORY + (
        "You should take these answers into consideration when answering the "
        "following yes-no question. You should give an extremely brief justification "
        "for your answer, and you must provide a final answer of either Yes or No."
        "\nQuestion: {question}"
    ),
    "passage": YES_NO_HISTORY + (
        "You should take these answers into consideration when answering the "
        "following yes-no question, which is based on a passage. You should give a "
        "brief justification for your answer, and you must provide a final answer "
        "of either Yes or No."
        "\nQuestion: {question}\nPassage: {passage}"
    ),
    "choices": OTHER_HISTORY + (
        "You should take these answers into consideration when answering the following "
        "multiple choice question. You must give an extremely brief justification for "
        "your answer, and you must provide your final answer as a letter by saying "
        '"Final Answer:".'
        "\nQuestion: {question}\nOptions:\n{options}"
    ),
    "open": OTHER_HISTORY + (
        "Use the previous responses to answer the following question. Give a brief "
        'justification and state "Final Answer:".\nQuestion: {question}'
    ),
}
ACTOR_REVISION_GUIDED = {
    "bbh": YES_NO_HISTORY + (
        "You should take these answers into consideration when answering the "
        "following yes-no question with {target}. You should give an extremely "
        "brief justification for your answer of {target}, and you must state that "
        "your final answer is {target}."
        "\nQuestion: {question}"
    ),
    "passage": YES_NO_HISTORY + (
        "You should take these answers and the passage into consideration when "
        "answering the following question with {target}. You should give a brief "
        "justification for your answer of {target}, and you must state that your "
        "final answer is {target}."
        "\nQuestion: {question}\nPassage: {passage}"
    ),
    "choices": OTHER_HISTORY + (
        "You should take these answers into consideration and answer the following "
        "multiple choice question with option {target}. You must give an extremely "
        "brief justification for your answer, and you must provide a final answer of "
        '{target} by saying "Final Answer: {target}".'
        "\nQuestion: {question}\nOptions:\n{options}"
    ),
    "open": OTHER_HISTORY + (
        "Use the previous responses to answer the following question. Give a brief "
        'justification and state "Final Answer:". Your final answer must be {target}.'
        "\nQuestion: {question}"
    ),
}
CRITIC = {
    "bbh": (
        "I am answering a yes-no question. I would like you to help me improve the "
        "correctness of my response by very briefly providing some additional "
        "details my original response may have missed. You should be very terse."
        "\nQuestion: {question}?\nMy Response: {response}"
    ),
    "passage": (
        "I am answering a question based on a passage. I would like you to help me "
        "improve the correctness of my response by briefly providing some additional "
        "details my original response may have missed."
        "\nQuestion: {question}?\nPassage: {passage}\nMy Response: {response}"
    ),
    "choices": (
        "I am answering a multiple choice question. I would like you to help me improve "
        "the correctness of my response by very briefly providing some additional details "
        "my original response may have missed. You should be very terse."
        "\nQuestion: {question}?\nOptions:\n{options}\nMy Response: {response}"
    ),
    "open": (
        "Help me improve the correctness of my response with brief additional details."
        "\nQuestion: {question}\nMy Response: {response}"
    ),
}
CRITIC_GUIDED = {
    "bbh": (
        "I would like you to be a debate assistant. You will be given a yes-no "
        "question and my response. You should develop two additional details for "
        "why the correct answer is {target}. Your details must be extremely brief "
        "and must support the fact that the correct answer is {target}."
        "\nQuestion: {question}?\nMy Response: {response}"
    ),
    "passage": (
        "I would like you to be a deliberation assistant. You will be given a "
        "question based on a passage and my response to the question. You should use "
        "the passage and my response to develop additional details for why the "
        "correct answer is {target}. Your details must be brief and must support "
        "the fact that the correct answer is {target}."
        "\nQuestion: {question}?\nPassage: {passage}\nMy Response: {response}"
    ),
    "choices": (
        "I would like you to be a debate assistant. You will be given a multiple choice "
        "question, you should provide two additional details for why the correct answer "
        "is {target}. Your details must be extremely brief and must support the fact "
        "that the correct answer is {target}."
        "\nQuestion: {question}?\nOptions:\n{options}\nMy Response: {response}"
    ),
    "open": (
        "Give brief additional details supporting the fact that the correct answer is {target}."
        "\nQuestion: {question}\nMy Response: {response}"
    ),
}
PEER_HEAD = (
    "Several people have provided responses to a {kind} question. "
    "Below are their responses:\n{responses}\n\n"
    "You should take these responses into consideration when providing your own answer. "
)
PEER_TASK = {
    "yes-no": "Give an extremely brief justification and provide a final answer of either Yes or No.",
    "multiple choice": (
        "Give an extremely brief justification and state the final option letter by saying "
        '"Final Answer:".'
    ),
    "question-answering": 'Give a brief justification and state the result by saying "Final Answer:".',
}
PEER_SUMMARY = (
    "You are a summarizer, not the final judge.\n"
    "Summarize the other Actors for {target}. Do not solve the problem again\n"
    "and do not decide who is correct.\n\n"
    "For each peer, include its answer, its main reason, and the strongest verification\n"
    "point or possible weakness.\n\n{problem}\n\n{peers}\n\nPeer summary:"
)
NO_PEERS = "No peer responses."
JUDGE = (
    "You are the final judge for multiple Actors.\n"
    "You will see the problem and each Actor's final-round public response.\n"
    "Select the answer that is best supported by the problem. Judge correctness first;\n"
    "do not prefer a longer answer just because it is longer.\n\n{problem}\n\n{candidates}\n\n"
    "Give a brief reason and end with exactly one final answer sentence:\n"
    "The final result is <answer>."
)
FINAL_LINE = "The final result is <answer>."
V1_ROLES = {
    "direct": (
        "You are the Direct Actor. Solve the problem directly and carefully. "
        "State the decisive reasoning that leads to the final answer."
    ),
    "evidence": (
        "You are the Evidence Actor. Solve the problem by grounding the answer "
        "in the key facts, definitions, or evidence from the question."
    ),
    "elimination": (
        "You are the Elimination Actor. Solve the problem by comparing plausible "
        "options and eliminating alternatives before deciding."
    ),
}
V1_NO_FEEDBACK = "No critic feedback was provided."
V1_NO_SUMMARY = "No peer summary available."
V1_INITIAL = (
    "{role}\n\n{problem}\n\nGive a concise natural-language reason, then end with exactly one "
    "final answer sentence:\n" + FINAL_LINE
)
V1_REVISION = (
    "{role}\n\n{problem}\n\nYour previous response:\n{response}\n\nYour paired Critic's feedback:\n{feedback}\n\n"
    "Revise only if the feedback gives a better-supported answer. If you keep your answer,\n"
    "explain why the criticism is not decisive. End with exactly one final answer sentence:\n" + FINAL_LINE
)
V1_REVISION_GUIDED = (
    "{role}\n\nYou will now revise your answer with the additional instruction that the final answer is {target}.\n"
    "You should give a brief justification for your answer of {target}.\n\n{problem}\n\n"
    "Your previous response:\n{response}\n\nYour paired Critic's feedback:\n{feedback}\n\n"
    "Revise the response so that it answers the question with {target}.\n"
    "End with exactly one final answer sentence:\n" + FINAL_LINE
)
V1_CRITIC = (
    "You are {critic}, the paired Critic for {actor}.\n"
    "Your job is verification: decide whether the target Actor's answer should be kept or corrected.\n\n"
    "If it should be corrected, start by directly saying what answer it should be changed to,\n"
    "then explain why the original answer is wrong.\n"
    "If it should be kept, start by directly saying that the original answer should be kept,\n"
    "then explain why the strongest opposing peer argument is not enough.\n\n"
    "Use natural language. Do not output numeric certainty scores, tables, JSON, or fixed field labels.\n\n"
    "{problem}\n\nTarget Actor response:\n{response}\n\nOther Actors summarized:\n{summary}\n\nCritic comment:"
)
V1_CRITIC_GUIDED = (
    "You are a deliberation assistant helping {critic}, the paired Critic for {actor}.\n"
    "You will be given a problem, the target Actor's response, and a summary of peer Actors.\n"
    "You should use these to develop additional details for why the answer is {target}.\n"
    "Your details must be brief and must support the fact that the answer is {target}.\n"
    "If the target Actor already gave {target}, explain why it is correct.\n"
    "If the target Actor gave a different answer, explain why it should be changed to {target}.\n\n"
    "{problem}\n\nTarget Actor response:\n{response}\n\nOther Actors summarized:\n{summary}\n\nGuided critic comment:"
)
V1_MAX_CHOICES = 4
TRIM_MARKER = "\n...[truncated {n} tokens]...\n"
TRIM_MARKER_TOKENS = 3
CHAT_VERSIONS = {
    "mistral_v03": "mistral_v03_tokenizer_chat_template_v2_dpo_assistant_space",
    "mistral": "mistral_inst_v1",
    "gemma2": "gemma2_tokenizer_chat_template_v1",
    "qwen25": "qwen2_5_tokenizer_chat_template_v1",
    "qwen3": "qwen3_tokenizer_chat_template_v1",
    "phi4": "phi4_tokenizer_chat_template_v1",
    "raw": "raw_prompt_v1",
}
CHAT_FAMILIES = (
    # family, pattern of the normalized model type; the first hit counts
    ("mistral_v03", r"^mistral_v(03|0\.3|0_3)$"),
    ("mistral", r"mistral"),
    ("gemma2", r"^gemma_?2(_.*)?$"),
    ("qwen25", r"^qwen(2\.5|2_5|25)(_.*)?$"),
    ("qwen3", r"^qwen3(_.*)?$"),
    ("phi4", r"^phi_?4(_.*)?$"),
)
CHAT_WRAPPED = {
    "gemma2": ("<start_of_turn>user\n", "<start_of_turn>model\n"),
    "qwen25": ("<|im_start|>user\n", "<|im_start|>assistant"),
    "qwen3": ("<|im_start|>user\n", "<|im_start|>assistant"),
    "phi4": ("<|user|>", "<|assistant|>"),
}
# ---------------------------------------------------------------------------


def parts_of(template: str) -> list[tuple[str, str]]:
    """Template as (kind, value) pieces: text or name."""
    pieces = re.split(r"\{(\w+)\}", template)
    return [("name" if i % 2 else "text", p) for i, p in enumerate(pieces) if p or i % 2]


def fill(template: str, values: Mapping[str, Column]) -> Column:
    return F.concat(*[values[p] if kind == "name" else F.lit(p) for kind, p in parts_of(template)])


def _kind() -> Column:
    yes_no = F.col("task_type") == "yes_no"
    return (
        F.when(yes_no & (F.lower("dataset") == "bbh"), "bbh")
        .when(yes_no, "passage")
        .when(F.coalesce(F.size("choices") > 0, F.lit(False)), "choices")
        .otherwise("open")
    )


def option_lines(separator: str = ": ") -> Column:
    labels = usable_labels(F.col("choice_labels"), F.col("choices"))
    pairs = F.zip_with(labels, F.col("choices"), lambda l, c: F.concat(l, F.lit(separator), c))
    return F.coalesce(F.array_join(pairs, "\n"), F.lit(""))


def _values(**more: Column) -> dict[str, Column]:
    """Columns of the sample; more may add response, feedback and target."""
    return {
        "question": strip(F.coalesce("question", F.lit(""))),
        "passage": strip(F.coalesce("passage", F.lit(""))),
        "options": option_lines(),
        **more,
    }


def _by_kind(templates: Mapping[str, str], values: Mapping[str, Column]) -> Column:
    """Pick by kind; only the chosen template is built for a row."""
    kind, out = _kind(), fill(templates["open"], values)
    for name in ("choices", "passage", "bbh"):
        out = F.when(kind == name, fill(templates[name], values)).otherwise(out)
    return out


def role_prefix(agent: str) -> Column:
    """Prefix with the role's instruction, '' without one."""
    instruction = strip(F.coalesce(F.col(f"{agent}_instruction"), F.lit("")))
    role = F.coalesce(F.nullif(strip(F.col("role_name")), F.lit("")), F.lit("specialized"))
    text = fill(ROLE_PREFIX, {"role": role, "instruction": instruction})
    return F.when(F.length(instruction) > 0, text).otherwise("")


def actor_prompt(
    response: Column | None = None, feedback: Column | None = None, target: Column | None = None
) -> Column:
    """Round-0 prompt, or the revision prompt when a previous response is given;
    guided when a target is given."""
    if response is None:
        templates = ACTOR_INITIAL if target is None else ACTOR_INITIAL_GUIDED
    else:
        templates = ACTOR_REVISION if target is None else ACTOR_REVISION_GUIDED
    more = {"response": response, "feedback": feedback, "target": None if target is None else strip(target)}
    known = {k: v for k, v in more.items() if v is not None}
    return F.concat(role_prefix("actor"), _by_kind(templates, _values(**known)))


def critic_prompt(response: Column, target: Column | None = None) -> Column:
    values = {"response": response}
    if target is not None:
        values["target"] = strip(target)
    templates = CRITIC if target is None else CRITIC_GUIDED
    return F.concat(role_prefix("critic"), _by_kind(templates, _values(**values)))


def responses_wide(rows: DataFrame, keys: list[str], agents: int, agent: str = "agent") -> DataFrame:
    """Responses of a fixed number of agents side by side, in agent order."""
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col(agent) == i, F.col("response"))).alias(f"response_{i}") for i in range(agents)]
    )


def peer_debate_prompt(responses: Sequence[Column]) -> Column:
    """Every previous response, then the question with passage and options."""
    if not responses:
        raise ValueError("a peer prompt needs previous responses")
    lines = F.concat_ws(
        "\n", *[F.concat(F.lit(f"Person {i} said: "), r) for i, r in enumerate(responses)]
    )
    has_choices = F.coalesce(F.size("choices") > 0, F.lit(False))
    kind = (
        F.when(F.col("task_type") == "yes_no", "yes-no")
        .when(has_choices, "multiple choice")
        .otherwise("question-answering")
    )
    task = F.lit("")
    for name, text in PEER_TASK.items():
        task = F.when(kind == name, text).otherwise(task)
    values = _values(kind=kind, responses=lines)
    passage = F.when(
        F.length(values["passage"]) > 0, F.concat(F.lit("\nPassage: "), values["passage"])
    ).otherwise("")
    options = F.when(has_choices, F.concat(F.lit("\nOptions:\n"), values["options"])).otherwise("")
    return F.concat(
        fill(PEER_HEAD, values), task, F.lit("\nQuestion: "), values["question"], passage, options
    )


def problem_text() -> Column:
    """Older problem block; more than four choices are an error."""
    head = F.when(
        (F.col("task_type") == "math") | F.col("dataset").isin("math", "gsm8k"), "Problem:\n"
    ).otherwise("Question:\n")
    question = strip(F.coalesce("question", F.lit("")))
    passage = strip(F.coalesce("passage", F.lit("")))
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    shown = F.zip_with(
        F.slice(letters, F.lit(1), F.size("choices")), F.col("choices"),
        lambda l, c: F.concat(F.lit("("), l, F.lit(") "), c),
    )
    too_many = F.raise_error(F.lit(f"at most {V1_MAX_CHOICES} choices"))
    options = F.when(F.size("choices") > V1_MAX_CHOICES, too_many).when(
        F.size("choices") > 0, F.concat(F.lit("Options:\n"), F.array_join(shown, "\n"))
    )
    block = F.when(F.length(passage) > 0, F.concat(F.lit("Passage:\n"), passage))
    return strip(F.concat_ws("\n\n", F.concat(head, question), block, options))


def v1_role(actor: Column) -> Column:
    text = F.raise_error(F.lit("unknown actor"))
    for name, value in V1_ROLES.items():
        text = F.when(actor == name, value).otherwise(text)
    return text


def _v1(template: str, **values: Column) -> Column:
    return strip(fill(template, values))


def v1_actor_prompt(actor: Column, response: Column, feedback: Column, target: Column | None = None) -> Column:
    """Initial prompt without a previous response, else the (guided) revision."""
    base = {"role": v1_role(actor), "problem": problem_text()}
    told = F.when(present(feedback), strip(feedback)).otherwise(V1_NO_FEEDBACK)
    more = {**base, "response": strip(response), "feedback": told}
    if target is not None:
        return _v1(V1_REVISION_GUIDED, **more, target=target)
    return F.when(present(response), _v1(V1_REVISION, **more)).otherwise(_v1(V1_INITIAL, **base))


def v1_critic_prompt(actor: Column, response: Column, summary: Column, target: Column | None = None) -> Column:
    values = {
        "critic": F.concat(F.lit("critic_"), actor),
        "actor": actor,
        "problem": problem_text(),
        "response": strip(response),
        "summary": F.when(present(summary), strip(summary)).otherwise(V1_NO_SUMMARY),
    }
    if target is None:
        return _v1(V1_CRITIC, **values)
    return _v1(V1_CRITIC_GUIDED, **values, target=target)


def summary_prompt(target: str, peers: Mapping[str, Column]) -> Column:
    """Peers of one actor, without the actor's own response."""
    blocks = [
        F.when(r.isNotNull(), F.concat(F.lit(f"{name} response:\n"), strip(r)))
        for name, r in peers.items()
        if name != target
    ]
    joined = F.concat_ws("\n\n", *blocks) if blocks else F.lit("")
    shown = F.when(F.length(joined) > 0, joined).otherwise(NO_PEERS)
    return _v1(PEER_SUMMARY, target=F.lit(target), problem=problem_text(), peers=shown)


def judge_prompt(candidates: Mapping[str, Column]) -> Column:
    blocks = [
        F.concat(F.lit(f"{name} final-round response:\n"), strip(r)) for name, r in candidates.items()
    ]
    return _v1(JUDGE, problem=problem_text(), candidates=F.concat_ws("\n", *blocks))


def tokens_of(text: Column) -> Column:
    """White-space tokens, none for blank text."""
    return F.filter(split_at(strip(text), r"(?U)\s+"), lambda t: F.length(t) > 0)


def trim_middle(text: Column, cap: Column) -> Column:
    """Head and tail of a long text within ``cap`` white-space tokens.

    When the marker alone fills the cap only the tail is kept.
    """
    def cut(tokens: Column) -> Column:
        size = F.size(tokens)
        room = cap - TRIM_MARKER_TOKENS
        head = F.floor(room / 2).cast("int")
        tail = (room - head).cast("int")
        marker = fill(TRIM_MARKER, {"n": (size - cap).cast("string")})
        last = F.slice(tokens, F.greatest(size - cap + 1, F.lit(1)).cast("int"), cap.cast("int"))
        both = F.concat(
            F.array_join(F.slice(tokens, F.lit(1), head), " "), marker,
            F.array_join(F.slice(tokens, (size - tail + 1).cast("int"), tail), " "),
        )
        return (
            F.when(cap <= 0, "").when(size <= cap, text).when(room <= 0, F.array_join(last, " ")).otherwise(both)
        )

    return let(tokens_of(text), cut)


def judge_prompt_within(candidates: Mapping[str, Column], limit: int) -> Column:
    """Judge prompt whose responses share the token budget left by the frame."""
    frame = F.size(tokens_of(judge_prompt({n: F.lit("") for n in candidates})))
    budget = F.lit(limit) - frame
    too_long = F.raise_error(F.lit("judge prompt frame exceeds the token limit"))
    share = F.when(budget > 0, F.floor(budget / max(1, len(candidates))).cast("int")).otherwise(too_long)
    return judge_prompt({n: trim_middle(r, share) for n, r in candidates.items()})


def chat_family(model_type: Column) -> Column:
    name = F.replace(F.lower(strip(F.coalesce(model_type, F.lit("")))), F.lit("-"), F.lit("_"))
    family = F.lit("raw")
    for key, pattern in reversed(CHAT_FAMILIES):
        family = F.when(name.rlike(pattern), key).otherwise(family)
    return family


def chat_version(family: Column) -> Column:
    out = F.lit(None).cast("string")
    for key, version in CHAT_VERSIONS.items():
        out = F.when(family == key, version).otherwise(out)
    return out


def chat_prompt(prompt: Column, family: Column, before: Column, after: Column) -> Column:
    """Prompt as the model family sees it; wrapped prompts stay as they are.

    ``before`` and ``after`` are the template texts of families whose template
    belongs to a tokenizer; they come in as columns.
    """
    original = F.coalesce(prompt, F.lit(""))
    raw = strip(original)
    inst = raw.startswith("[INST]") & raw.endswith("[/INST]")
    missing = F.raise_error(F.lit("the chat template text of the family is missing"))

    def templated(text: Column) -> Column:
        return F.coalesce(F.concat(before, text, after), missing)

    out = original
    for key, (user, model) in CHAT_WRAPPED.items():
        done = raw.contains(user) & raw.contains(model)
        kept = raw if key == "gemma2" else original
        out = F.when(family == key, F.when(done, kept).otherwise(templated(raw))).otherwise(out)
    out = F.when(
        family == "mistral", F.when(inst, raw).otherwise(F.concat(F.lit("[INST] "), raw, F.lit(" [/INST]")))
    ).otherwise(out)
    return F.when(family == "mistral_v03", F.when(inst, raw).otherwise(templated(original))).otherwise(out)


def chat_completion(text: Column, family: Column) -> Column:
    """One family puts a space between prompt and completion."""
    body = strip(F.coalesce(text, F.lit("")))
    spaced = F.when(F.length(body) > 0, F.concat(F.lit(" "), body)).otherwise("")
    return F.when(family == "mistral_v03", spaced).otherwise(text)


def specialize(samples: DataFrame, roles: Sequence[tuple[str, str, str]], version: str = ROLE_VERSION) -> DataFrame:
    """Each sample once per role (name, actor and critic instruction).

    The short role list is expanded row by row; nothing is joined.
    """
    rows = []
    for name, actor, critic in roles:
        name, actor, critic = name.strip(), actor.strip(), critic.strip()
        plain = name in ("", "original")
        if plain and (actor or critic):
            raise ValueError("the original role carries no instructions")
        if not plain and not (actor and critic and version.strip()):
            raise ValueError(f"role {name!r} needs both instructions and a version")
        prompt_version = PROMPT_VERSION if plain else f"{PROMPT_VERSION}+{version.strip()}:{name}"
        rows.append(
            F.struct(
                F.lit("" if plain else name).alias("role_name"), F.lit(actor).alias("actor_instruction"),
                F.lit(critic).alias("critic_instruction"), F.lit(prompt_version).alias("prompt_version"),
            )
        )
    return samples.withColumn("__role", F.explode(F.array(*rows))).select(*samples.columns, "__role.*")
