"""Cleaning, extraction and other scalar rules over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.catalog import inputs
from plenum.catalog.registry import query
from plenum.functions import cleaning, extraction, fingerprint, names
from plenum.operators import metrics, records

NL = "\n"
GAP = "\n\n"


def plus(*parts):
    """Concatenate: "@name" is a column, other text is a literal."""
    def column(part):
        if not isinstance(part, str):
            return part
        return F.col(part[1:]) if part.startswith("@") else F.lit(part)

    return F.concat(*[column(p) for p in parts])


# ------------------------------------------------------------------- cleaning
THINK_SQL = r"""
SELECT reply_id, raw, regexp_replace(raw, '(?is)<think\b[^>]*>.*?</think\s*>', chr(10), 'g') AS closed FROM replies"""


@query(
    "strip_think",
    rf"""SELECT reply_id, md5(trim(regexp_replace(regexp_replace(closed, '(?is)<think\b[^>]*>.*$', chr(10), 'g'), '(?is)</think\s*>', chr(10), 'g'),
                {inputs.SQL_BLANKS})) AS visible, regexp_matches(closed, '(?i)<think\b') AS unclosed FROM ({THINK_SQL})""",
)
def strip_think(spark, d):
    return inputs.replies(spark, d).select(
        "reply_id", F.md5(cleaning.strip_think(F.col("raw"))).alias("visible"),
        cleaning.unclosed_think(F.col("raw")).alias("unclosed"),
    )


CLEAN_SQL = """
SELECT doc_id, CASE WHEN words = '' THEN '' ELSE words || chr(10) || chr(10) END
       || 'Direct reason: it holds.' || chr(10) || chr(10) || 'The final result is ' || letter || '.' AS cleaned FROM debris"""


def raw_debris(spark, d):
    """think block, text twice, a template line, an anchored line, an empty
    claim, a control token and a tagged letter."""
    text = plus(
        "<think>Answer: <brief reason></think>", GAP, "@words", GAP, F.upper("words"), GAP,
        "Answer: <your answer>", GAP, "The answer is <option letter>. Direct reason: it  holds .", GAP,
        "The answer is", "\r\n\r\n", "/no_think", GAP, "The final result is <", F.lower("letter"), ">.",
    )
    return inputs.debris(spark, d).withColumn("raw", text)


@query("clean_response", f"SELECT doc_id, length(cleaned) AS size, md5(cleaned) AS cleaned FROM ({CLEAN_SQL})")
def clean_response(spark, d):
    out = cleaning.with_clean_response(raw_debris(spark, d), "raw", "cleaned")
    return out.select(
        "doc_id", F.length("cleaned").cast("bigint").alias("size"), F.md5("cleaned").alias("cleaned")
    )


@query("drop_template_paragraphs", "SELECT doc_id, md5(words || '|<' || letter || '>|Answer') AS kept FROM debris")
def drop_template_paragraphs(spark, d):
    parts = F.array(
        "words", F.lit("<your answer>"), F.lit("Reasoning: <brief explanation>."),
        plus("<", "@letter", ">"), F.lit("Answer"),
    )
    kept = cleaning.drop_template_paragraphs(parts)
    return inputs.debris(spark, d).select("doc_id", F.md5(F.array_join(kept, "|")).alias("kept"))


@query(
    "collapse_adjacent",
    "SELECT doc_id, md5(words || 'x|b|' || words || 'x') AS kept FROM debris",
)
def collapse_adjacent(spark, d):
    text = F.concat("words", F.lit("x"))
    parts = F.array(text, F.upper(text), F.concat(F.lit(" "), text, F.lit("  ")), F.lit("b"), F.lit("<B>"), text)
    return inputs.debris(spark, d).select(
        "doc_id", F.md5(F.array_join(cleaning.collapse_adjacent(parts), "|")).alias("kept")
    )


@query(
    "drop_placeholder_fragments",
    """SELECT doc_id, md5(CASE WHEN words = '' THEN '' ELSE words || chr(10) END || 'Kept. Also kept!' || chr(10) || 'Key evidence: here'
              || chr(10) || chr(10) || '(' || letter || ') stays') AS kept FROM debris""",
)
def drop_placeholder_fragments(spark, d):
    text = plus(
        "@words", NL, "Kept. It is <the answer>. Also kept!", NL, "Choose <option> Key evidence: here", NL,
        "<explanation>", GAP, "<sep>", GAP, "<(", F.lower("letter"), ")> stays",
    )
    return inputs.debris(spark, d).select(
        "doc_id", F.md5(cleaning.drop_placeholder_fragments(text)).alias("kept")
    )


@query("normalize_angle", "SELECT doc_id, md5(words || ' ' || letter || ' (' || letter || ') 4 cm x') AS plain FROM debris")
def normalize_angle(spark, d):
    text = plus("@words", " <", F.lower("letter"), "> <( ", "@letter", " )> <4 cm> <a|b><reason>x")
    return inputs.debris(spark, d).select("doc_id", F.md5(cleaning.normalize_angle(text)).alias("plain"))


@query(
    "drop_empty_claims",
    "SELECT doc_id, md5(CASE WHEN words = '' THEN '' ELSE words || chr(10) END || 'One. Two, but kept' || chr(10) || 'The answer is ' || letter) AS kept FROM debris",
)
def drop_empty_claims(spark, d):
    text = plus("@words", NL, "One.   Two, but kept so, the answer is  ", NL, "Answer:", NL, "The answer is.", NL, "The answer is ", "@letter")
    return inputs.debris(spark, d).select("doc_id", F.md5(cleaning.drop_empty_claims(text)).alias("kept"))


# ----------------------------------------------------------------- extraction
@query(
    "answer_markup",
    "SELECT doc_id, md5(replace(replace(replace(replace(text, '：', ':'), '**', ''), '__', ''), '*', '')) AS plain FROM documents",
)
def answer_markup(spark, d):
    return inputs.table(spark, d, "documents").select("doc_id", F.md5(extraction.answer_markup(F.col("text"))).alias("plain"))


@query(
    "answer_token",
    """SELECT sample_index, CASE WHEN trim(rtrim(trim(coalesce(answer, '')), '.。')) = '' THEN NULL ELSE trim(rtrim(trim(coalesce(answer, '')), '.。')) END AS token,
              CASE WHEN lower(trim(coalesce(answer, ''))) LIKE 'y%' THEN 'YES' ELSE 'NO' END AS word,
              CASE WHEN upper(trim(coalesce(answer, ''))) = 'A' THEN 'YES' ELSE 'NO' END AS letter
       FROM (SELECT sample_index, CASE WHEN sample_index % 3 = 0 THEN answer || '.。. ' ELSE answer END AS answer FROM answer_forms)""",
)
def answer_token(spark, d):
    answer = F.when(F.col("sample_index") % 3 == 0, F.concat("answer", F.lit(".。. "))).otherwise(F.col("answer"))
    safe = F.coalesce(answer, F.lit(""))
    return inputs.answer_forms(spark, d).select(
        "sample_index", F.nullif(extraction.clean_token(safe), F.lit("")).alias("token"),
        extraction.yes_no_word(safe).alias("word"), extraction.yes_no_letter(safe).alias("letter"),
    )


@query(
    "tail_lines",
    f"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, {inputs.SQL_BLANKS})), lambda x: x <> '')[-8:], chr(10))) AS tail
        FROM documents""",
)
def tail_lines(spark, d):
    return inputs.table(spark, d, "documents").select("doc_id", F.md5(extraction.tail_lines(F.col("text"))).alias("tail"))


WORDS = [r"\b(the|les|und)\b", r"\b(and|la|die|of)\b"]


@query(
    "last_match",
    r"""SELECT doc_id, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE greatest(coalesce(length(a), -1), coalesce(length(b), -1)) END AS start,
               CASE WHEN a IS NULL AND b IS NULL THEN NULL WHEN coalesce(length(a), -1) > coalesce(length(b), -1) THEN wa ELSE wb END AS answer
        FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\b(the|les|und)\b') THEN regexp_extract(text, '(?is)^(.*)\b(the|les|und)\b', 1) END AS a,
                     regexp_extract(text, '(?is)^(.*)\b(the|les|und)\b', 2) AS wa,
                     CASE WHEN regexp_matches(text, '(?i)\b(and|la|die|of)\b') THEN regexp_extract(text, '(?is)^(.*)\b(and|la|die|of)\b', 1) END AS b,
                     regexp_extract(text, '(?is)^(.*)\b(and|la|die|of)\b', 2) AS wb
              FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z0-9 .,]', '-', 'g') AS text FROM documents))""",
)
def last_match(spark, d):
    plain = F.regexp_replace("text", "[^A-Za-z0-9 .,]", "-")
    rows = inputs.table(spark, d, "documents").select("doc_id", plain.alias("text"))
    return rows.withColumn("m", extraction.last_match(F.col("text"), WORDS)).select(
        "doc_id", F.col("m.start").cast("bigint").alias("start"), "m.answer"
    )


def extracted(spark, d):
    cleaned = cleaning.with_clean_response(inputs.replies(spark, d), "raw", "response")
    return extraction.with_extracted(cleaned, "response", "task_type").select(
        "reply_id", "doc_id", "role", "task_type", "extracted.answer", "extracted.source", "extracted.confidence"
    )


CONFIDENCE_SQL = """CASE source WHEN 'final_result' THEN 1.0::DOUBLE WHEN 'final_answer' THEN 0.95 WHEN 'boxed' THEN 0.95
                         WHEN 'tail_claim' THEN 0.8 WHEN 'weak_tail' THEN 0.5 ELSE 0 END AS confidence"""


def _extract(name: str, task: str | None) -> None:
    where = f"WHERE task_type = '{task}'" if task else ""

    @query(name, f"SELECT reply_id, answer, source, {CONFIDENCE_SQL} FROM expected_answers {where}")
    def run(spark, d):
        rows = extracted(spark, d)
        rows = rows.filter(F.col("task_type") == task) if task else rows
        return rows.select("reply_id", "answer", "source", "confidence")


_extract("extract_mc", "multiple_choice")
_extract("extract_yes_no", "yes_no")
_extract("extract_math", "math")
_extract("extract_by_task", None)


@query(
    "extract_boxed",
    r"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '\frac{' || n_chars || '}{7}' WHEN 1 THEN '{a}' || n_chars ELSE NULL END AS boxed,
              CASE doc_id % 3 WHEN 0 THEN 'boxed{\frac{' || n_chars || '}{7}}' WHEN 1 THEN '{\boxed {{a}' || n_chars || '}' ELSE NULL END AS raw_span FROM documents""",
)
def extract_boxed(spark, d):
    doc, size = F.col("doc_id"), F.col("n_chars").cast("string")
    body = F.translate("text", "{}", "")
    tail = (
        F.when(doc % 3 == 0, F.concat(F.lit("\n\\boxed{1} then \\boxed{\\frac{"), size, F.lit("}{7}} but \\boxed{2")))
        .when(doc % 3 == 1, F.concat(F.lit("\n{\\boxed {{a}"), size, F.lit("}} and \\boxed{x}")))
        .otherwise("\n\\boxed{{open")
    )
    rows = inputs.table(spark, d, "documents").select("doc_id", F.concat(body, tail).alias("text"))
    found = rows.withColumn("b", extraction.last_boxed(F.col("text")))
    return found.select("doc_id", F.col("b.content").alias("boxed"), F.col("b.span").alias("raw_span"))


# ------------------------------------------------------------ completion rows
@query(
    "completion_record",
    f"""SELECT reply_id, answer, source AS answer_source, {CONFIDENCE_SQL}, answer IS NOT NULL AS parsed,
               coalesce(answer = gold, false) AS correct, CASE WHEN cut THEN 'max_tokens' WHEN left_open THEN 'unclosed_think' END AS truncation_reason,
               cut OR left_open AS truncated
        FROM (SELECT *, reply_id % 9 = 0 OR (reply_id % 9 = 1 AND doc_id % 2 = 0) AS cut FROM expected_answers)""",
)
def completion_record(spark, d):
    reply, doc = F.col("reply_id"), F.col("doc_id")
    rows = (
        inputs.replies(spark, d)
        .withColumn("finish_reason", F.when(reply % 9 == 0, "length").when((reply % 9 == 1) & (doc % 2 == 1), "stop"))
        .withColumn("generated_tokens", F.when(reply % 9 == 1, 1024).when(reply % 9 == 2, None).otherwise(10))
        .withColumn("max_tokens", F.lit(1024))
    )
    out = records.completion_record(rows, "raw", "task_type", "gold", "finish_reason", "generated_tokens", "max_tokens")
    return out.select(
        "reply_id", "answer", "answer_source", F.col("parse_confidence").alias("confidence"), "parsed", "correct",
        "truncation_reason", "truncated",
    )


STORED_SQL = """
SELECT *, CASE reply_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Q' ELSE answer END AS stored_answer, coalesce(answer = gold, false) AS correct
FROM expected_answers"""
DIAGNOSTICS_SQL = """
SELECT {role}, count(*) AS completions, count(*) FILTER (WHERE stored_answer IS DISTINCT FROM answer) AS changed_answer,
       count(*) FILTER (WHERE stored_answer IS NULL AND answer IS NOT NULL) AS recovered_parse,
       count(*) FILTER (WHERE stored_answer IS NOT NULL AND answer IS NULL) AS lost_parse,
       count(*) FILTER (WHERE coalesce(stored_answer = gold, false) <> correct) AS changed_correct
FROM (""" + STORED_SQL + ") GROUP BY ALL"


def rescored(spark, d):
    reply = F.col("reply_id")
    rows = records.with_answer(inputs.replies(spark, d), "raw", "task_type", "gold")
    stored = F.when(reply % 5 == 0, None).when(reply % 5 == 1, "Q").otherwise(F.col("answer"))
    return (
        rows.withColumn("stored_answer", stored)
        .withColumn("stored_parsed", F.col("stored_answer").isNotNull())
        .withColumn("stored_correct", F.coalesce(F.col("stored_answer") == F.col("gold"), F.lit(False)))
    )


@query("rescore_diagnostics", DIAGNOSTICS_SQL.format(role="role"))
def rescore_diagnostics(spark, d):
    return metrics.rescore_diagnostics(rescored(spark, d), ["role"])


@query(
    "job_rescore",
    f"""SELECT role, count(*) AS samples, count(*) FILTER (WHERE correct) / count(*) AS accuracy, count(answer) / count(*) AS parse_rate,
               count(*) FILTER (WHERE coalesce(stored_answer = gold, false)) / count(*) AS stored_accuracy, count(stored_answer) / count(*) AS stored_parse_rate
        FROM ({STORED_SQL}) GROUP BY role""",
)
def job_rescore(spark, d):
    rows = rescored(spark, d)
    n = F.count(F.lit(1))
    return rows.groupBy("role").agg(
        n.alias("samples"), (F.count_if("correct") / n).alias("accuracy"), (F.count_if("parsed") / n).alias("parse_rate"),
        (F.count_if("stored_correct") / n).alias("stored_accuracy"), (F.count_if("stored_parsed") / n).alias("stored_parse_rate"),
    )


@query("answer_source_counts", "SELECT role, source AS answer_source, count(*) AS completions FROM expected_answers GROUP BY ALL")
def answer_source_counts(spark, d):
    return extracted(spark, d).groupBy("role", F.col("source").alias("answer_source")).agg(
        F.count(F.lit(1)).alias("completions")
    )


# ------------------------------------------------------ fingerprints and names
ROW_SQL = """sha256('{"o_custkey":' || o_custkey || ',"o_note":' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || ',"o_orderkey":' || o_orderkey || '}')"""


@query(
    "table_fingerprint",
    f"""SELECT o_orderstatus, count(*) AS rows, CAST(sum(('0x' || substr({ROW_SQL}, 1, 15))::BIGINT::HUGEINT) AS VARCHAR) AS content_hash
        FROM orders GROUP BY o_orderstatus""",
)
def table_fingerprint(spark, d):
    rows = inputs.table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_note"),
    )
    return fingerprint.table_fingerprint(rows, ["o_orderkey", "o_custkey", "o_note"], ["o_orderstatus"])


@query(
    "prompt_versions",
    """SELECT sample_index, CASE WHEN custkey % 4 IN (0, 1) THEN 'acccollab_iclr2025_appendix_c_mmlu_v2'
              ELSE 'acccollab_iclr2025_appendix_c_mmlu_v2+acccollab_role_prefix_v1:' || CASE custkey % 4 WHEN 2 THEN 'evidence' ELSE 'verification' END END AS prompt_version
       FROM samples""",
)
def prompt_versions(spark, d):
    role = F.element_at(F.array(F.lit(""), F.lit("original"), F.lit("evidence"), F.lit(" verification ")), (F.col("custkey") % 4 + 1).cast("int"))
    return inputs.samples(spark, d).select("sample_index", names.prompt_version(role).alias("prompt_version"))


MODEL_SPELLINGS = ("Llama3", "llama3-8b", "LLAMA3_8B_instruct", "Mistral-7B", "gemma-2-2b-it", "Gemma2", "gemma_2_2b", "phi4")
SPELLED_SQL = "[" + ", ".join(f"'{m}'" for m in MODEL_SPELLINGS) + "][1 + (c_custkey % 8)::INT]"


@query(
    "model_alias",
    f"""SELECT c_custkey, CASE WHEN c_custkey % 8 < 3 THEN 'llama3' WHEN c_custkey % 8 = 3 THEN 'mistral' WHEN c_custkey % 8 IN (5, 6) THEN 'gemma2' END AS model
        FROM customer""",
)
def model_alias(spark, d):
    spelled = F.element_at(F.array(*[F.lit(m) for m in MODEL_SPELLINGS]), (F.col("c_custkey") % 8 + 1).cast("int"))
    return inputs.table(spark, d, "customer").select("c_custkey", names.model_alias(spelled).alias("model"))
