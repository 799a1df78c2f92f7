"""The registered queries of this subpackage, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import (
    byte_bpe, byte_cnn, decontaminate, divergence, license_scan, line_dedup, prefix_trie, pu_quality, simhash, token_files, url_filter,
    weak_pii, whitening,
)
from plenum.llm.common import prepared, table
from plenum.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(run):
        QUERIES[name] = lambda spark, sf_dir: run(prepared(spark), sf_dir)
        if oracle is not None:
            ORACLES[name] = oracle
        return run

    return register


@query("op7_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op2_byte_bpe")
def byte_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[s + 1:s + l], ' ') AS win
       FROM (SELECT *, unnest(range(0, len(w) - l + 1)) AS s FROM b)),
g AS (SELECT doc_id, s, l, array_to_string(w[s + 1:s + l], ' ') AS win
      FROM (SELECT *, unnest(range(0, greatest(0, len(w) - l + 1))) AS s FROM d, (SELECT DISTINCT l FROM iw))),
occ AS (SELECT * FROM g WHERE (l, win) IN (SELECT (l, win) FROM iw)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ JOIN iw USING (l, win)) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op9_benchmark_decontamination", CONTAMINATION_SQL)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("k_id", "k_text")


@query("op1_pu_quality")
def pu_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("k_id", "k_text")


@query("op8_line_dedup")
def line_dedup_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are not blank with their class, named by its first line; -1: no document id."""
    found = line_dedup.duplicate_lines(table(spark, sf_dir, "documents"), short=True)
    return found.select(
        F.col("k_id").alias("doc_id"), "line_no", F.col("class_k_id").alias("class_doc_id"), "class_line_no", "n_links", "kept"
    )


@query("op4_url_filter")
def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query("op5_token_files")
def token_files_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.stored_documents(spark, path)


_CLASS_PATTERNS = (
    "[aeiou]", "[b-df-hj-np-tv-z]", "[A-Z]", "[0-9]", " ", r"[\x09-\x0D]", "[.,;:]", "[!?]", "[#*$%&|<>]",
    r"[\x00-\x08\x0E-\x1F\x22\x27-\x29\x2B\x2D\x2F\x3D\x40\x5B-\x60\x7B\x7D-\x7F]", r"[^\x00-\x7F]",
)
_COUNTED = ", ".join(f"len(regexp_extract_all(t, '{pattern}'))" for pattern in _CLASS_PATTERNS)
_SUMMED = ", ".join(f"sum(c[{i + 1}])::DOUBLE" for i in range(len(_CLASS_PATTERNS)))
_HALF = "list_sum(list_transform(list_zip({a}, {b}), lambda x: CASE WHEN x[1] > 0 THEN x[1] * log2(2 * x[1] / (x[1] + x[2])) ELSE 0 END))"


def _distance(one: str, other: str) -> str:
    return f"sqrt(greatest(0, ({_HALF.format(a=one, b=other)} + {_HALF.format(a=other, b=one)}) / 2))"


QUALITY_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
runs AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 8], ' ') AS win FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 7))) AS s FROM d)),
twice AS (SELECT doc_id, s FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
reps AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(s, s + 8)) AS p FROM twice) GROUP BY 1),
base AS MATERIALIZED (
  SELECT doc_id, lang, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) AS n_chars, [{_COUNTED}] AS c,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id)),
words AS MATERIALIZED (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d WHERE lang IS NOT NULL) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS total FROM words GROUP BY 1 HAVING sum(n) >= {divergence.REFERENCE_WORDS}),
top AS (SELECT lang, word, n FROM words JOIN totals USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {divergence.COMMON_WORDS}),
common AS (SELECT lang, list(word ORDER BY n DESC, word) AS ws, list(n ORDER BY n DESC, word) AS ns, sum(n) AS inside FROM top GROUP BY 1),
refs AS (SELECT lang AS ref, ws, list_transform(list_append(ns, total - inside), lambda x: x::DOUBLE / total) AS q, list_transform(cs, lambda x: x / list_sum(cs)) AS qc
         FROM common JOIN totals USING (lang) JOIN (SELECT lang, [{_SUMMED}] AS cs FROM base GROUP BY 1) USING (lang)),
own AS MATERIALIZED (SELECT doc_id, ref, count(*) AS n, word FROM (SELECT doc_id, unnest(w) AS word FROM base WHERE len(w) >= {divergence.GUARD_WORDS}) b
        JOIN (SELECT ref, unnest(ws) AS word FROM refs) r USING (word) GROUP BY ALL),
hist AS (SELECT doc_id, ref, map(list(word), list(n)) AS m, sum(n) AS inside FROM own GROUP BY ALL),
pairs AS (
  SELECT b.doc_id, b.lang, r.ref, n_words, n_chars, qc, q, list_transform(c, lambda x: x::DOUBLE / n_chars) AS pc,
         list_append(list_transform(ws, lambda x: coalesce(m[x], 0)::DOUBLE / n_words), (n_words - coalesce(inside, 0))::DOUBLE / n_words) AS p
  FROM base b CROSS JOIN refs r LEFT JOIN hist h ON h.doc_id = b.doc_id AND h.ref = r.ref),
excess AS (
  SELECT doc_id, lang = ref AS mine, ref,
         CASE WHEN n_chars >= {divergence.GUARD_CHARS} THEN {_distance("pc", "qc")} - {divergence.CHAR_LIMIT} - {divergence.CHAR_SLACK} / sqrt(n_chars) ELSE -1 END AS ce,
         CASE WHEN n_words >= {divergence.GUARD_WORDS} THEN {_distance("p", "q")} - {divergence.WORD_LIMIT} - {divergence.WORD_SLACK} / sqrt(n_words) ELSE -1 END AS we
  FROM pairs),
best AS (
  SELECT doc_id, ce, we FROM excess
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN mine AND greatest(ce, we) <= 0 THEN 0 ELSE 1 END, greatest(ce, we), CASE WHEN mine THEN 0 ELSE 1 END, ref) = 1)
SELECT doc_id, n_words, word_chars, c[9] AS n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND greatest(coalesce(ce, 0), coalesce(we, 0)) <= 0 AS kept,
       round(coalesce(ce, 0), 6) AS char_excess, round(coalesce(we, 0), 6) AS word_excess
FROM base LEFT JOIN best USING (doc_id)
"""


@query("op6_quality_rules", QUALITY_SQL)
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = divergence.judge(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("char_excess", "word_excess")})


@query("op3_weak_pii")
def weak_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_pii.find(table(spark, sf_dir, "documents"))


@query("op10_license_scan")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document; spans are license:start:end, comma-joined in order."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    each = F.transform("found", lambda s: F.concat_ws(":", s["license"], s["start"], s["end"]))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_spans"),
        F.array_join(F.array_sort(F.array_distinct("found.license")), ",").alias("licenses"),
        F.array_join(each, ",").alias("spans"),
        F.array_min("found.coverage").alias("least_coverage"),
    )


@query("op11_embedding_whitening")
def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS long)"))


TRIE_SQL = """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
turns AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 'x': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
taken AS (
  SELECT conv_id, s, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT,
           list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
           lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) % 9 AS h
  FROM turns, crc),
paths AS (
  SELECT o.conv_id, list_concat(coalesce(b.s[1:o.h], []), o.s[o.h + 1:]) AS p
  FROM taken o LEFT JOIN turns b ON b.conv_id = o.conv_id - o.conv_id % 5),
nodes AS MATERIALIZED (
  SELECT d, p[1:d] AS q, min(conv_id) AS conv_id, count(*) AS n,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(p) = d), '')) AS ends
  FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM paths) GROUP BY 1, 2),
kids AS (SELECT d - 1 AS d, q[1:d - 1] AS q, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
known AS MATERIALIZED (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, q)),
below AS (
  SELECT e AS d, q[1:e] AS q, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
         sum(CASE WHEN d > 0 THEN (n - 1) * strlen(q[d].x) ELSE 0 END) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM known) GROUP BY 1, 2)
SELECT k.conv_id, k.d AS depth, u.conv_id AS parent_conv_id, k.n AS n_convs, k.n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, k.ends AS ends_sha256
FROM known k JOIN below USING (d, q) LEFT JOIN nodes u ON u.d = k.d - 1 AND u.q = k.q[1:k.d - 1]
"""


@query("op12_prefix_trie", TRIE_SQL)
def conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


@query("op13_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.identify(table(spark, sf_dir, "documents")).drop("k_id", "k_text")
