"""Length audits over one generation per line item."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.catalog import inputs
from plenum.catalog.registry import query
from plenum.operators import lengths

HIST_SQL = """
SELECT max_tokens, generated_tokens, count(*) AS outputs, count(*) FILTER (WHERE length_finished) AS length_finished
FROM finished GROUP BY ALL"""

SUMMARY_SQL = """
SELECT {limit} AS max_tokens, count(*) AS outputs, count(*) FILTER (WHERE length_finished) AS length_finished,
       count(*) FILTER (WHERE length_finished) / count(*) AS length_truncation_rate, avg(generated_tokens) AS generated_tokens_mean,
       quantile_disc(generated_tokens, 0.5) AS generated_tokens_p50, quantile_disc(generated_tokens, 0.95) AS generated_tokens_p95,
       quantile_disc(generated_tokens, 0.99) AS generated_tokens_p99, max(generated_tokens) AS generated_tokens_max
FROM finished {group}"""
BOTH_SQL = (
    SUMMARY_SQL.format(limit="max_tokens", group="GROUP BY max_tokens")
    + " UNION ALL " + SUMMARY_SQL.format(limit="NULL", group="")
)


@query("length_truncated_flag", "SELECT request_id, batch_index, max_tokens, generated_tokens, length_finished FROM finished")
def length_truncated_flag(spark, d):
    return lengths.with_length_flag(inputs.lengths(spark, d)).drop("finish_reason")


@query("length_histogram", HIST_SQL)
def length_histogram(spark, d):
    return lengths.histogram(inputs.lengths(spark, d))


@query(
    "merge_histograms",
    """SELECT max_tokens, count(*) AS outputs, count(*) FILTER (WHERE length_finished) AS length_finished,
              CAST(coalesce(sum(generated_tokens), 0) AS BIGINT) AS generated_tokens_total, count(generated_tokens) AS generated_tokens_observed
       FROM finished GROUP BY max_tokens""",
)
def merge_histograms(spark, d):
    partials = lengths.histogram(inputs.lengths(spark, d), ["batch_index"])
    return lengths.group_totals(lengths.merge(partials))


@query(
    "delta_histograms",
    """SELECT * FROM (
         SELECT max_tokens, generated_tokens, greatest(count(*) FILTER (WHERE batch_index <= 5) - count(*) FILTER (WHERE batch_index IN (1, 7)), 0) AS outputs,
                greatest(count(*) FILTER (WHERE batch_index <= 5 AND length_finished) - count(*) FILTER (WHERE batch_index IN (1, 7) AND length_finished), 0) AS length_finished
         FROM finished GROUP BY ALL) WHERE outputs > 0""",
)
def delta_histograms(spark, d):
    rows = inputs.lengths(spark, d)
    after = lengths.histogram(rows.filter("batch_index <= 5"))
    before = lengths.histogram(rows.filter("batch_index in (1, 7)"))
    return lengths.delta(after, before)


@query("length_percentiles", BOTH_SQL)
def length_percentiles(spark, d):
    return lengths.percentiles(lengths.histogram(inputs.lengths(spark, d)))


@query(
    "length_assessment",
    f"""SELECT max_tokens, outputs, length_finished, CASE WHEN length_truncation_rate >= 0.01 THEN 'fail' WHEN length_truncation_rate >= 0.001 THEN 'warn' ELSE 'pass' END AS status,
               CAST(CASE WHEN length_finished > 0 THEN least(ceil(greatest(max_tokens + 64, max_tokens * 1.25, generated_tokens_p99 * 1.25) / 64) * 64, 1299) ELSE max_tokens END AS BIGINT) AS recommended_max_tokens
        FROM ({BOTH_SQL}) WHERE max_tokens IS NOT NULL""",
)
def length_assessment(spark, d):
    summary = lengths.percentiles(lengths.histogram(inputs.lengths(spark, d)))
    out = lengths.assessment(summary, max_model_len=1300)
    return out.filter(F.col("max_tokens").isNotNull()).select(
        "max_tokens", "outputs", "length_finished", "status", "recommended_max_tokens"
    )
