"""The flagship: text to answers, answers to votes, votes to scores by round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenum.catalog import inputs
from plenum.plans import jobs

ROUND_METRICS_SQL = """
SELECT {keys}, count(*) AS samples, count(*) FILTER (WHERE ok) AS correct,
       count(*) FILTER (WHERE ok) / count(*) AS accuracy,
       count(final) / count(*) AS parse_rate,
       count(*) FILTER (WHERE majority) / count(*) AS majority_coverage,
       coalesce(count(*) FILTER (WHERE majority AND ok) / nullif(count(*) FILTER (WHERE majority), 0), 0) AS majority_conditional_accuracy,
       count(*) FILTER (WHERE NOT majority) / count(*) AS fallback_rate,
       coalesce(count(*) FILTER (WHERE NOT majority AND ok) / nullif(count(*) FILTER (WHERE NOT majority), 0), 0) AS fallback_accuracy,
       count(*) FILTER (WHERE unanimous) / count(*) AS unanimous_rate,
       count(*) FILTER (WHERE dc OR ec OR vc) / count(*) AS {oracle},
       count(*) FILTER (WHERE dc) / count(*) AS direct_accuracy, count(d) / count(*) AS direct_parse_rate,
       {dt} AS direct_truncation_rate,
       count(*) FILTER (WHERE ec) / count(*) AS evidence_accuracy, count(e) / count(*) AS evidence_parse_rate,
       {et} AS evidence_truncation_rate,
       count(*) FILTER (WHERE vc) / count(*) AS verification_accuracy, count(v) / count(*) AS verification_parse_rate,
       {vt} AS verification_truncation_rate{pairs}
FROM (SELECT *, coalesce(final = gold, false) AS ok, coalesce(d = gold, false) AS dc,
             coalesce(e = gold, false) AS ec, coalesce(v = gold, false) AS vc FROM {source})
GROUP BY {keys}"""


PAIR_COLUMNS = ",\n       ".join(
    f"count(*) FILTER (WHERE {x} = {y}) AS {left}_{right}_agree, count(*) FILTER (WHERE {x} = {y} AND {x} = gold) AS {left}_{right}_agree_correct"
    for x, left, y, right in (
        ("d", "direct", "e", "evidence"), ("d", "direct", "v", "verification"), ("e", "evidence", "v", "verification")
    )
)


def round_metrics_sql(
    keys: str, source: str = "ballots", oracle: str = "oracle_any_role_accuracy", cut: bool = True, pairs: bool = False
) -> str:
    rate = "count(*) FILTER (WHERE {0}) / count(*)" if cut else "0.0::DOUBLE"
    return ROUND_METRICS_SQL.format(
        keys=keys, source=source, oracle=oracle, pairs=",\n       " + PAIR_COLUMNS if pairs else "",
        dt=rate.format("d_cut"), et=rate.format("e_cut"), vt=rate.format("v_cut"),
    )


def fused_accuracy_by_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.completions(spark, sf_dir).select(
        "dataset", "sample_index", "round", "role", "task_type", "gold", "truncated", "tail_text"
    )
    return jobs.round_lattice(rows, "tail_text", rounds=5)
