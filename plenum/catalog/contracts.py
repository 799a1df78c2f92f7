"""Contract checks over tables with planted violations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.catalog import inputs, preference as pref, sampling as samp
from plenum.catalog.registry import query
from plenum.operators import audit, quality


def idx(n, r):
    return F.col("sample_index") % n == r


@query(
    "check_required_splits",
    """SELECT DISTINCT source AS dataset, split FROM documents, (VALUES ('en'), ('fr'), ('de'), ('es'), ('xx')) t(split)
       EXCEPT SELECT source, lang FROM documents WHERE doc_id % 7 > 0""",
)
def check_required_splits(spark, d):
    docs = inputs.table(spark, d, "documents").select("doc_id", F.col("source").alias("dataset"), F.col("lang").alias("split"))
    required = inputs.each_int(docs.select("dataset").distinct(), ["en", "fr", "de", "es", "xx"], "split")
    return quality.required_splits(docs.filter("doc_id % 7 > 0"), required)


@query(
    "check_required_files",
    "SELECT DISTINCT 'part-' || (o_orderkey % 97) AS path FROM orders EXCEPT SELECT 'part-' || (o_custkey % 89) FROM orders",
)
def check_required_files(spark, d):
    rows = inputs.table(spark, d, "orders")
    name = lambda key, n: F.concat(F.lit("part-"), (F.col(key) % n).cast("string")).alias("path")
    return quality.required_files(rows.select(name("o_custkey", 89)), rows.select(name("o_orderkey", 97)).distinct())


@query(
    "check_expected_rows",
    """SELECT * FROM (SELECT subject, expected, coalesce(actual, 0) AS actual
         FROM (SELECT subject, count(*) AS actual FROM samples WHERE dataset <> 'arc' OR subject <> '5-LOW' GROUP BY 1)
         FULL JOIN (SELECT subject, count(*) AS expected FROM samples GROUP BY 1) USING (subject)) WHERE expected IS DISTINCT FROM actual""",
)
def check_expected_rows(spark, d):
    rows = inputs.samples(spark, d)
    expected = rows.groupBy("subject").agg(F.count(F.lit(1)).alias("expected"))
    actual = rows.filter((F.col("dataset") != "arc") | (F.col("subject") != "5-LOW"))
    return quality.expected_rows(actual, expected, ["subject"])


DUP_SQL = "SELECT dataset, CASE WHEN sample_index % 37 = 0 THEN ' ' WHEN sample_index % 41 = 3 THEN 'id-' || custkey ELSE sample_id END AS sample_id FROM samples"


@query("check_duplicate_ids", f"SELECT dataset, sample_id, count(*) AS rows FROM ({DUP_SQL}) GROUP BY ALL HAVING count(*) > 1 OR trim(sample_id) = ''")
def check_duplicate_ids(spark, d):
    made = F.when(idx(37, 0), " ").when(idx(41, 3), F.concat(F.lit("id-"), F.col("custkey").cast("string"))).otherwise(F.col("sample_id"))
    return quality.duplicate_ids(inputs.samples(spark, d).select("dataset", made.alias("sample_id")), "sample_id", ["dataset"])


@query(
    "check_rounds_contiguous",
    """SELECT sample_id, CASE WHEN sample_index % 19 = 1 THEN 4 ELSE 5 END AS rounds FROM samples WHERE sample_index % 19 IN (1, 2)""",
)
def check_rounds_contiguous(spark, d):
    def rounds(*values):
        return F.array(*[F.struct(F.lit(v).alias("round")) for v in values])

    made = F.when(idx(19, 1), rounds(0, 1, 2, 4)).when(idx(19, 2), rounds(0, 2, 1, 3, 4)).otherwise(rounds(0, 1, 2, 3, 4))
    return quality.rounds_not_contiguous(inputs.samples(spark, d).withColumn("rounds", made), "sample_id")


@query(
    "check_coverage",
    """SELECT sample_id, 'missing' AS problem FROM samples WHERE sample_index % 23 = 4
       UNION ALL SELECT 'extra-' || sample_id, 'extra' FROM samples WHERE sample_index % 29 = 5""",
)
def check_coverage(spark, d):
    rows = inputs.samples(spark, d)
    actual = rows.filter(~idx(23, 4)).select("sample_id").unionByName(
        rows.filter(idx(29, 5)).select(F.concat(F.lit("extra-"), "sample_id").alias("sample_id"))
    )
    return quality.coverage(actual, rows, ["sample_id"])


@query(
    "check_candidate_grid",
    """SELECT sample_index, role, [0.7, 0.2, 1.0][1 + round]::DOUBLE AS temperature, CASE WHEN sample_index % 31 = 7 THEN 0 ELSE 2 END AS rows, true AS expected
       FROM completions WHERE round < 3 AND (sample_index % 31 = 7 AND round = 1 OR sample_index % 31 = 8 AND role = 'evidence')
       UNION ALL SELECT sample_index, 'elimination', 0.2::DOUBLE, 1, false FROM samples WHERE sample_index % 31 = 9""",
)
def check_candidate_grid(spark, d):
    rows = samp.sft_candidates(spark, d).select("sample_index", "role", "temperature")
    kept = rows.filter(~(idx(31, 7) & (F.col("temperature") == 0.2)))
    twice = rows.filter(idx(31, 8) & (F.col("role") == "evidence"))
    odd = inputs.samples(spark, d).filter(idx(31, 9)).select("sample_index", F.lit("elimination").alias("role"), F.lit(0.2).alias("temperature"))
    return quality.candidate_grid(
        inputs.samples(spark, d), kept.unionByName(twice).unionByName(odd), samp.TEMPERATURES
    )


@query(
    "check_alignment",
    """SELECT sample_index, round, sample_index % 43 <> 3 AS roles_complete, sample_index % 43 <> 5 AS same_sample,
              CASE WHEN sample_index % 43 = 3 THEN 2 ELSE 3 END AS rows
       FROM samples CROSS JOIN (VALUES (0), (1), (2), (3), (4)) t(round) WHERE sample_index % 43 IN (3, 5)""",
)
def check_alignment(spark, d):
    rows = inputs.votes(spark, d)
    broken = rows.filter(~(idx(43, 3) & (F.col("role") == "evidence"))).withColumn(
        "gold", F.when(idx(43, 5) & (F.col("role") == "direct"), "?").otherwise(F.col("gold"))
    )
    return quality.alignment(broken, ["sample_index", "round"], quality.sample_signature("task_type", "gold", "subject"))


@query(
    "check_protocol",
    """SELECT sample_id, CASE sample_index % 47 WHEN 1 THEN 'pipeline' WHEN 2 THEN 'uses_majority_vote' ELSE 'decision_rule,uses_judge_fallback' END AS wrong
       FROM samples WHERE sample_index % 47 IN (1, 2, 3)""",
)
def check_protocol(spark, d):
    rule = quality.PROTOCOL
    rows = inputs.samples(spark, d).select(
        "sample_id",
        F.when(idx(47, 1), "other").otherwise(rule["pipeline"]).alias("pipeline"),
        F.when(~idx(47, 3), rule["decision_rule"]).alias("decision_rule"),
        F.when(~idx(47, 2), False).alias("uses_majority_vote"),
        F.when(idx(47, 3), True).otherwise(False).alias("uses_judge_fallback"),
    )
    return quality.protocol(rows, "sample_id")


PAIR_TABLE_SQL = f"""
SELECT sample_index, CASE WHEN sample_index % 17 = 1 THEN 5 ELSE round END AS round, CASE WHEN sample_index % 17 = 2 THEN 'actor' ELSE 'critic' END AS agent,
       CASE WHEN sample_index % 17 = 3 THEN ' ' ELSE prompt END AS prompt, chosen, CASE WHEN sample_index % 17 = 4 THEN chosen || ' ' ELSE rejected END AS rejected
FROM ({pref.PAIRS_SQL})"""


@query(
    "check_pairs",
    f"""WITH t AS MATERIALIZED ({PAIR_TABLE_SQL})
        SELECT sample_index, round, 'provenance' AS problem FROM t WHERE agent <> 'critic'
        UNION ALL SELECT sample_index, round, 'round' FROM t WHERE round NOT BETWEEN 1 AND 4
        UNION ALL SELECT sample_index, round, 'blank' FROM t WHERE trim(prompt) = ''
        UNION ALL SELECT sample_index, round, 'identical' FROM t WHERE trim(chosen) = trim(rejected)
        UNION ALL SELECT sample_index, round, 'repeated' FROM t GROUP BY ALL HAVING count(*) > 1
        UNION ALL SELECT sample_index, round, 'unexpected sample' FROM t WHERE sample_index % 17 = 6""",
)
def check_pairs(spark, d):
    rows = pref.flat_pairs(pref.pairs(spark, d))
    broken = rows.select(
        "sample_index", F.when(idx(17, 1), 5).otherwise(F.col("round")).alias("round"),
        F.when(idx(17, 2), "actor").otherwise("critic").alias("agent"), F.lit(1).alias("iteration"),
        F.when(idx(17, 3), " ").otherwise(F.col("prompt")).alias("prompt"), "chosen",
        F.when(idx(17, 4), F.concat("chosen", F.lit(" "))).otherwise(F.col("rejected")).alias("rejected"),
    )
    allowed = inputs.samples(spark, d).filter(~idx(17, 6))
    return quality.pair_problems(broken, "critic", 1, allowed)


@query(
    "check_balanced_roles",
    f"""SELECT CASE WHEN sample_index % 13 = 2 THEN '' ELSE sample_id END AS sample_id, count(*) FILTER (WHERE role = 'evidence' AND sample_index % 13 = 3) AS unknown_roles, count(*) AS rows
        FROM ({samp.MATCHED_SQL}) WHERE NOT (sample_index % 13 = 1 AND role = 'direct')
        GROUP BY 1 HAVING bool_or(sample_index % 13 IN (1, 2, 3))""",
)
def check_balanced_roles(spark, d):
    from plenum.operators import sft

    rows = sft.matched_rows(samp.sft_candidates(spark, d), samp.TEMPERATURES)
    broken = rows.filter(~(idx(13, 1) & (F.col("role") == "direct"))).select(
        F.when(idx(13, 2), "").otherwise(F.col("sample_id")).alias("sample_id"),
        F.when(idx(13, 3) & (F.col("role") == "evidence"), "judge").otherwise(F.col("role")).alias("role"),
    )
    return quality.unbalanced_roles(broken)


@query(
    "check_min_pairs",
    f"""SELECT agent, coalesce(n, 0) AS pairs
        FROM (SELECT DISTINCT 'agent-' || (custkey % 9) AS agent FROM samples)
        LEFT JOIN (SELECT 'agent-' || (sample_index % 7) AS agent, count(*) AS n FROM ({pref.PAIRS_SQL}) GROUP BY 1) USING (agent)
        WHERE coalesce(n, 0) < 100000""",
)
def check_min_pairs(spark, d):
    name = lambda key, n: F.concat(F.lit("agent-"), (F.col(key) % n).cast("string")).alias("agent")
    pairs = pref.flat_pairs(pref.pairs(spark, d)).select(name("sample_index", 7))
    agents = inputs.samples(spark, d).select(name("custkey", 9)).distinct()
    return quality.too_few_pairs(pairs, agents, 100_000)


@query(
    "check_declared_rows",
    """WITH li AS (SELECT l_orderkey % 101 AS batch, l_returnflag AS file, count(*) AS n FROM lineitem GROUP BY ALL)
       SELECT batch, file, CASE WHEN batch <> 7 THEN n + CASE WHEN batch = 9 THEN 1 ELSE 0 END END AS expected,
              CASE WHEN batch = 5 THEN 0 ELSE n END AS actual FROM li WHERE batch IN (5, 7, 9)""",
)
def check_declared_rows(spark, d):
    rows = inputs.table(spark, d, "lineitem").select((F.col("l_orderkey") % 101).alias("batch"), F.col("l_returnflag").alias("file"))
    listed = rows.filter("batch != 7").groupBy("batch", "file").agg(F.count(F.lit(1)).alias("n"))
    manifest = listed.select("batch", "file", (F.col("n") + F.when(F.col("batch") == 9, 1).otherwise(0)).alias("expected"))
    return quality.declared_rows(rows.filter("batch != 5"), manifest, ["batch", "file"])


@query(
    "check_selection_accounting",
    f"""SELECT round, problem FROM (
          SELECT round, count(*) AS total, count(*) FILTER (WHERE drop_reason IS NULL) AS selected FROM ({pref.ROUNDS_SQL}) WHERE round <> 2 OR sample_index % 50 > 0 GROUP BY ALL) t,
          (VALUES ('total'), ('selected'), ('sum')) p(problem)
        WHERE (problem = 'total' AND total <> (SELECT count(*) FROM samples)) OR (problem = 'selected' AND round = 3 AND selected <> selected + 1)""",
)
def check_selection_accounting(spark, d):
    from plenum.operators import preference

    rounds = pref.rounds(spark, d).filter((F.col("round") != 2) | (F.col("sample_index") % 50 > 0))
    summary = preference.selection_summary(rounds, ["round"])
    size = inputs.samples(spark, d).agg(F.count(F.lit(1))).scalar()
    pairs = F.col("selected_rounds") + F.when(F.col("round") == 3, 1).otherwise(0)
    return quality.accounting(summary, size, pairs, rounds=1).select("round", "problem")


@query(
    "check_trials_contiguous",
    """SELECT dataset, count(DISTINCT trial) AS trials, min(trial) AS first, max(trial) AS last, dataset <> 'arc' AS same_samples
       FROM (SELECT dataset, sample_index, round + CASE WHEN dataset = 'bbh' THEN 1 ELSE 0 END AS trial FROM votes WHERE NOT (dataset = 'sciq' AND round = 2))
       WHERE dataset IN ('bbh', 'sciq', 'arc') GROUP BY dataset""",
)
def check_trials_contiguous(spark, d):
    rows = inputs.votes(spark, d)
    broken = rows.filter(~((F.col("dataset") == "sciq") & (F.col("round") == 2))).filter(
        ~((F.col("dataset") == "arc") & (F.col("round") == 1) & idx(3, 0))
    )
    trial = F.col("round") + F.when(F.col("dataset") == "bbh", 1).otherwise(0)
    return quality.trials_not_contiguous(broken.withColumn("trial", trial), ["dataset"], "sample_id")


ACC_SQL = "SELECT dataset, role, round, count(*) FILTER (WHERE correct) / count(*) AS accuracy FROM votes GROUP BY ALL"


@query(
    "check_tolerance",
    f"""SELECT dataset, role, round, accuracy AS observed, CASE WHEN role <> 'evidence' OR round > 0 THEN accuracy + CASE round WHEN 1 THEN 1e-13::DOUBLE WHEN 2 THEN 0.25 ELSE 0 END END AS expected
        FROM ({ACC_SQL}) WHERE round = 2 OR (role = 'evidence' AND round = 0)""",
)
def check_tolerance(spark, d):
    cells = inputs.votes(spark, d).groupBy("dataset", "role", "round").agg(
        (F.count_if("correct") / F.count(F.lit(1))).alias("accuracy")
    )
    moved = F.when(F.col("round") == 1, 1e-13).when(F.col("round") == 2, 0.25).otherwise(0.0)
    expected = cells.filter("role != 'evidence' or round > 0").withColumn("accuracy", F.col("accuracy") + moved)
    return audit.tolerance_violations(cells, expected, ["dataset", "role", "round"], "accuracy", audit.DECISION_TOLERANCE)


@query(
    "variant_dataset_filter",
    """SELECT sample_id, dataset, subject FROM samples
       WHERE (dataset, subject) IN (SELECT dataset, subject FROM samples WHERE dataset <> 'bbh' AND substr(subject, 1, 1) IN ('1', '3'))""",
)
def variant_dataset_filter(spark, d):
    rows = inputs.samples(spark, d).select("sample_id", "dataset", "subject")
    registry = rows.filter((F.col("dataset") != "bbh") & F.substring("subject", 1, 1).isin("1", "3"))
    return quality.registered(rows, registry, ["dataset", "subject"])


@query(
    "set_difference",
    """SELECT custkey, dataset, 'missing' AS side FROM (SELECT custkey, dataset FROM samples WHERE sample_index % 2 = 0 EXCEPT ALL SELECT custkey, dataset FROM samples WHERE sample_index % 3 = 0)
       UNION ALL SELECT custkey, dataset, 'extra' FROM (SELECT custkey, dataset FROM samples WHERE sample_index % 3 = 0 EXCEPT ALL SELECT custkey, dataset FROM samples WHERE sample_index % 2 = 0)""",
)
def set_difference(spark, d):
    rows = inputs.samples(spark, d)
    return quality.set_difference(
        rows.filter(idx(2, 0)).select("custkey", "dataset"), rows.filter(idx(3, 0)).select("custkey", "dataset")
    )


@query(
    "cross_roles_samples",
    """SELECT sample_id, role, temperature FROM samples CROSS JOIN (VALUES ('direct'), ('evidence'), ('verification')) r(role)
       CROSS JOIN (VALUES (0.7::DOUBLE), (0.2::DOUBLE), (1.0::DOUBLE)) t(temperature)""",
)
def cross_roles_samples(spark, d):
    return quality.request_grid(inputs.samples(spark, d).select("sample_id"), samp.TEMPERATURES)
