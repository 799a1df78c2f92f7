"""Baselines, comparisons, result matrices and the jobs around them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.catalog import inputs
from plenum.catalog.flagship import round_metrics_sql
from plenum.catalog.registry import query
from plenum.catalog.voting import SCORES
from plenum.operators import audit, baselines, fusion, joins, metrics, records, report
from plenum.plans import jobs
from plenum.session import scratch_path
from plenum.sources import records as scan

# ------------------------------------------------------------------- baselines


@query(
    "flatten_rounds",
    "SELECT sample_id, role, round, answer, parsed, correct, truncated FROM votes",
)
def flatten_rounds(spark, d):
    return records.flatten_rounds(inputs.records(spark, d), ["sample_id", "role"])


DIRECT_SQL = """SELECT dataset, role, sample_id, label AS answer, label IS NOT NULL AS parsed,
                       coalesce(label = gold, false) AS correct, truncated FROM completions WHERE round = 0"""


def direct_rows(spark, d):
    raw = baselines.direct_from_debate(
        inputs.records(spark, d), ["dataset", "role", "sample_id", "task_type", "gold"]
    )
    return records.with_answer(raw, "raw_response", "task_type", "gold").withColumn("truncated", F.col("stored_truncated"))


@query("derive_direct_from_debate", f"SELECT sample_id, role, answer, parsed, correct, truncated FROM ({DIRECT_SQL})")
def derive_direct(spark, d):
    return direct_rows(spark, d).select("sample_id", "role", "answer", "parsed", "correct", "truncated")


@query("direct_metrics", f"SELECT dataset, {SCORES} FROM ({DIRECT_SQL}) GROUP BY dataset")
def direct_metrics(spark, d):
    return baselines.direct_scores(direct_rows(spark, d), ["dataset"])


@query("debate_metrics", f"SELECT dataset, round, round = 4 AS headline, {SCORES} FROM votes GROUP BY ALL")
def debate_metrics(spark, d):
    flat = records.flatten_rounds(inputs.records(spark, d), ["dataset", "sample_id", "role"])
    return baselines.debate_scores(flat, ["dataset"])


SOM_SQL = """
SELECT a.*, samples, plurality_vote_accuracy, plurality_vote_coverage
FROM (SELECT dataset, round, count(*) AS agent_decisions, count(*) FILTER (WHERE correct) / count(*) AS mean_agent_accuracy,
             count(*) FILTER (WHERE parsed) / count(*) AS mean_agent_parse_rate, count(*) FILTER (WHERE truncated) / count(*) AS mean_agent_truncation_rate
      FROM agent_votes GROUP BY ALL) a
JOIN (SELECT dataset, round, count(*) AS samples, count(*) FILTER (WHERE coalesce(prediction = gold, false)) / count(*) AS plurality_vote_accuracy,
             count(prediction) / count(*) AS plurality_vote_coverage
      FROM (SELECT dataset, round, sample_index, max(gold) AS gold,
                   CASE WHEN count(DISTINCT answer) FILTER (WHERE n = top) = 1 THEN max(answer) FILTER (WHERE n = top) END AS prediction
            FROM (SELECT *, max(n) OVER (PARTITION BY sample_index, round) AS top
                  FROM (SELECT *, CASE WHEN answer IS NOT NULL THEN count(*) OVER (PARTITION BY sample_index, round, answer) END AS n FROM agent_votes))
            GROUP BY ALL) GROUP BY ALL) b USING (dataset, round)"""


@query("som_metrics", SOM_SQL)
def som_metrics(spark, d):
    rows = inputs.votes(spark, d, inputs.AGENTS).withColumnRenamed("role_idx", "agent")
    return baselines.som_scores(rows, ["dataset"], 4)


@query(
    "job_baselines",
    f"""SELECT 'direct' AS method, dataset, accuracy, parse_rate, samples FROM (SELECT dataset, {SCORES} FROM ({DIRECT_SQL}) GROUP BY dataset)
        UNION ALL SELECT 'debate', dataset, accuracy, parse_rate, samples FROM (SELECT dataset, {SCORES} FROM votes WHERE round = 4 GROUP BY dataset)
        UNION ALL SELECT 'som_4x', dataset, mean_agent_accuracy, mean_agent_parse_rate, samples FROM ({SOM_SQL}) WHERE round = 4""",
)
def job_baselines(spark, d):
    direct = direct_metrics(spark, d).withColumn("method", F.lit("direct"))
    debate = debate_metrics(spark, d).filter("headline").withColumn("method", F.lit("debate"))
    som = som_metrics(spark, d).filter("round = 4").select(
        "dataset", F.col("mean_agent_accuracy").alias("accuracy"), F.col("mean_agent_parse_rate").alias("parse_rate"),
        "samples", F.lit("som_4x").alias("method"),
    )
    columns = ["method", "dataset", "accuracy", "parse_rate", "samples"]
    return joins.union_parts([direct.select(columns), debate.select(columns), som.select(columns)])


# ----------------------------------------------------------------- gold, dedup


@query(
    "join_gold",
    """SELECT c.sample_id, c.role, c.round, c.gold, CASE WHEN c.sample_index % 10 = 3 THEN 'multiple_choice' ELSE c.task_type END AS task_type,
              c.sample_index % 9 <> 4 AND coalesce(label = c.gold, false) AS correct, c.sample_index % 9 <> 4 AS known
       FROM (SELECT * REPLACE (CASE WHEN sample_index % 9 = 4 THEN NULL ELSE gold END AS gold,
                               CASE WHEN sample_index % 9 = 4 THEN 'multiple_choice' ELSE task_type END AS task_type), label AS l FROM completions) c""",
)
def join_gold(spark, d):
    index = F.col("sample_index")
    known = inputs.samples(spark, d).filter(index % 9 != 4).select(
        "sample_id", "gold", F.when(index % 10 == 3, "").otherwise(F.col("task_type")).alias("task_type")
    )
    rows = inputs.completions(spark, d).select("sample_id", "role", "round", F.col("label").alias("answer"))
    return joins.attach_gold(rows, known).drop("answer")


REQUEST_SQL = "SELECT sample_index, role, round, CASE WHEN custkey % 3 = 0 THEN 'hot prompt' ELSE 'prompt ' || (custkey % 50) || role END AS prompt FROM completions"


def requests(spark, d):
    prompt = F.when(F.col("custkey") % 3 == 0, "hot prompt").otherwise(
        F.concat(F.lit("prompt "), (F.col("custkey") % 50).cast("string"), "role")
    )
    return inputs.completions(spark, d).select("sample_index", "role", "round", prompt.alias("prompt"))


@query(
    "dedup_requests",
    f"""SELECT sample_index, role, round, users, 'answer to ' || prompt AS response
        FROM (SELECT *, count(*) OVER (PARTITION BY prompt) AS users FROM ({REQUEST_SQL}))""",
)
def dedup_requests(spark, d):
    asked = requests(spark, d)
    answers = joins.distinct_requests(asked).select(
        "prompt_hash", "users", F.concat(F.lit("answer to "), "prompt").alias("response")
    )
    return joins.fan_back(asked, answers).select("sample_index", "role", "round", "users", "response")


# ---------------------------------------------------------------- sort and merge


@query(
    "merge_sorted",
    """SELECT custkey, sample_index, CASE sample_index % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS shard FROM samples""",
)
def merge_sorted(spark, d):
    rows = inputs.samples(spark, d).select("custkey", "sample_index")
    parts = [rows.filter(F.col("sample_index") % 3 == i) for i in range(3)]
    return joins.merge_sorted(parts, ["custkey"], "sample_index")


@query(
    "sort_keys",
    "SELECT sample_index, role, temperature FROM (SELECT sample_index, role, [0.7, 0.2, 1.0, 0.4, 0.9][1 + round]::DOUBLE AS temperature FROM completions) ORDER BY ALL",
)
def sort_keys(spark, d):
    from plenum.sources import sinks

    scale = F.element_at(F.array(*[F.lit(t) for t in (0.7, 0.2, 1.0, 0.4, 0.9)]), F.col("round") + 1)
    rows = inputs.completions(spark, d).select("sample_index", "role", scale.alias("temperature"))
    return sinks.in_key_order(rows, "sft_rows")


@query(
    "union_configs",
    """SELECT doc_id, lang, source, NULL::BIGINT AS n_chars FROM documents WHERE lang = 'en'
       UNION ALL SELECT doc_id, lang, NULL, n_chars FROM documents WHERE lang <> 'en'""",
)
def union_configs(spark, d):
    docs = inputs.table(spark, d, "documents")
    english = docs.filter("lang = 'en'").select("doc_id", "lang", "source")
    others = docs.filter("lang != 'en'").select("doc_id", "lang", "n_chars")
    return joins.union_parts([english, None, others])


# -------------------------------------------------------------- result matrices

VARIANT_SQL = """
SELECT model, dataset, variant, CASE WHEN at_round = 0 THEN first ELSE headline END * 100.0::DOUBLE AS accuracy
FROM (SELECT model, dataset, source, arg_max(accuracy, round) AS headline, max(accuracy) FILTER (WHERE round = 0) AS first FROM cells GROUP BY ALL)
JOIN (VALUES ('SFT-only', 'sft_only', NULL), ('SFT+Base-C', 'sft_base_critic', NULL), ('SFT+Trained-C', 'sft_trained_critic', NULL),
             ('No-SFT', 'no_sft_full', NULL), ('Full-R0', 'full', 0), ('Full-R4', 'full', NULL)) v(variant, source, at_round) USING (source)"""
CONTRAST_SQL = f"""
WITH acc AS MATERIALIZED ({VARIANT_SQL})
SELECT contrast, model, dataset, u.accuracy AS upper, l.accuracy AS lower, u.accuracy - l.accuracy AS delta
FROM (VALUES ('inference_interaction', 'Full-R4', 'Full-R0'), ('base_critic_interaction', 'SFT+Base-C', 'SFT-only'),
             ('actor_dpo_solo', 'Full-R0', 'SFT-only'), ('full_vs_sft', 'Full-R4', 'SFT-only')) c(contrast, up, low)
JOIN acc u ON u.variant = up JOIN acc l USING (model, dataset) WHERE l.variant = low"""


@query("map_variant_accuracy", VARIANT_SQL)
def map_variant_accuracy(spark, d):
    return report.variant_accuracy(inputs.cells(spark, d))


@query("join_contrast", CONTRAST_SQL)
def join_contrast(spark, d):
    return report.contrast_rows(map_variant_accuracy(spark, d))


@query(
    "contrast_summary",
    f"""SELECT contrast, round(avg(delta), 9) AS mean_change_points, count(*) FILTER (WHERE delta > 0) AS positive_cells, count(*) AS cells
        FROM ({CONTRAST_SQL}) GROUP BY contrast""",
)
def contrast_summary(spark, d):
    out = report.contrast_summary(join_contrast(spark, d))
    return out.withColumn("mean_change_points", F.round("mean_change_points", 9))


METHOD_SQL = """
SELECT model, dataset, CASE source WHEN 'full' THEN 'current' ELSE 'original' END AS method, arg_max(accuracy, round) AS accuracy,
       arg_max(parse_rate, round) AS parse_rate, arg_max(samples, round) AS samples
FROM cells WHERE source IN ('full', 'sft_only') GROUP BY ALL"""


def method_results(spark, d):
    rows = inputs.cells(spark, d).filter(F.col("source").isin("full", "sft_only"))
    last = records.last_round(rows, ["model", "dataset", "source"], ["accuracy", "parse_rate", "samples"])
    return last.select(
        "model", "dataset", F.when(F.col("source") == "full", "current").otherwise("original").alias("method"),
        "accuracy", "parse_rate", "samples",
    )


@query(
    "join_method_delta",
    f"""SELECT model, dataset, o AS original_accuracy, c AS current_accuracy, c - o AS absolute_delta, (c - o) * 100.0::DOUBLE AS delta_percentage_points
        FROM (SELECT model, dataset, max(accuracy) FILTER (WHERE method = 'original') AS o, max(accuracy) FILTER (WHERE method = 'current') AS c FROM ({METHOD_SQL}) GROUP BY ALL)""",
)
def join_method_delta(spark, d):
    return report.method_delta(method_results(spark, d), ["model", "dataset"])


REFERENCE_SQL = "VALUES " + ", ".join(
    f"('{m}', '{s}', '{k}', {a}::DOUBLE, {w}::DOUBLE)" for m, s, k, a, w in report.REFERENCE_VALUES
)


@query(
    "join_reference_values",
    f"""SELECT model_type, model, dataset, method, accuracy, paper AS paper_accuracy, accuracy - paper AS absolute_delta,
               (accuracy - paper) / paper * 100.0::DOUBLE AS relative_delta_percent, accuracy > paper AS above_paper_mean,
               accuracy BETWEEN paper - width AND paper + width AS within_ci95
        FROM (SELECT model AS model_type, dataset, CASE round % 2 WHEN 0 THEN 'ACC-Collab' ELSE 'ACC-Collab+' END AS method, accuracy,
                     CASE model WHEN 'Llama3-8B' THEN 'llama3' WHEN 'mistral_7b' THEN 'mistral' WHEN 'gemma-2-2b' THEN 'gemma2' END AS model
              FROM cells) JOIN ({REFERENCE_SQL}) r(model, dataset, method, paper, width) USING (model, dataset, method)""",
)
def join_reference_values(spark, d):
    measured = inputs.cells(spark, d).select(
        F.col("model").alias("model_type"), "dataset", "accuracy", (F.col("round") % 2 + 1).alias("iterations")
    )
    return report.compare_with_reference(measured)


PLAN_SQL = f"""
SELECT model, method, dataset, p.expected_samples, r.samples, accuracy, parse_rate,
       CASE WHEN r.samples IS NULL THEN 'missing' WHEN r.samples <> p.expected_samples THEN 'coverage' ELSE 'ok' END AS status
FROM (SELECT model, dataset, method, samples + CASE WHEN dataset = 'bbh' THEN 1 ELSE 0 END AS expected_samples FROM ({METHOD_SQL})) p
LEFT JOIN (SELECT * FROM ({METHOD_SQL}) WHERE NOT (dataset = 'arc' AND method = 'original')) r USING (model, dataset, method)"""


def planned(spark, d):
    results = method_results(spark, d)
    plan = results.select(
        "model", "dataset", "method",
        (F.col("samples") + F.when(F.col("dataset") == "bbh", 1).otherwise(0)).alias("expected_samples"),
    )
    kept = results.filter(~((F.col("dataset") == "arc") & (F.col("method") == "original")))
    return report.plan_results(plan, kept, ["model", "dataset", "method"])


@query("join_plan_results", PLAN_SQL)
def join_plan_results(spark, d):
    return planned(spark, d)


@query(
    "best_role_wins",
    """WITH f AS (SELECT dataset, round, count(*) FILTER (WHERE coalesce(final = gold, false)) / count(*) AS fused, count(*) FILTER (WHERE coalesce(d = gold, false)) / count(*) AS x,
                         count(*) FILTER (WHERE coalesce(e = gold, false)) / count(*) AS y, count(*) FILTER (WHERE coalesce(v = gold, false)) / count(*) AS z FROM ballots GROUP BY ALL)
       SELECT round, count(*) AS cells, count(*) FILTER (WHERE fused > greatest(x, y, z)) AS wins, count(*) FILTER (WHERE fused = greatest(x, y, z)) AS ties FROM f GROUP BY round""",
)
def best_role_wins(spark, d):
    cells = fused(spark, d, ["dataset", "round"])
    return report.best_role_wins(cells, "accuracy", [f"{r}_accuracy" for r in fusion.ROLES], ["round"])


def fused(spark, d, groups):
    aligned = fusion.align_roles(inputs.votes(spark, d), ["dataset", "sample_index", "round"])
    return fusion.fusion_metrics(fusion.majority_vote(aligned), groups)


@query(
    "headline_selection",
    """SELECT dataset, role, CASE dataset WHEN 'boolq' THEN t1 WHEN 'mmlu' THEN m WHEN 'bbh' THEN m WHEN 'sciq' THEN t2 ELSE t3 END AS headline
       FROM (SELECT dataset, role, count(*) FILTER (WHERE correct AND round = 0) / count(*) FILTER (WHERE round = 0) AS t1,
                    count(*) FILTER (WHERE correct AND round = 1) / count(*) FILTER (WHERE round = 1) AS m,
                    count(*) FILTER (WHERE correct AND round = 2) / count(*) FILTER (WHERE round = 2) AS t2,
                    count(*) FILTER (WHERE correct AND round = 3) / count(*) FILTER (WHERE round = 3) AS t3 FROM votes GROUP BY ALL)""",
)
def headline_selection(spark, d):
    def rate(r):
        at = F.col("round") == r
        return F.count_if(at & F.col("correct")) / F.count_if(at)

    rows = inputs.votes(spark, d).groupBy("dataset", "role").agg(*[rate(r).alias(f"r{r}") for r in range(4)])
    name = F.col("dataset")
    trial = F.struct(F.when(name == "boolq", 0).otherwise(1).alias("trial"), F.col("r0").alias("accuracy"))
    shaped = rows.select(
        "dataset", "role", F.array(trial).alias("trials"), F.when(name.isin("boolq", "mmlu", "bbh"), F.col("r1")).alias("mean"),
        F.when(name == "sciq", F.col("r2")).alias("accuracy"), F.struct(F.col("r3").alias("accuracy")).alias("final"),
    )
    return metrics.headline(shaped).select("dataset", "role", "headline")


METRIC_COLUMNS = ["accuracy", "parse_rate"]
LOCKED_SQL = f"""
SELECT model, dataset, method, metric, observed, CASE WHEN NOT (model = 'phi4_mini' AND metric = 'accuracy') THEN observed + CASE WHEN dataset = 'sciq' AND metric = 'parse_rate' THEN 0.5 ELSE 0 END END AS expected
FROM (SELECT model, dataset, method, 'accuracy' AS metric, accuracy AS observed FROM ({METHOD_SQL})
      UNION ALL SELECT model, dataset, method, 'parse_rate', parse_rate FROM ({METHOD_SQL}))
WHERE (model = 'phi4_mini' AND metric = 'accuracy') OR (dataset = 'sciq' AND metric = 'parse_rate')"""


@query("join_metrics_to_locked", LOCKED_SQL)
def join_metrics_to_locked(spark, d):
    keys = ["model", "dataset", "method"]
    long = audit.long_form(method_results(spark, d), keys, METRIC_COLUMNS).withColumnRenamed("value", "accuracy")
    locked = method_results(spark, d).select(
        *keys, F.when(F.col("model") != "phi4_mini", F.col("accuracy")).alias("accuracy"),
        (F.col("parse_rate") + F.when(F.col("dataset") == "sciq", 0.5).otherwise(0.0)).alias("parse_rate"),
    )
    return report.locked_check(locked, long, keys, METRIC_COLUMNS, audit.EXACT_TOLERANCE)


@query(
    "job_matrix_report",
    f"""SELECT model, dataset, method, expected_samples, samples, accuracy, parse_rate, status,
               accuracy - max(accuracy) FILTER (WHERE method = 'original') OVER (PARTITION BY model, dataset) AS delta_to_original FROM ({PLAN_SQL})""",
)
def job_matrix_report(spark, d):
    cells = planned(spark, d)
    original = cells.filter("method = 'original'").select("model", "dataset", F.col("accuracy").alias("__o"))
    return cells.join(original, ["model", "dataset"], "left").select(
        "model", "dataset", "method", "expected_samples", "samples", "accuracy", "parse_rate", "status",
        (F.col("accuracy") - F.col("__o")).alias("delta_to_original"),
    )


ROUND_POINTS_SQL = "SELECT model, round, avg(accuracy) * 100.0::DOUBLE AS points FROM cells GROUP BY ALL"


@query(
    "job_paper_audit",
    f"""SELECT 'variants' AS section, count(*) AS checks, count(*) FILTER (WHERE dataset IN ('arc', 'bbh')) AS failures FROM ({VARIANT_SQL})
        UNION ALL SELECT 'contrasts', count(DISTINCT contrast), 1 FROM ({CONTRAST_SQL})
        UNION ALL SELECT 'rounds', count(*), count(*) FILTER (WHERE round = 3) FROM ({ROUND_POINTS_SQL})
        UNION ALL SELECT 'locked', count(*) * 2, (SELECT count(*) FROM ({LOCKED_SQL})) FROM ({METHOD_SQL})""",
)
def job_paper_audit(spark, d):
    """Results against locked tables: how many values of each section were compared, how many differ.

    The locked tables are files of rounded values.  Some of their values are
    off, and one data set is absent: the audit must count these.
    """
    variants, contrasts = map_variant_accuracy(spark, d), contrast_summary(spark, d)
    rounds = inputs.cells(spark, d).groupBy("model", "round").agg((F.avg("accuracy") * 100.0).alias("points"))
    off = F.when(F.col("dataset") == "bbh", 0.02).otherwise(0.0)
    wrong = F.when(F.col("contrast") == "full_vs_sft", 0.02).otherwise(0.0)
    late = F.when(F.col("round") == 3, 0.02).otherwise(0.0)
    sections = [
        ("variants", variants, ["model", "dataset", "variant"], "accuracy", variants.filter("dataset <> 'arc'"), off),
        ("contrasts", contrasts, ["contrast"], "mean_change_points", contrasts, wrong),
        ("rounds", rounds, ["model", "round"], "points", rounds, late),
    ]
    outs = []
    for name, observed, keys, value, published, shift in sections:
        path = scratch_path(spark, f"locked-{name}")
        published.select(*keys, (F.round(value, 3) + shift).alias(value)).write.option("header", True).csv(path)
        kinds = {f.name: f.dataType for f in observed.schema.fields}
        locked = scan.scan_csv(spark, path, T.StructType([T.StructField(c, kinds[c]) for c in (*keys, value)]))
        outs.append(audit.section(name, observed, audit.tolerance_violations(observed, locked, keys, value, audit.POINT_TOLERANCE)))
    outs.append(audit.section("locked", method_results(spark, d), join_metrics_to_locked(spark, d), 2))
    return joins.union_parts(outs, strict=True)


# ------------------------------------------------------------- evaluation jobs

EVALUATED_SQL = """
WITH scored AS (SELECT dataset, role, trial, count(*) FILTER (WHERE correct) / count(*) AS accuracy
                FROM (SELECT * FROM trial_votes WHERE NOT (role = 'evidence' AND trial = 2 AND sample_index % 97 = 3)
                             AND NOT (role = 'verification' AND trial = 1 AND sample_index % 83 = 7)
                      UNION ALL SELECT * FROM trial_votes WHERE role = 'direct' AND trial = 3 AND sample_index % 89 = 5)
                WHERE round = 4 GROUP BY dataset, role, trial),
means AS (SELECT dataset, role, count(*) AS count, avg(accuracy) AS mean, stddev_samp(accuracy) AS std FROM scored GROUP BY dataset, role),
bad AS (SELECT dataset, count(*) FILTER (WHERE sample_index % 97 = 3) AS lost, count(*) FILTER (WHERE sample_index % 89 = 5) AS twice,
               count(*) FILTER (WHERE sample_index % 83 = 7) AS cut FROM samples GROUP BY dataset)
SELECT dataset, role, count, round(mean, 9) AS mean, round(std, 9) AS sample_std, round(1.96::DOUBLE * std / sqrt(count), 9) AS ci95_normal_half_width,
       CASE WHEN dataset <> 'arc' THEN round(mean + CASE dataset WHEN 'sciq' THEN 0.02 WHEN 'mmlu' THEN 0.004 ELSE 0 END, 9) END AS reference,
       dataset NOT IN ('arc', 'sciq') AS reproduced,
       CASE WHEN role = 'evidence' THEN lost ELSE 0 END AS missing, CASE WHEN role = 'direct' THEN twice ELSE 0 END AS duplicates,
       CASE WHEN role = 'verification' THEN cut ELSE 0 END AS rounds, CASE WHEN role = 'evidence' AND lost > 0 THEN 1 ELSE 0 END::BIGINT AS trials
FROM means JOIN bad USING (dataset)"""


@query("job_evaluate", EVALUATED_SQL)
def job_evaluate(spark, d):
    """Five trials with planted errors: lost, repeated and cut records, and references that are off or absent."""
    index, trial, role = F.col("sample_index"), F.col("trial"), F.col("role")
    # dealt out by what the checks group by, so that they need no shuffle
    clean, short = (inputs.records(spark, d, trials=5, by="sample_id", rounds=n) for n in (5, 4))
    lost = (role == "evidence") & (trial == 2) & (index % 97 == 3)
    cut = (role == "verification") & (trial == 1) & (index % 83 == 7)
    twice = (role == "direct") & (trial == 3) & (index % 89 == 5)
    copies = F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    whole = clean.filter(~lost & ~F.coalesce(cut, F.lit(False))).withColumn("__copy", copies).drop("__copy")
    rows = whole.unionByName(short.filter(cut))
    known = inputs.samples(spark, d, "sample_id", inputs.TASK_ROWS // 5)
    samples = inputs.each(known, inputs.ROLES, "role_idx", "role").select("dataset", "role", "sample_id")
    keep = ["dataset", "role"]
    exact = jobs.evaluate(rows, keep, samples).summary
    off = F.when(F.col("dataset") == "sciq", 0.02).when(F.col("dataset") == "mmlu", 0.004).otherwise(0.0)
    published = F.struct(*keep, (F.col("mean") + off).alias("mean"))
    # a published table is one list: what its rows are joined by does not reach the scores, which are made once for both
    reference = exact.agg(F.collect_list(F.when(F.col("dataset") != "arc", published)).alias("r")).select(F.inline("r"))
    out = jobs.evaluate(rows, keep, samples, reference=reference)
    # never null, so that the join below leaves no filter that would split the key of every row that is checked
    part = [F.coalesce(F.split("key", "/")[i], F.lit("")) for i in range(2)]
    counted = out.violations.groupBy(part[0].alias("dataset"), part[1].alias("role")).pivot(
        "check", ["missing", "duplicates", "rounds", "trials"]
    ).count()
    checks = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("missing", "duplicates", "rounds", "trials")]
    return out.summary.join(counted, keep, "left").select(
        *keep, "count", *[F.round(c, 9).alias(c) for c in ("mean", "sample_std", "ci95_normal_half_width", "reference")], "reproduced", *checks
    )


FUSED = ("accuracy", "parse_rate", "majority_coverage", "majority_conditional_accuracy", "fallback_accuracy",
         "oracle_any_actor_accuracy", "direct_accuracy", "evidence_accuracy", "verification_accuracy")


@query(
    "job_fuse",
    f"""SELECT dataset, metric, count(*) AS count, round(avg(value), 9) AS mean, round(stddev_samp(value), 9) AS sample_std,
               round(1.96::DOUBLE * stddev_samp(value) / sqrt(count(*)), 9) AS ci95_normal_half_width
        FROM (UNPIVOT ({round_metrics_sql("dataset, trial", "(SELECT * FROM trial_ballots WHERE round = 4)", "oracle_any_actor_accuracy")})
              ON {", ".join(FUSED)} INTO NAME metric VALUE value) GROUP BY ALL""",
)
def job_fuse(spark, d):
    """Role records of five trials to decisions, trial metrics and their summary."""
    flat = records.flatten_rounds(
        inputs.records(spark, d, trials=5), ["dataset", "trial", "sample_index", "role", "task_type", "gold"]
    )
    summary = jobs.fuse(flat, trials=5).summary
    return summary.select(
        "dataset", "metric", "count", *[F.round(c, 9).alias(c) for c in ("mean", "sample_std", "ci95_normal_half_width")]
    )
