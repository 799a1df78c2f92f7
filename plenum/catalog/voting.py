"""Votes, round and trial metrics, agreement, transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.catalog import inputs
from plenum.catalog.flagship import fused_accuracy_by_round, round_metrics_sql
from plenum.catalog.registry import query
from plenum.functions import matching
from plenum.operators import audit, fusion, metrics, ranking, records
from plenum.plans import jobs

KEYS = ["dataset", "sample_index", "sample_id", "round"]


def decided(spark, d, rounds=None):
    rows = inputs.votes(spark, d)
    if rounds is not None:
        rows = rows.filter(F.col("round").isin(*rounds))
    return fusion.majority_vote(fusion.align_roles(rows, KEYS))


query("job_round_lattice", round_metrics_sql("dataset, round", pairs=True))(fused_accuracy_by_round)


@query("fusion_metrics_by_round", round_metrics_sql("dataset, round"))
def fusion_metrics_by_round(spark, d):
    return fusion.fusion_metrics(decided(spark, d), ["dataset", "round"])


@query(
    "majority_vote",
    """SELECT sample_id, round, final AS answer,
              CASE WHEN unanimous THEN 'unanimous' WHEN majority THEN 'majority' ELSE 'fixed_direct_fallback' END AS source,
              CASE WHEN NOT majority THEN 'direct' END AS selected_role, majority AS majority_reached,
              CASE WHEN unanimous THEN 3 WHEN majority THEN 2 WHEN d IS NOT NULL THEN 1 ELSE 0 END AS vote_count,
              coalesce(final = gold, false) AS decision_correct
       FROM ballots""",
)
def majority_vote(spark, d):
    return decided(spark, d).select("sample_id", "round", "decision.*", "decision_correct")


@query(
    "fusion_metrics_by_trial",
    round_metrics_sql("dataset, trial", "(SELECT * FROM trial_ballots WHERE round = 4)", "oracle_any_actor_accuracy"),
)
def fusion_metrics_by_trial(spark, d):
    """The last round of five trials, one metrics row per data set and trial."""
    return jobs.fuse(inputs.votes(spark, d, trials=5), trials=5).trials


@query(
    "join_roles_nway",
    """SELECT dataset, sample_id, round, task_type, gold, d AS direct, e AS evidence, v AS verification,
              coalesce(d = gold, false) AS direct_correct, coalesce(e = gold, false) AS evidence_correct,
              coalesce(v = gold, false) AS verification_correct FROM ballots""",
)
def join_roles_nway(spark, d):
    aligned = fusion.align_roles(inputs.votes(spark, d, by="sample_id"), ["dataset", "sample_id", "round"])
    return aligned.select(
        "dataset", "sample_id", "round", "task_type", "gold",
        *[F.col(f"{r}.answer").alias(r) for r in fusion.ROLES],
        *[F.col(f"{r}.correct").alias(f"{r}_correct") for r in fusion.ROLES],
    )


PAIR_SQL = """
SELECT dataset, sample_index, sample_id, round, pair, coalesce(x = y, false) AS agree,
       coalesce(x = y AND x = gold, false) AS agree_correct
FROM (SELECT *, 'direct+evidence' AS pair, d AS x, e AS y FROM ballots
      UNION ALL BY NAME SELECT *, 'direct+verification' AS pair, d AS x, v AS y FROM ballots
      UNION ALL BY NAME SELECT *, 'evidence+verification' AS pair, e AS x, v AS y FROM ballots)"""


@query("join_pairwise_agents", f"SELECT sample_id, round, pair, agree, agree_correct FROM ({PAIR_SQL})")
def join_pairwise_agents(spark, d):
    return fusion.pair_rows(decided(spark, d), ["sample_id", "round"])


@query(
    "pair_agreement",
    f"""SELECT dataset, pair, count(*) FILTER (WHERE agree) AS agree, count(*) FILTER (WHERE agree_correct) AS agree_correct,
               count(*) FILTER (WHERE agree) / count(*) AS coverage,
               coalesce(count(*) FILTER (WHERE agree_correct) / nullif(count(*) FILTER (WHERE agree), 0), 0) AS conditional_accuracy
        FROM ({PAIR_SQL}) WHERE round = 4 GROUP BY ALL""",
)
def pair_agreement(spark, d):
    final = records.last_round(
        inputs.votes(spark, d), ["dataset", "sample_index", "role"],
        ["task_type", "gold", "answer", "parsed", "correct", "truncated"],
    )
    aligned = fusion.align_roles(final, ["dataset", "sample_index"])
    return fusion.pair_agreement(fusion.majority_vote(aligned), ["dataset"])


FLIPS_SQL = """
SELECT dataset, sample_index, bool_or(ok) FILTER (WHERE round = 0) AS r0, bool_or(ok) FILTER (WHERE round = 1) AS r1,
       bool_or(ok) FILTER (WHERE round = 4) AS rn
FROM (SELECT *, coalesce(final = gold, false) AS ok FROM ballots) GROUP BY ALL"""


def decisions_by_round(spark, d):
    return decided(spark, d).select(
        "dataset", "sample_index", "round", F.col("decision_correct").alias("correct")
    )


@query(
    "round_transitions",
    f"""SELECT *, r0_wrong_r1_right * 100.0::DOUBLE / samples AS r0_wrong_r1_right_percent,
               r0_right_r1_wrong * 100.0::DOUBLE / samples AS r0_right_r1_wrong_percent,
               r0_wrong_last_right * 100.0::DOUBLE / samples AS r0_wrong_last_right_percent,
               r0_right_last_wrong * 100.0::DOUBLE / samples AS r0_right_last_wrong_percent
        FROM (SELECT dataset, count(*) AS samples, count(*) FILTER (WHERE NOT r0 AND r1) AS r0_wrong_r1_right,
                     count(*) FILTER (WHERE r0 AND NOT r1) AS r0_right_r1_wrong,
                     count(*) FILTER (WHERE NOT r0 AND rn) AS r0_wrong_last_right,
                     count(*) FILTER (WHERE r0 AND NOT rn) AS r0_right_last_wrong
              FROM ({FLIPS_SQL}) GROUP BY dataset)""",
)
def round_transitions(spark, d):
    return fusion.round_transitions(decisions_by_round(spark, d), ["dataset"])


@query(
    "join_round_transition",
    f"""SELECT sample_index, r0 AS first_correct, r1 AS second_correct, rn AS last_correct,
               NOT r0 AND rn AS corrected, r0 AND NOT rn AS harmed FROM ({FLIPS_SQL})""",
)
def join_round_transition(spark, d):
    return fusion.transition_rows(decisions_by_round(spark, d), ["sample_index"])


SCORES = """count(*) AS samples, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE parsed) AS parsed,
            count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE correct) / count(*) AS accuracy,
            count(*) FILTER (WHERE parsed) / count(*) AS parse_rate, count(*) FILTER (WHERE truncated) / count(*) AS truncation_rate"""


@query("round_accuracy", f"SELECT dataset, role, round, {SCORES} FROM votes GROUP BY ALL")
def round_accuracy(spark, d):
    return metrics.score_counts(inputs.votes(spark, d), ["dataset", "role", "round"])


TRIALS_SQL = f"SELECT dataset, round AS trial, {SCORES} FROM votes GROUP BY ALL"


@query(
    "trial_summary",
    f"""SELECT dataset, count(*) AS count, round(avg(accuracy), 9) AS mean, round(coalesce(stddev_samp(accuracy), 0), 9) AS sample_std,
               round(coalesce(stddev_samp(accuracy), 0) / sqrt(count(*)), 9) AS standard_error,
               round(1.96::DOUBLE * coalesce(stddev_samp(accuracy), 0) / sqrt(count(*)), 9) AS ci95_normal_half_width
        FROM ({TRIALS_SQL}) GROUP BY dataset""",
)
def trial_summary(spark, d):
    trials = metrics.score_counts(
        inputs.votes(spark, d).withColumnRenamed("round", "trial"), ["dataset", "trial"]
    )
    out = metrics.summarize(trials, ["dataset"], "accuracy")
    return out.select("dataset", "count", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


@query(
    "trial_scores",
    f"""SELECT trial, coalesce(samples, 0) AS samples, coalesce(correct, 0) AS correct, coalesce(parsed, 0) AS parsed,
               coalesce(truncated, 0) AS truncated, coalesce(accuracy, 0) AS accuracy, coalesce(parse_rate, 0) AS parse_rate,
               coalesce(truncation_rate, 0) AS truncation_rate
        FROM (SELECT DISTINCT r_regionkey + 1 AS trial FROM region)
        LEFT JOIN (SELECT round AS trial, {SCORES} FROM votes GROUP BY ALL) USING (trial)""",
)
def trial_scores(spark, d):
    # trials 1..5 are expected, 0..4 have rows: trial 5 scores zero
    expected = inputs.table(spark, d, "region").select((F.col("r_regionkey") + 1).alias("trial")).distinct()
    rows = inputs.votes(spark, d).withColumnRenamed("round", "trial")
    return metrics.trial_scores(rows, expected, ["trial"])


MIXED_HIT = (
    "CASE WHEN task = 'math' THEN coalesce(prediction, '') = gold ELSE "
    + inputs.sql_match_label("prediction", "task") + " = " + inputs.sql_match_label("gold", "task") + " END"
)


@query(
    "mixed_accuracy",
    f"""SELECT role, count(*) AS samples, count(*) FILTER (WHERE hit) AS correct, count(*) FILTER (WHERE hit) / count(*) AS accuracy
        FROM (SELECT *, {MIXED_HIT} AS hit
              FROM (SELECT role, gold, CASE WHEN k <> 9 THEN label END AS prediction,
                           coalesce(CASE WHEN doc_id % 9 > 0 THEN task_type END, 'yes_no') AS task FROM replies))
        GROUP BY role""",
)
def mixed_accuracy(spark, d):
    rows = inputs.replies(spark, d)
    labels = rows.select(
        "reply_id", "role", F.col("gold").alias("label"),
        F.when(F.col("doc_id") % 9 > 0, F.col("task_type")).alias("task_type"),
    )
    answered = rows.filter(F.col("k") != 9).select("reply_id", F.col("label").alias("prediction"))
    return metrics.mixed_accuracy(labels, answered, "reply_id", ["role"])


TALLY_SQL = """
SELECT sample_index, round, label, count(*) AS votes, min(role_idx) AS first_seen
FROM completions WHERE label IS NOT NULL GROUP BY ALL"""


@query(
    "plurality_first",
    f"""SELECT s.sample_index, s.round, CASE WHEN votes >= 2 THEN 'majority' ELSE 'judge' END AS source,
               CASE WHEN votes >= 2 THEN label END AS final_answer, label AS majority_answer, coalesce(votes, 0) AS majority_count
        FROM (SELECT DISTINCT sample_index, round FROM completions) s
        LEFT JOIN (SELECT * FROM ({TALLY_SQL}) QUALIFY row_number() OVER (PARTITION BY sample_index, round ORDER BY votes DESC, first_seen) = 1) t
        USING (sample_index, round)""",
)
def plurality_first(spark, d):
    return fusion.plurality_first(inputs.votes(spark, d), ["sample_index", "round"])


@query(
    "plurality_unique",
    f"""SELECT sample_index, round, prediction FROM (SELECT DISTINCT sample_index, round FROM completions)
        LEFT JOIN (SELECT sample_index, round, CASE WHEN count(*) FILTER (WHERE votes = top) = 1 THEN max(label) FILTER (WHERE votes = top) END AS prediction
                   FROM (SELECT *, max(votes) OVER (PARTITION BY sample_index, round) AS top FROM ({TALLY_SQL})) GROUP BY ALL)
        USING (sample_index, round)""",
)
def plurality_unique(spark, d):
    return fusion.plurality_unique(inputs.votes(spark, d), ["sample_index", "round"])


@query("last_round", "SELECT sample_id, role, round, answer, correct FROM votes WHERE round = 4")
def last_round(spark, d):
    return records.last_round(inputs.votes(spark, d, by="sample_id"), ["sample_id", "role"], ["answer", "correct"])


@query(
    "macro_accuracy",
    """WITH per_role AS (SELECT role AS model, dataset, round, count(*) FILTER (WHERE correct) / count(*) AS accuracy FROM votes GROUP BY ALL),
            means AS (SELECT model, round, avg(accuracy) * 100.0::DOUBLE AS macro_accuracy FROM per_role GROUP BY ALL)
       SELECT model, round, round(macro_accuracy, 9) AS macro_accuracy FROM means
       UNION ALL SELECT 'Mean', round, round(avg(macro_accuracy), 9) FROM means GROUP BY round""",
)
def macro_accuracy(spark, d):
    cells = metrics.score_counts(inputs.votes(spark, d), ["role", "dataset", "round"])
    out = metrics.macro_accuracy(cells.withColumnRenamed("role", "model"), "model", "round", "accuracy")
    return out.withColumn("macro_accuracy", F.round("macro_accuracy", 9))


@query(
    "distinct_sources",
    """SELECT dataset, count(DISTINCT sample_id) AS samples, count(DISTINCT subject) AS subjects,
              count(DISTINCT CASE WHEN correct THEN sample_id END) AS solved FROM votes GROUP BY dataset""",
)
def distinct_sources(spark, d):
    return inputs.votes(spark, d).groupBy("dataset").agg(
        F.countDistinct("sample_id").alias("samples"),
        F.countDistinct("subject").alias("subjects"),
        F.countDistinct(F.when(F.col("correct"), F.col("sample_id"))).alias("solved"),
    )


@query(
    "normalize_for_vote",
    f"SELECT sample_index, {inputs.sql_vote_label('answer', 'task_type')} AS label FROM answer_forms",
)
def normalize_for_vote(spark, d):
    return inputs.answer_forms(spark, d).select(
        "sample_index", matching.vote_label(F.col("answer"), F.col("task_type")).alias("label")
    )


@query(
    "normalize_for_match",
    f"SELECT sample_index, {inputs.sql_match_label('answer', 'task_type')} AS label FROM answer_forms",
)
def normalize_for_match(spark, d):
    return inputs.answer_forms(spark, d).select(
        "sample_index", matching.match_label(F.col("answer"), F.col("task_type")).alias("label")
    )


@query(
    "answers_match",
    f"""SELECT sample_index, {inputs.sql_match_label('answer', 'task_type')} = {inputs.sql_match_label('gold', 'task_type')} AS hit
        FROM answer_forms""",
)
def answers_match(spark, d):
    return inputs.answer_forms(spark, d).select(
        "sample_index",
        matching.answers_match(F.col("answer"), F.col("gold"), F.col("task_type")).alias("hit"),
    )


@query(
    "math_equal",
    """SELECT sample_index, CASE WHEN coalesce(answer, '') = '' OR gold = '' THEN coalesce(answer, '') = gold
              WHEN number IS NOT NULL AND gold_number IS NOT NULL THEN abs(number - gold_number) < 1e-6
              ELSE form = 5 AND other = 2 END AS hit FROM math_forms""",
)
def math_equal(spark, d):
    return inputs.math_forms(spark, d).select(
        "sample_index", matching.math_equal(F.col("answer"), F.col("gold")).alias("hit")
    )


STORED_SQL = """
SELECT * FROM ballots WHERE NOT (sample_index % 113 = 2 AND round = 3)
UNION ALL SELECT * FROM ballots WHERE sample_index % 109 = 11 AND round = 0"""
CHECKED = [
    *["accuracy", "majority_coverage", "unanimous_rate", "oracle_any_role_accuracy", "parse_rate"],
    *[f"{r}_accuracy" for r in fusion.ROLES],
    *[f"{p}_{k}" for p in ("direct_evidence", "direct_verification", "evidence_verification") for k in ("agree", "agree_correct")],
]
PLANTED = {
    "accuracy": "CASE WHEN st.dataset = 'bbh' AND round = 2 THEN 0.01 ELSE 0 END",
    "parse_rate": "CASE WHEN round = 1 THEN 1e-13 ELSE 0 END",
    "direct_evidence_agree": "CASE WHEN st.dataset = 'arc' AND round = 4 THEN 1 ELSE 0 END",
}
AUDIT_SQL = f"""
WITH s AS MATERIALIZED ({STORED_SQL}),
counted AS (SELECT dataset, round, count(*) AS decisions, count(*) FILTER (WHERE sample_index % 101 = 7 AND final IS NOT NULL) AS vote_mismatches,
                   count(*) FILTER (WHERE sample_index % 103 = 5) AS majority_mismatches, count(*) FILTER (WHERE sample_index % 107 = 3) AS correct_mismatches,
                   0::BIGINT AS invalid_gold, count(*) FILTER (WHERE coalesce(final = gold, false)) AS correct,
                   count(*) FILTER (WHERE majority) AS majority, count(*) FILTER (WHERE unanimous) AS unanimous FROM s GROUP BY ALL),
re AS ({round_metrics_sql("dataset, round", "s", pairs=True)}),
st AS ({round_metrics_sql("dataset, round", "ballots", pairs=True)}),
ids AS (SELECT dataset, count(*) AS samples, count(*) FILTER (WHERE sample_index % 109 = 11) AS duplicate_ids,
               count(*) FILTER (WHERE sample_index % 113 = 2) AS broken_rounds FROM samples GROUP BY ALL)
SELECT dataset, round, decisions, vote_mismatches, majority_mismatches, correct_mismatches, invalid_gold, c.correct, majority, unanimous,
       {len(CHECKED)} AS aggregate_checks,
       {" + ".join(f"CASE WHEN abs(re.{n} - (st.{n} + {PLANTED.get(n, '0')})) <= 1e-12 THEN 0 ELSE 1 END" for n in CHECKED)} AS aggregate_mismatches,
       ids.samples, duplicate_ids, broken_rounds
FROM counted c JOIN re USING (dataset, round) JOIN st USING (dataset, round) JOIN ids USING (dataset)"""


@query("decision_audit", AUDIT_SQL)
def decision_audit(spark, d):
    """Stored decisions, ids, rounds and metrics with planted errors; the audit must find each one."""
    index, number, name = F.col("sample_index"), F.col("round"), F.col("dataset")
    rows = ranking.staged(decided(spark, d), "decided")  # read for the audit, the ids and the recorded metrics
    stored = rows.select(
        "dataset", "sample_index", "round", "task_type", F.col("gold").alias("gold_answer"),
        *[f"vote_{r}" for r in fusion.ROLES],
        F.when(index % 101 != 7, F.col("decision.answer")).alias("stored_answer"),
        (F.col("decision.majority_reached") != (index % 103 == 5)).alias("stored_majority"),
        (F.col("decision_correct") != (index % 107 == 3)).alias("stored_correct"),
    )
    lost = (index % 113 == 2) & (number == 3)
    stored = stored.filter(~lost).unionByName(stored.filter((index % 109 == 11) & (number == 0)))
    recorded = fusion.fusion_metrics(rows, ["dataset", "round"], pairs=True).withColumns(
        {
            "accuracy": F.col("accuracy") + F.when((name == "bbh") & (number == 2), 0.01).otherwise(0.0),
            "parse_rate": F.col("parse_rate") + F.when(number == 1, 1e-13).otherwise(0.0),
            "direct_evidence_agree": F.col("direct_evidence_agree") + F.when((name == "arc") & (number == 4), 1).otherwise(0),
        }
    )
    audited = audit.decision_audit(stored, ["dataset", "round"])
    checked = audit.aggregate_checks(audited, recorded, ["dataset", "round"])
    ids = audit.identity_problems(stored, ["dataset"], "sample_index", 5)
    return checked.join(ids, "dataset").select(
        "dataset", "round", "decisions", "vote_mismatches", "majority_mismatches", "correct_mismatches", "invalid_gold", "correct",
        "majority", "unanimous", "aggregate_checks", "aggregate_mismatches", "samples", "duplicate_ids", "broken_rounds",
    )
