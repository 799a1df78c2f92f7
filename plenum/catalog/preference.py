"""Rewards, pair selection, pair tables and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from plenum.catalog import inputs
from plenum.catalog.registry import query
from plenum.operators import metrics, preference, records, sft
from plenum.plans import jobs

KEYS = ["sample_id", "sample_index", "round"]
C = preference.CANDIDATES

SELECT_SQL = """
SELECT *, CASE WHEN guided_positive - natural >= 0.6 THEN 'guided_positive_over_natural'
               WHEN natural - guided_negative >= 0.6 THEN 'natural_over_guided_negative' END AS case_type
FROM (SELECT sample_id, sample_index, round, natural::DOUBLE AS natural, guided_positive::DOUBLE AS guided_positive,
             guided_negative::DOUBLE AS guided_negative FROM reward_rows)"""

ROUNDS_SQL = f"""
SELECT *, CASE WHEN bn OR bp OR bm THEN 'empty_candidate_response'
               WHEN case_type IS NULL THEN 'neither_eq5_delta_reached_epsilon'
               WHEN trim(chosen) = trim(rejected) THEN 'identical_chosen_rejected' END AS drop_reason
FROM (SELECT s.*, w.* EXCLUDE (sample_id, round), trim(tn) = '' AS bn, trim(tp) = '' AS bp, trim(tm) = '' AS bm,
             CASE case_type WHEN 'guided_positive_over_natural' THEN tp WHEN 'natural_over_guided_negative' THEN tn END AS chosen,
             CASE case_type WHEN 'guided_positive_over_natural' THEN tn WHEN 'natural_over_guided_negative' THEN tm END AS rejected
      FROM ({SELECT_SQL}) s
      JOIN (SELECT sample_id, round, max(prompt) FILTER (WHERE candidate = 'natural') AS prompt,
                   max(response) FILTER (WHERE candidate = 'natural') AS tn,
                   max(response) FILTER (WHERE candidate = 'guided_positive') AS tp,
                   max(response) FILTER (WHERE candidate = 'guided_negative') AS tm
            FROM candidates GROUP BY ALL) w USING (sample_id, round))"""
# the reason of a threshold miss wins over nothing, a blank text over all
PAIRS_SQL = f"SELECT * FROM ({ROUNDS_SQL}) WHERE drop_reason IS NULL"


def rounds(spark, d):
    return preference.preference_rounds(
        inputs.rollouts(spark, d), inputs.candidates(spark, d), KEYS, inputs.ROLLOUTS
    )


def preference_job(spark, d, agent):
    return jobs.preference_data(inputs.rollouts(spark, d), inputs.candidates(spark, d), agent, 1, inputs.ROLLOUTS, "v1")


def pairs(spark, d, agent="critic"):
    return preference.materialize_pairs(rounds(spark, d), agent, 1, inputs.ROLLOUTS, "v1")


def flat_pairs(df):
    return df.select(
        "prompt", "chosen", "rejected",
        *[F.col(f"metadata.{c}").alias(c) for c in ("sample_id", "sample_index", "round", "case_type")],
    )


@query(
    "stack_candidates",
    "SELECT sample_id, round, cand_idx, candidate, response FROM candidates",
)
def stack_candidates(spark, d):
    wide = preference.candidates_wide(inputs.candidates(spark, d), ["sample_id", "round"], ["response"])
    maps = wide.select(
        "sample_id", "round",
        F.create_map(*[x for c in C for x in (F.lit(c), F.col(f"{c}.response"))]).alias("candidates"),
    )
    return preference.stack_candidates(maps, ["sample_id", "round"]).withColumnRenamed("value", "response")


@query(
    "mc_rollout_reward",
    "SELECT sample_id, round, candidate, correct_count, rollout_count, reward FROM rewards",
)
def mc_rollout_reward(spark, d):
    keys = ["sample_id", "round", "candidate"]
    return preference.rollout_rewards(
        inputs.rollouts(spark, d), keys, inputs.ROLLOUTS, inputs.candidates(spark, d)
    )


@query(
    "mean_reward",
    """SELECT sample_id, coalesce(avg(CASE WHEN coalesce(label, '') = gold THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE role <> 'evidence' OR round > 1), 0) AS reward
       FROM (SELECT *, round AS r FROM completions) GROUP BY sample_id""",
)
def mean_reward(spark, d):
    keys = inputs.samples(spark, d).select("sample_id")
    rows = inputs.votes(spark, d).filter((F.col("role") != "evidence") | (F.col("round") > 1))
    return preference.mean_reward(rows, keys, ["sample_id"])


@query(
    "select_eq5_pair",
    f"""SELECT sample_id, round, natural, guided_positive, guided_negative, guided_positive - natural AS delta_positive,
               natural - guided_negative AS delta_negative, case_type,
               CASE case_type WHEN 'guided_positive_over_natural' THEN 'guided_positive' WHEN 'natural_over_guided_negative' THEN 'natural' END AS chosen_key,
               CASE case_type WHEN 'guided_positive_over_natural' THEN 'natural' WHEN 'natural_over_guided_negative' THEN 'guided_negative' END AS rejected_key,
               case_type IS NOT NULL AS selected FROM ({SELECT_SQL})""",
)
def select_eq5_pair(spark, d):
    rewards = preference.rewards_from_rollouts(inputs.rollouts(spark, d), ["sample_id", "round"], inputs.ROLLOUTS)
    return preference.select_pairs(rewards).drop("epsilon", "eq5_threshold_passed", "drop_reason")


@query(
    "drop_empty_candidates",
    f"""SELECT sample_id, round, concat_ws(',', CASE WHEN bn THEN 'natural' END, CASE WHEN bp THEN 'guided_positive' END,
               CASE WHEN bm THEN 'guided_negative' END) AS invalid_keys, case_type IS NOT NULL AS eq5_threshold_passed
        FROM ({ROUNDS_SQL}) WHERE bn OR bp OR bm""",
)
def drop_empty_candidates(spark, d):
    return (
        rounds(spark, d)
        .filter(F.col("drop_reason") == preference.EMPTY_CANDIDATE)
        .select("sample_id", "round", F.array_join("invalid_candidate_keys", ",").alias("invalid_keys"), "eq5_threshold_passed")
    )


@query(
    "drop_nondistinct",
    f"""SELECT sample_id, round, case_type, chosen, rejected, true AS eq5_threshold_passed
        FROM ({ROUNDS_SQL}) WHERE drop_reason = 'identical_chosen_rejected'""",
)
def drop_nondistinct(spark, d):
    kept = rounds(spark, d).filter(F.col("drop_reason") == preference.IDENTICAL_TEXT)
    return kept.select(
        "sample_id", "round", "case_type", preference._text_of("chosen_key", "response").alias("chosen"),
        preference._text_of("rejected_key", "response").alias("rejected"), "eq5_threshold_passed",
    )


@query(
    "materialize_pairs",
    f"""SELECT prompt, chosen, rejected, sample_id, sample_index, round, case_type FROM ({PAIRS_SQL})""",
)
def materialize_pairs(spark, d):
    return flat_pairs(pairs(spark, d))


@query(
    "job_preference_critic",
    f"""SELECT sample_id, round, natural, guided_positive, guided_negative, case_type, drop_reason IS NULL AS selected, drop_reason
        FROM ({ROUNDS_SQL})""",
)
def job_preference_critic(spark, d):
    audited, _ = preference_job(spark, d, "critic")
    return audited.select("sample_id", "round", *C, "case_type", "selected", "drop_reason")


@query(
    "job_preference_actor",
    f"""SELECT 'actor' AS agent, sample_id, round, case_type, chosen, rejected, 10 AS reward_rollouts,
               'acccollab_original' AS pipeline FROM ({PAIRS_SQL})""",
)
def job_preference_actor(spark, d):
    _, made = preference_job(spark, d, "actor")
    return made.select(
        "metadata.agent", "metadata.sample_id", "metadata.round", "metadata.case_type",
        "chosen", "rejected", "metadata.reward_rollouts", "metadata.pipeline",
    )


@query(
    "pair_summary",
    f"""WITH p AS MATERIALIZED (SELECT * FROM ({PAIRS_SQL}))
        SELECT 'total' AS section, 'all' AS name, count(*) AS pairs, count(DISTINCT sample_id) AS samples_with_pairs FROM p
        UNION ALL SELECT 'case', case_type, count(*), count(DISTINCT sample_id) FROM p GROUP BY case_type
        UNION ALL SELECT 'round', CAST(round AS VARCHAR), count(*), count(DISTINCT sample_id) FROM p GROUP BY round""",
)
def pair_summary(spark, d):
    return preference.pair_summary(flat_pairs(pairs(spark, d)))


@query(
    "selection_summary",
    f"""SELECT round, count(*) AS total_rounds, count(*) FILTER (WHERE drop_reason IS NULL) AS selected_rounds,
               count(drop_reason) AS dropped_rounds, count(case_type) AS threshold_passed_rounds,
               count(*) FILTER (WHERE drop_reason = 'neither_eq5_delta_reached_epsilon') AS neither_eq5_delta_reached_epsilon,
               count(*) FILTER (WHERE drop_reason = 'empty_candidate_response') AS empty_candidate_response,
               count(*) FILTER (WHERE drop_reason = 'identical_chosen_rejected') AS identical_chosen_rejected
        FROM ({ROUNDS_SQL}) GROUP BY round""",
)
def selection_summary(spark, d):
    return preference.selection_summary(rounds(spark, d), ["round"])


@query(
    "preference_metrics",
    f"""SELECT (SELECT count(*) FROM samples) AS samples, (SELECT count(DISTINCT custkey) FROM samples) AS unique_samples,
               (SELECT count(*) FROM samples) * 4 AS maximum_pairs, count(*) FILTER (WHERE drop_reason IS NULL) AS total_pairs,
               count(*) FILTER (WHERE drop_reason IS NULL) / ((SELECT count(*) FROM samples) * 4) AS pair_yield,
               count(drop_reason) AS dropped_rounds, count(case_type) AS threshold_passed_rounds FROM ({ROUNDS_SQL})""",
)
def preference_metrics(spark, d):
    samples = inputs.samples(spark, d).select(
        "sample_id", F.col("custkey").cast("string").alias("source_sample_id")
    )
    return preference.preference_metrics(samples, rounds(spark, d))


@query(
    "pair_counts_per_trajectory",
    f"""SELECT sample_id, coalesce(n, 0) AS selected_pair_count FROM samples
        LEFT JOIN (SELECT sample_id, count(*) AS n FROM ({PAIRS_SQL}) GROUP BY ALL) USING (sample_id)""",
)
def pair_counts(spark, d):
    return preference.pair_counts(
        inputs.samples(spark, d).select("sample_id"), flat_pairs(pairs(spark, d))
    )


# ----------------------------------------------------------------- older rules
# Agents are the roles of the older protocol; usable flags come from the texts.
V1_AGENTS = ("direct", "evidence", "elimination")
V1_SQL = """
SELECT s.sample_id, s.round, ['direct', 'evidence', 'elimination'][1 + s.sample_index % 3] AS agent,
       natural, guided_positive, guided_negative, ok_n, ok_p, ok_m
FROM reward_rows s
JOIN (SELECT sample_id, round, bool_or(usable) FILTER (WHERE candidate = 'natural') AS ok_n,
             bool_or(usable) FILTER (WHERE candidate = 'guided_positive') AS ok_p,
             bool_or(usable) FILTER (WHERE candidate = 'guided_negative') AS ok_m
      FROM (SELECT *, trim(response) <> '' AND NOT truncated AS usable FROM candidates) GROUP BY ALL) USING (sample_id, round)
WHERE ok_n"""
V1_PAIRS_SQL = f"""
SELECT sample_id, round, agent, 'actor_dy' AS case_type, guided_positive AS reward_chosen, natural AS reward_rejected,
       guided_positive - natural AS reward_delta FROM ({V1_SQL}) WHERE ok_p AND guided_positive > natural AND guided_positive - natural >= 0.3
UNION ALL
SELECT sample_id, round, agent, 'actor_dny', natural, guided_negative, natural - guided_negative
FROM ({V1_SQL}) WHERE ok_m AND natural > guided_negative AND natural - guided_negative >= 0.3"""


def v1_pairs(spark, d, epsilon=0.3):
    rewards = preference.rewards_from_rollouts(inputs.rollouts(spark, d), KEYS, inputs.ROLLOUTS)
    flags = inputs.candidates(spark, d).withColumn(
        "usable", records.usable_flag(F.col("response"), F.col("truncated"))
    )
    wide = flags.groupBy("sample_id", "round").agg(
        *[F.bool_or(F.when(F.col("candidate") == c, F.col("usable"))).alias(f"ok_{c}") for c in C]
    )
    agent = F.element_at(F.array(*[F.lit(a) for a in V1_AGENTS]), (F.col("sample_index") % 3 + 1).cast("int"))
    rows = (
        rewards.join(wide, ["sample_id", "round"])
        .filter("ok_natural")
        .withColumn("agent", agent)
        .withColumn("usable_positive", F.col("ok_guided_positive"))
        .withColumn("usable_negative", F.col("ok_guided_negative"))
    )
    return preference.delta_pairs(rows, ["sample_id", "round", "agent"], "actor", epsilon)


@query("reward_delta_pairs", V1_PAIRS_SQL)
def reward_delta_pairs(spark, d):
    return v1_pairs(spark, d).drop("chosen_candidate", "rejected_candidate")


@query(
    "reward_margin_summary",
    f"""SELECT agent, count(*) AS count, round(avg(reward_delta), 4) AS delta_mean, round(median(reward_delta), 4) AS delta_median,
               round(min(reward_delta), 4) AS delta_min, round(max(reward_delta), 4) AS delta_max, round(avg(reward_chosen), 4) AS chosen_reward_mean,
               round(avg(reward_rejected), 4) AS rejected_reward_mean,
               round(count(*) FILTER (WHERE reward_delta >= 0.5) / count(*), 4) AS robust_fraction_delta_ge_0p5
        FROM ({V1_PAIRS_SQL}) GROUP BY agent""",
)
def reward_margin_summary(spark, d):
    return metrics.reward_margins(v1_pairs(spark, d), ["agent"])


@query(
    "pair_quality_by_agent",
    f"""SELECT agent, coalesce(total, 0) AS total, coalesce(dy, 0) AS actor_dy, coalesce(dny, 0) AS actor_dny
        FROM (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'direct' WHEN 1 THEN 'evidence' WHEN 2 THEN 'elimination' ELSE 'judge' END AS agent FROM orders)
        LEFT JOIN (SELECT agent, count(*) AS total, count(*) FILTER (WHERE case_type = 'actor_dy') AS dy,
                          count(*) FILTER (WHERE case_type = 'actor_dny') AS dny FROM ({V1_PAIRS_SQL}) GROUP BY agent) USING (agent)""",
)
def pair_quality(spark, d):
    names = F.array(*[F.lit(a) for a in (*V1_AGENTS, "judge")])
    agents = inputs.table(spark, d, "orders").select(
        F.element_at(names, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("agent")
    ).distinct()
    return preference.agent_quality(v1_pairs(spark, d), agents, ["actor_dy", "actor_dny"])


@query(
    "job_pairs_v1",
    f"""SELECT agent, case_type, round, count(*) AS pairs, count(DISTINCT sample_id) AS samples,
               round(avg(reward_delta), 6) AS mean_delta FROM ({V1_PAIRS_SQL}) GROUP BY ALL""",
)
def job_pairs_v1(spark, d):
    return v1_pairs(spark, d).groupBy("agent", "case_type", "round").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.countDistinct("sample_id").alias("samples"),
        F.round(F.avg("reward_delta"), 6).alias("mean_delta"),
    )


FLOW_SQL = """
SELECT dataset, role, coalesce(max(CASE WHEN round = 0 THEN (label = gold)::INT END), 0) = 1 AS initial,
       CASE WHEN bool_or(k = 9 AND round = 1) THEN NULL ELSE bool_or(coalesce(label = gold, false)) FILTER (WHERE round = 1) END AS natural,
       CASE WHEN bool_or(k = 8 AND round = 2) THEN NULL ELSE bool_or(coalesce(label = gold, false)) FILTER (WHERE round = 2) END AS plus,
       CASE WHEN bool_or(k = 7 AND round = 3) THEN NULL ELSE bool_or(coalesce(label = gold, false)) FILTER (WHERE round = 3) END AS minus
FROM completions GROUP BY dataset, role, sample_index"""


@query(
    "revision_flow_metrics",
    f"""SELECT dataset, role, count(*) FILTER (WHERE initial) / count(initial) AS actor_initial_accuracy,
               count(*) FILTER (WHERE natural) / count(natural) AS natural_revised_accuracy,
               count(*) FILTER (WHERE plus) / count(plus) AS guided_positive_revised_accuracy,
               count(*) FILTER (WHERE minus) / count(minus) AS guided_negative_revised_accuracy,
               count(*) FILTER (WHERE NOT initial AND natural) / count(*) FILTER (WHERE NOT initial AND natural IS NOT NULL) AS critic_correction_rate,
               count(*) FILTER (WHERE initial AND NOT natural) / count(*) FILTER (WHERE initial) AS harmful_flip_rate,
               count(*) FILTER (WHERE plus AND NOT natural) / (count(natural + plus) + count(natural + minus)) AS actor_pair_dy_rate,
               count(*) FILTER (WHERE natural AND NOT minus) / (count(natural + plus) + count(natural + minus)) AS actor_pair_dny_rate,
               count(natural) AS critic_pair_total
        FROM ({FLOW_SQL}) GROUP BY dataset, role""".replace(
        "count(natural + plus)", "count(*) FILTER (WHERE natural IS NOT NULL AND plus IS NOT NULL)"
    ).replace("count(natural + minus)", "count(*) FILTER (WHERE natural IS NOT NULL AND minus IS NOT NULL)"),
)
def revision_flow(spark, d):
    rows = inputs.completions(spark, d)
    hit = F.coalesce(F.col("label") == F.col("gold"), F.lit(False))

    def stage(round_, missing=None):
        value = hit if missing is None else F.when(F.col("k") != missing, hit)
        return F.bool_or(F.when(F.col("round") == round_, value))

    wide = rows.groupBy("dataset", "role", "sample_index").agg(
        stage(0).alias("initial"), stage(1, 9).alias("natural"),
        stage(2, 8).alias("guided_positive"), stage(3, 7).alias("guided_negative"),
    )
    return metrics.revision_flow(wide, ["dataset", "role"])


@query(
    "previous_round_state",
    """SELECT conv_id, turn, coalesce(last_value(CASE WHEN length(text) % 5 > 0 THEN role || ':' || length(text) END IGNORE NULLS)
              OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'start') AS previous
       FROM conversations""",
)
def previous_round_state(spark, d):
    state = F.concat("role", F.lit(":"), F.length("text").cast("string"))
    rows = inputs.table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.length("text") % 5 > 0, state).alias("state"), F.lit("start").alias("initial")
    )
    return preference.previous_state(rows, ["conv_id"], "turn", "state", "initial", width=2).select(
        "conv_id", "turn", "previous"
    )


@query(
    "usable_completion",
    "SELECT sample_id, round, candidate FROM candidates WHERE trim(response) <> '' AND NOT truncated",
)
def usable_completion(spark, d):
    return records.usable(inputs.candidates(spark, d)).select("sample_id", "round", "candidate")


@query(
    "resolve_empty_retries",
    """SELECT sample_id, round, coalesce(min(cand_idx) FILTER (WHERE trim(response) <> ''), max(cand_idx)) AS empty_response_retries,
              count(*) FILTER (WHERE trim(response) <> '') = 0 AS empty_response_exhausted,
              coalesce(arg_min(response, cand_idx) FILTER (WHERE trim(response) <> ''), arg_max(response, cand_idx)) AS response
       FROM (SELECT sample_id, round, cand_idx, CASE WHEN sample_index % 3 = cand_idx THEN response ELSE ' ' END AS response FROM candidates)
       GROUP BY ALL""",
)
def resolve_empty_retries(spark, d):
    attempts = inputs.candidates(spark, d).withColumn(
        "response", F.when(F.col("sample_index") % 3 == F.col("cand_idx"), F.col("response")).otherwise(" ")
    )
    return records.resolve_retries(attempts, ["sample_id", "round"], "cand_idx")


@query(
    "narrow_training_rows",
    f"SELECT prompt, chosen, rejected FROM ({PAIRS_SQL}) WHERE trim(prompt) <> ''",
)
def narrow_training_rows(spark, d):
    return sft.pair_rows(pairs(spark, d))
