"""Preference pairs: candidate rewards, selection rules, pairs and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.names import PIPELINE
from plenum.functions.matching import answers_match
from plenum.functions.text import present, ratio, strip
from plenum.operators.ranking import match_groups

# Candidate names, rules and drop reasons of the pair tables.
CANDIDATES = ("natural", "guided_positive", "guided_negative")
POSITIVE_CASE = "guided_positive_over_natural"
NEGATIVE_CASE = "natural_over_guided_negative"
BELOW_THRESHOLD = "neither_eq5_delta_reached_epsilon"
EMPTY_CANDIDATE = "empty_candidate_response"
IDENTICAL_TEXT = "identical_chosen_rejected"
PAIR_RULE = "paper_eq5_if_elif"
EPSILON = 0.6
PAIR_ROUNDS = 4


def stack_candidates(rounds: DataFrame, keep: list[str], field: str = "candidates") -> DataFrame:
    """Map of candidates to one row per candidate, in the fixed order.

    A map with a missing or an extra candidate is an error.
    """
    keys = F.map_keys(field)
    exact = (F.size(keys) == len(CANDIDATES)) & (
        F.size(F.array_except(F.array(*[F.lit(c) for c in CANDIDATES]), keys)) == 0
    )
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("cand_idx"), F.lit(c).alias("candidate"), F.col(field)[c].alias("value"))
            for i, c in enumerate(CANDIDATES)
        ]
    )
    checked = F.when(exact, rows).otherwise(F.raise_error(F.lit("invalid candidate keys")))
    return rounds.select(*keep, F.explode(checked).alias("__c")).select(
        *keep, "__c.cand_idx", "__c.candidate", "__c.value"
    )


def candidates_wide(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per key with a struct column per candidate (inverse of stacking)."""
    return rows.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("candidate") == c, F.struct(*values))).alias(c)
            for c in CANDIDATES
        ]
    )


def rollout_rewards(
    rollouts: DataFrame, keys: list[str], expected: int, candidates: DataFrame | None = None
) -> DataFrame:
    """Share of correct rollouts per candidate, which must have ``expected`` of them.

    Counting is combined before the shuffle, so a hot key costs nothing extra.
    """
    counted = rollouts.groupBy(*keys).agg(
        F.count_if("correct").alias("correct_count"), F.count(F.lit(1)).alias("rollout_count")
    )
    if candidates is not None:
        # a merge join: sizes guessed before grids are expanded would broadcast millions of rows
        counted = candidates.select(*keys).join(counted.hint("merge"), keys, "left").na.fill(
            0, ["correct_count", "rollout_count"]
        )
    complete = F.col("rollout_count") == expected
    message = F.concat(
        F.lit("candidate has "), F.col("rollout_count").cast("string"), F.lit(f" rollouts, not {expected}")
    )
    reward = F.col("correct_count").cast("double") / F.lit(float(expected))
    return counted.withColumn("reward", F.when(complete, reward).otherwise(F.raise_error(message)))


def mean_reward(records: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Mean 0/1 match recomputed from the answer text; 0 without records."""
    hit = answers_match(F.col("answer"), F.col("gold"), F.col("task_type")).cast("double")
    scored = records.groupBy(*on).agg(F.avg(hit).alias("reward"))
    return keys.join(scored, on, "left").withColumn("reward", F.coalesce("reward", F.lit(0.0)))


def rewards_wide(rewards: DataFrame, keys: list[str]) -> DataFrame:
    """Rewards of the three candidates side by side, from doubles only."""
    return rewards.groupBy(*keys).agg(
        *[F.max(F.when(F.col("candidate") == c, F.col("reward"))).alias(c) for c in CANDIDATES]
    )


def rewards_from_rollouts(rollouts: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Rollouts straight to the three rewards: one aggregation, one shuffle."""
    def tally(c: str) -> Column:
        return F.count_if((F.col("candidate") == c) & F.col("correct")).alias(f"__{c}")

    def size(c: str) -> Column:
        return F.count_if(F.col("candidate") == c).alias(f"__{c}_n")

    counted = rollouts.groupBy(*keys).agg(
        *[tally(c) for c in CANDIDATES], *[size(c) for c in CANDIDATES]
    )

    def reward(c: str) -> Column:
        return F.when(
            F.col(f"__{c}_n") == expected, F.col(f"__{c}").cast("double") / float(expected)
        ).otherwise(F.raise_error(F.lit(f"candidate {c} has not {expected} rollouts")))

    return counted.select(*keys, *[reward(c).alias(c) for c in CANDIDATES])


def _checked(reward: str) -> Column:
    value = F.col(reward)
    return F.when(value.between(0.0, 1.0), value).otherwise(
        F.raise_error(F.lit(f"{reward} reward must be in [0, 1]"))
    )


def select_pairs(rewards: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """The ordered rule: guided-positive first, then guided-negative, else drop.

    Double arithmetic on purpose: 0.9 - 0.3 reaches 0.6.
    """
    if not 0.0 <= epsilon <= 1.0:
        raise ValueError(f"epsilon must be in [0, 1], got {epsilon}")
    plus = _checked("guided_positive") - F.col("natural")
    minus = _checked("natural") - _checked("guided_negative")
    case = F.when(F.col("delta_positive") >= epsilon, POSITIVE_CASE).when(
        F.col("delta_negative") >= epsilon, NEGATIVE_CASE
    )
    passed = F.col("case_type").isNotNull()
    return (
        rewards.withColumn("delta_positive", plus)
        .withColumn("delta_negative", minus)
        .withColumn("epsilon", F.lit(float(epsilon)))
        .withColumn("case_type", case)
        .withColumn("chosen_key", F.when(F.col("case_type") == POSITIVE_CASE, "guided_positive").when(passed, "natural"))
        .withColumn("rejected_key", F.when(F.col("case_type") == POSITIVE_CASE, "natural").when(passed, "guided_negative"))
        .withColumn("selected", passed)
        .withColumn("eq5_threshold_passed", passed)
        .withColumn("drop_reason", F.when(~passed, BELOW_THRESHOLD))
    )


def with_texts(selected: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the candidates of the round as one struct column per candidate.

    The job fails for a rewarded round whose candidate texts are missing: to
    leave it out would shrink the totals without a word.
    """
    wide = candidates_wide(candidates, keys, ["prompt", "response"]).select(
        *keys, *[F.col(c).alias(f"text_{c}") for c in CANDIDATES]
    )
    # a merge join: sizes guessed before grids are expanded would broadcast millions of texts
    joined = selected.join(wide.hint("merge"), keys, "left")
    there = F.lit(True)
    for c in CANDIDATES:
        there = there & F.col(f"text_{c}").isNotNull()
    message = F.concat(F.lit("a rewarded round has no candidate texts: "), F.to_json(F.struct(*keys)))
    return joined.filter(F.when(there, True).otherwise(F.raise_error(message).cast("boolean")))


def _text_of(key: str, field: str) -> Column:
    value = F.lit(None).cast("string")
    for c in CANDIDATES:
        value = F.when(F.col(key) == c, F.col(f"text_{c}.{field}")).otherwise(value)
    return value


def drop_invalid(selected: DataFrame) -> DataFrame:
    """Drop rounds with a blank candidate first, then pairs of equal texts."""
    blank = F.filter(
        F.array(*[F.when(~present(F.col(f"text_{c}.response")), F.lit(c)) for c in CANDIDATES]),
        lambda k: k.isNotNull(),
    )
    chosen, rejected = _text_of("chosen_key", "response"), _text_of("rejected_key", "response")
    empty = F.size("invalid_candidate_keys") > 0
    same = F.col("selected") & (strip(chosen) == strip(rejected))
    return (
        selected.withColumn("invalid_candidate_keys", blank)
        .withColumn(
            "drop_reason",
            F.when(empty, EMPTY_CANDIDATE).when(same, IDENTICAL_TEXT).otherwise(F.col("drop_reason")),
        )
        .withColumn("selected", F.col("drop_reason").isNull())
    )


def materialize_pairs(
    selected: DataFrame, agent: str, iteration: int, rollouts: int, prompt_version: Column | str, pipeline: str = PIPELINE
) -> DataFrame:
    """Pair rows; both completions share the natural prompt."""
    if agent not in ("actor", "critic"):
        raise ValueError(f"agent must be actor or critic, got {agent!r}")
    version = F.lit(prompt_version) if isinstance(prompt_version, str) else prompt_version
    metadata = F.struct(
        F.lit(1).alias("schema_version"),
        F.lit(pipeline).alias("pipeline"),
        F.lit(agent).alias("agent"),
        F.lit(iteration).alias("iteration"),
        "sample_id",
        F.col("sample_index").cast("bigint").alias("sample_index"),
        F.col("round").cast("int").alias("round"),
        "case_type",
        F.col("chosen_key").alias("chosen_candidate"),
        F.col("rejected_key").alias("rejected_candidate"),
        F.struct(*CANDIDATES).alias("rewards"),
        F.struct(
            F.col("delta_positive").alias("guided_positive_minus_natural"),
            F.col("delta_negative").alias("natural_minus_guided_negative"),
        ).alias("deltas"),
        "epsilon",
        F.lit(rollouts).alias("reward_rollouts"),
        F.lit(PAIR_RULE).alias("pair_rule"),
        F.lit("natural_prompt").alias("dpo_prompt_source"),
        version.alias("prompt_version"),
    )
    return selected.filter("selected").select(
        F.col("text_natural.prompt").alias("prompt"),
        _text_of("chosen_key", "response").alias("chosen"),
        _text_of("rejected_key", "response").alias("rejected"),
        metadata.alias("metadata"),
    )


def preference_rounds(
    rollouts: DataFrame, candidates: DataFrame, keys: list[str], expected: int, epsilon: float = EPSILON
) -> DataFrame:
    """Every round with its rewards, texts and the final selection."""
    rewards = rewards_from_rollouts(rollouts, keys, expected)
    return drop_invalid(with_texts(select_pairs(rewards, epsilon), candidates, keys))


def delta_pairs(rows: DataFrame, keep: list[str], prefix: str, epsilon: float) -> DataFrame:
    """Older rule: two independent tests, so a round may give two pairs.

    ``rows`` carries the three rewards and a usable_* flag per guided candidate.
    """
    def passes(delta: Column) -> Column:
        return (delta > 0.0) & (delta >= epsilon)

    def pair(case: str, chosen: str, rejected: str) -> Column:
        return F.struct(
            F.lit(case).alias("case_type"),
            F.lit(chosen).alias("chosen_candidate"),
            F.lit(rejected).alias("rejected_candidate"),
            F.col(chosen).alias("reward_chosen"),
            F.col(rejected).alias("reward_rejected"),
            (F.col(chosen) - F.col(rejected)).alias("reward_delta"),
        )

    up = F.col("usable_positive") & passes(F.col("guided_positive") - F.col("natural"))
    down = F.col("usable_negative") & passes(F.col("natural") - F.col("guided_negative"))
    both = F.array(
        F.when(up, pair(f"{prefix}_dy", "guided_positive", "natural")),
        F.when(down, pair(f"{prefix}_dny", "natural", "guided_negative")),
    )
    return rows.select(
        *keep, F.explode(F.filter(both, lambda p: p.isNotNull())).alias("__p")
    ).select(*keep, "__p.*")


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Totals by nothing, case and round: section, name, pairs, samples."""
    case = F.coalesce(F.col("case_type"), F.lit("unknown"))
    # a round of 0 counts as unknown as well
    round_ = F.when(F.coalesce(F.col("round"), F.lit(0)) == 0, "unknown").otherwise(
        F.col("round").cast("string")
    )
    named = pairs.select(
        case.alias("case_type"),
        round_.alias("round_name"),
        F.nullif(F.col("sample_id"), F.lit("")).alias("sample_id"),
    )
    sets = named.groupingSets(
        [[], [F.col("case_type")], [F.col("round_name")]], F.col("case_type"), F.col("round_name")
    ).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.countDistinct("sample_id").alias("samples_with_pairs"),
        F.grouping("case_type").alias("__c"),
        F.grouping("round_name").alias("__r"),
    )
    section = (
        F.when((F.col("__c") == 1) & (F.col("__r") == 1), "total")
        .when(F.col("__c") == 0, "case")
        .otherwise("round")
    )
    return sets.select(
        section.alias("section"),
        F.coalesce("case_type", "round_name", F.lit("all")).alias("name"),
        "pairs",
        "samples_with_pairs",
    )


def selection_summary(rounds: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of all, selected, dropped and threshold-passing rounds."""
    known = rounds.filter(F.col("selected").isNotNull())

    def dropped(reason: str) -> Column:
        return F.count_if(~F.col("selected") & (F.col("drop_reason") == reason))

    return known.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total_rounds"),
        F.count_if("selected").alias("selected_rounds"),
        F.count_if(~F.col("selected")).alias("dropped_rounds"),
        F.count_if("eq5_threshold_passed").alias("threshold_passed_rounds"),
        dropped(BELOW_THRESHOLD).alias(BELOW_THRESHOLD),
        dropped(EMPTY_CANDIDATE).alias(EMPTY_CANDIDATE),
        dropped(IDENTICAL_TEXT).alias(IDENTICAL_TEXT),
    )


def preference_metrics(
    samples: DataFrame, rounds: DataFrame, source: str = "source_sample_id", pair_rounds: int = PAIR_ROUNDS
) -> DataFrame:
    """One row: samples, distinct sources, maximum pairs and the pair yield."""
    base = samples.agg(
        F.count(F.lit(1)).alias("samples"),
        F.countDistinct(F.coalesce(F.col(source), F.col("sample_id"))).alias("unique_samples"),
    )
    both = base.unionByName(selection_summary(rounds, []), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns]).select(
        "samples",
        "unique_samples",
        (F.col("samples") * pair_rounds).alias("maximum_pairs"),
        F.col("selected_rounds").alias("total_pairs"),
        ratio(F.col("selected_rounds"), F.col("samples") * pair_rounds).alias("pair_yield"),
        "dropped_rounds",
        "threshold_passed_rounds",
    )


def pair_counts(trajectories: DataFrame, pairs: DataFrame, key: str = "sample_id") -> DataFrame:
    """Selected pairs per trajectory, zero included."""
    counted = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("selected_pair_count"))
    return trajectories.join(counted, key, "left").withColumn(
        "selected_pair_count", F.coalesce("selected_pair_count", F.lit(0))
    )


def agent_quality(pairs: DataFrame, agents: DataFrame, cases: list[str]) -> DataFrame:
    """Pairs in all and by case per agent; agents without pairs show zeros."""
    counted = pairs.groupBy("agent").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.coalesce(F.col("case_type"), F.lit("unknown")) == c).alias(c) for c in cases],
    )
    return agents.join(counted, "agent", "left").na.fill(0, ["total", *cases])


def previous_state(
    rows: DataFrame, keys: list[str], round_: str, state: str, initial: str, width: int | None = None
) -> DataFrame:
    """State before a round: the last known state of earlier rounds, else the
    initial one.

    Dialogues of a few rounds need one window.  With ``width`` the rounds are
    cut into ranges of that many, so a key with very many rounds is shared by
    many tasks: the last state of earlier ranges comes from a small aggregate.
    """
    whole = Window.partitionBy(*keys).orderBy(round_).rowsBetween(Window.unboundedPreceding, -1)
    if width is None:
        known = F.last(state, ignorenulls=True).over(whole)
        return rows.withColumn("previous", F.coalesce(known, F.col(initial)))
    ranged = rows.withColumn("__range", F.floor(F.col(round_) / width))
    at = F.when(F.col(state).isNotNull(), F.col(round_))
    ends = ranged.groupBy(*keys, "__range").agg(F.max_by(state, at).alias("__end"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(
        *keys, "__range", F.last("__end", ignorenulls=True).over(earlier).alias("__before")
    )
    inside = Window.partitionBy(*keys, "__range").orderBy(round_).rowsBetween(Window.unboundedPreceding, -1)
    joined = match_groups(ranged, before, [*keys, "__range"])
    known = F.coalesce(F.last(state, ignorenulls=True).over(inside), F.col("__before"), F.col(initial))
    return joined.withColumn("previous", known).drop("__range", "__before")
