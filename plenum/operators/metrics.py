"""Rates by round, trial and method, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.matching import answers_match
from plenum.functions.text import flag, ratio


def score_counts(rows: DataFrame, groups: list[str]) -> DataFrame:
    """samples, correct, parsed, truncated and the three rates per group."""
    totals = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.count_if(flag(F.col(c))).alias(c) for c in ("correct", "parsed", "truncated")],
    )
    return with_rates(totals)


def with_rates(totals: DataFrame) -> DataFrame:
    n = F.col("samples")
    return totals.select(
        "*",
        ratio(F.col("correct"), n).alias("accuracy"),
        ratio(F.col("parsed"), n).alias("parse_rate"),
        ratio(F.col("truncated"), n).alias("truncation_rate"),
    )


def summarize(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """count, mean, sample std, standard error and 1.96 times that error."""
    count = F.count(value)
    std = F.coalesce(F.stddev_samp(value), F.lit(0.0))
    base = rows.groupBy(*groups).agg(
        count.alias("count"), F.avg(value).alias("mean"), std.alias("sample_std")
    )
    error = F.coalesce(
        F.try_divide(F.col("sample_std"), F.sqrt(F.col("count").cast("double"))), F.lit(0.0)
    )
    return base.withColumn("standard_error", error).withColumn(
        "ci95_normal_half_width", F.col("standard_error") * 1.96
    )


def trial_scores(records: DataFrame, trials: DataFrame, groups: list[str]) -> DataFrame:
    """Scores per trial; a trial without rows scores zero."""
    scored = score_counts(records, groups)
    joined = trials.join(scored, groups, "left")
    return joined.select(
        *groups,
        *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("samples", "correct", "parsed", "truncated")],
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("accuracy", "parse_rate", "truncation_rate")],
    )


def mixed_accuracy(
    labels: DataFrame, predictions: DataFrame, key: str, groups: list[str]
) -> DataFrame:
    """Accuracy with the row's own task type; a missing prediction is wrong
    unless the label is blank too; a missing task type means yes/no."""
    task = F.coalesce(F.col("task_type"), F.lit("yes_no"))
    hit = answers_match(F.col("prediction"), F.col("label"), task)
    joined = labels.join(predictions, key, "left")
    return joined.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(hit).alias("correct"),
        ratio(F.count_if(hit), F.count(F.lit(1))).alias("accuracy"),
    )


def macro_accuracy(cells: DataFrame, model: str, across: str, value: str) -> DataFrame:
    """Unweighted mean per (model, across) plus the mean over models, in points."""
    per_model = cells.groupBy(model, across).agg((F.avg(value) * 100.0).alias("macro_accuracy"))
    overall = per_model.groupBy(across).agg(F.avg("macro_accuracy").alias("macro_accuracy"))
    return per_model.unionByName(
        overall.select(F.lit("Mean").alias(model), across, "macro_accuracy")
    )


def headline(cells: DataFrame) -> DataFrame:
    """Trial 0 when it exists, else the mean; the accuracy may sit under final."""
    zero = F.get(F.filter("trials", lambda t: t["trial"] == 0), F.lit(0))["accuracy"]
    return cells.withColumn(
        "headline", F.coalesce(zero, F.col("mean"), F.col("accuracy"), F.col("final.accuracy"))
    )


def reward_margins(pairs: DataFrame, groups: list[str], places: int = 4) -> DataFrame:
    """Health of the reward signal: margins between chosen and rejected."""
    delta = F.col("reward_delta")
    base = pairs.filter(delta.isNotNull()).groupBy(*groups)

    def rounded(value: Column, name: str) -> Column:
        return F.bround(value, places).alias(name)

    return base.agg(
        F.count(F.lit(1)).alias("count"),
        rounded(F.avg(delta), "delta_mean"),
        rounded(F.median(delta), "delta_median"),
        rounded(F.min(delta), "delta_min"),
        rounded(F.max(delta), "delta_max"),
        rounded(F.avg("reward_chosen"), "chosen_reward_mean"),
        rounded(F.avg("reward_rejected"), "rejected_reward_mean"),
        rounded(F.avg((delta >= 0.5).cast("double")), "robust_fraction_delta_ge_0p5"),
    )


def revision_flow(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Accuracy before and after revision, corrections, harmful flips and pair
    eligibility.  ``rows`` holds nullable booleans: initial, natural,
    guided_positive, guided_negative (NULL: the record is absent)."""
    first, natural = F.col("initial"), F.col("natural")
    plus, minus = F.col("guided_positive"), F.col("guided_negative")

    def tally(condition: Column, name: str) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)

    counts = rows.groupBy(*groups).agg(
        *[F.count(c).alias(f"{c}_total") for c in ("initial", "natural", "guided_positive", "guided_negative")],
        *[tally(F.col(c), f"{c}_correct") for c in ("initial", "natural", "guided_positive", "guided_negative")],
        tally(first & ~natural, "correct_to_wrong"),
        tally(~first & natural, "wrong_to_correct"),
        tally(~first & ~natural, "wrong_to_wrong"),
        (
            F.count_if(natural.isNotNull() & plus.isNotNull())
            + F.count_if(natural.isNotNull() & minus.isNotNull())
        ).alias("actor_pair_eligible_total"),
        tally(plus & ~natural, "actor_pair_dy"),
        tally(natural & ~minus, "actor_pair_dny"),
        tally(natural.isNotNull(), "critic_pair_total"),
    )

    def share(part: str, whole: Column, name: str) -> Column:
        return ratio(F.col(part), whole).alias(name)

    c = F.col
    return counts.select(
        *groups,
        share("initial_correct", c("initial_total"), "actor_initial_accuracy"),
        share("natural_correct", c("natural_total"), "natural_revised_accuracy"),
        share("guided_positive_correct", c("guided_positive_total"), "guided_positive_revised_accuracy"),
        share("guided_negative_correct", c("guided_negative_total"), "guided_negative_revised_accuracy"),
        share("wrong_to_correct", c("wrong_to_correct") + c("wrong_to_wrong"), "critic_correction_rate"),
        share("correct_to_wrong", c("initial_correct"), "harmful_flip_rate"),
        share("actor_pair_dy", c("actor_pair_eligible_total"), "actor_pair_dy_rate"),
        share("actor_pair_dny", c("actor_pair_eligible_total"), "actor_pair_dny_rate"),
        "critic_pair_total",
    )


def rescore_diagnostics(rows: DataFrame, groups: list[str]) -> DataFrame:
    """What a fresh parse changes against the stored answer."""
    def changed(name: str) -> Column:
        return ~F.col(f"stored_{name}").eqNullSafe(F.col(name))

    was, now = flag(F.col("stored_parsed")), flag(F.col("parsed"))
    return rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("completions"),
        F.count_if(changed("answer")).alias("changed_answer"),
        F.count_if(~was & now).alias("recovered_parse"),
        F.count_if(was & ~now).alias("lost_parse"),
        F.count_if(changed("correct")).alias("changed_correct"),
    )
