"""Audit of generation lengths through histograms of token counts.

A histogram has at most one row per limit and token count, so everything
after the first (pre-combined) count runs on tiny tables whatever the skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.operators.records import length_truncated

# Rates that warn and fail, and the advice grid.
WARN_RATE = 0.001
FAIL_RATE = 0.01
QUANTUM = 64
HEADROOM = 1.25


def with_length_flag(rows: DataFrame) -> DataFrame:
    return rows.withColumn(
        "length_finished",
        length_truncated(F.col("finish_reason"), F.col("generated_tokens"), F.col("max_tokens")),
    )


def histogram(rows: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """outputs and length_finished per limit and token count (NULL: unknown)."""
    keys = [*(groups or []), "max_tokens", "generated_tokens"]
    return with_length_flag(rows).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("outputs"), F.count_if("length_finished").alias("length_finished")
    )


def merge(partials: DataFrame) -> DataFrame:
    """Add up partial histograms."""
    return partials.groupBy("max_tokens", "generated_tokens").agg(
        F.sum("outputs").alias("outputs"), F.sum("length_finished").alias("length_finished")
    )


def delta(after: DataFrame, before: DataFrame) -> DataFrame:
    """after - before, never below zero; rows without new outputs vanish."""
    signed = after.select("max_tokens", "generated_tokens", "outputs", "length_finished").unionByName(
        before.select(
            "max_tokens", "generated_tokens", (-F.col("outputs")).alias("outputs"),
            (-F.col("length_finished")).alias("length_finished"),
        )
    )
    clipped = merge(signed)
    return clipped.select(
        "max_tokens",
        "generated_tokens",
        F.greatest("outputs", F.lit(0)).alias("outputs"),
        F.greatest("length_finished", F.lit(0)).alias("length_finished"),
    ).filter("outputs > 0")


def group_totals(hist: DataFrame) -> DataFrame:
    """Per limit: outputs, length_finished, token total and observed outputs."""
    tokens = F.col("generated_tokens").cast("bigint") * F.col("outputs")
    return hist.groupBy("max_tokens").agg(
        F.sum("outputs").alias("outputs"),
        F.sum("length_finished").alias("length_finished"),
        F.coalesce(F.sum(tokens), F.lit(0)).alias("generated_tokens_total"),
        F.sum(F.when(F.col("generated_tokens").isNotNull(), F.col("outputs")).otherwise(0))
        .alias("generated_tokens_observed"),
    )


def percentiles(hist: DataFrame) -> DataFrame:
    """Nearest-rank p50 / p95 / p99, mean, maximum and truncation rate per
    limit and overall (limit NULL)."""
    overall = merge(hist.withColumn("max_tokens", F.lit(None).cast("int")))
    both = merge(hist).unionByName(overall)
    known = F.when(F.col("generated_tokens").isNotNull(), F.col("outputs")).otherwise(0)
    # at most one row per token count in a window
    upto = Window.partitionBy("max_tokens").orderBy(F.col("generated_tokens").asc_nulls_first())
    whole = Window.partitionBy("max_tokens")
    ranked = (
        both.withColumn("__known", known)
        .withColumn("__seen", F.sum("__known").over(upto))
        .withColumn("__all", F.sum("__known").over(whole))
    )

    def quantile(q: float):
        target = F.greatest(F.lit(1), F.ceil(F.col("__all") * q))
        return F.min(F.when(F.col("__seen") >= target, F.col("generated_tokens")))

    tokens = F.col("generated_tokens").cast("bigint") * F.col("outputs")
    return ranked.groupBy("max_tokens").agg(
        F.sum("outputs").alias("outputs"),
        F.sum("length_finished").alias("length_finished"),
        (F.sum("length_finished") / F.sum("outputs")).alias("length_truncation_rate"),
        F.try_divide(F.sum(tokens), F.sum("__known")).alias("generated_tokens_mean"),
        quantile(0.50).alias("generated_tokens_p50"),
        quantile(0.95).alias("generated_tokens_p95"),
        quantile(0.99).alias("generated_tokens_p99"),
        F.max("generated_tokens").alias("generated_tokens_max"),
    )


def assessment(
    summary: DataFrame,
    warn: float = WARN_RATE,
    fail: float = FAIL_RATE,
    max_model_len: int | None = None,
) -> DataFrame:
    """pass / warn / fail by rate and an advised limit where outputs were cut."""
    rate, limit = F.col("length_truncation_rate"), F.col("max_tokens")
    p99 = F.coalesce(F.col("generated_tokens_p99"), limit)
    wanted = F.greatest(
        (limit + QUANTUM).cast("double"), limit * F.lit(HEADROOM), p99 * F.lit(HEADROOM)
    )
    advised = F.ceil(wanted / QUANTUM) * QUANTUM
    if max_model_len is not None:
        advised = F.least(advised, F.lit(max(1, max_model_len - 1)))
    some = F.col("outputs") > 0
    return summary.withColumn(
        "status", F.when((rate >= fail) & some, "fail").when((rate >= warn) & some, "warn").otherwise("pass")
    ).withColumn(
        "recommended_max_tokens",
        F.when(F.col("length_finished") > 0, advised).otherwise(limit).cast("bigint"),
    )


def enforce(summary: DataFrame, fail_on_excess: bool) -> None:
    """Raise when the overall row has status fail."""
    if not fail_on_excess:
        return
    bad = summary.filter(F.col("max_tokens").isNull() & (F.col("status") == "fail")).head()
    if bad is not None:
        raise RuntimeError(f"length truncation rate {bad['length_truncation_rate']} is too high")
