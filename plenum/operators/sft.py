"""Balanced fine-tuning rows: eligibility, selection, balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.text import flag, present
from plenum.operators.fusion import ROLES

# Fixed value: how the rows were chosen.
SELECTION_RULE = "one_correct_per_role_on_common_sample_intersection"


def eligible(candidates: DataFrame) -> DataFrame:
    """Correct, visible and not cut off."""
    return candidates.filter(
        flag(F.col("correct")) & present(F.col("response")) & ~flag(F.col("truncated"))
    )


def priority_of(value: Column, ordered: Sequence[float]) -> Column:
    """Position in the configured list (not the numeric order)."""
    return F.array_position(F.array(*[F.lit(float(t)) for t in ordered]), value.cast("double")) - 1


def first_by_priority(
    rows: DataFrame, keys: list[str], priority: Column, values: list[str]
) -> DataFrame:
    """One row per key with the lowest priority; no sort, no window."""
    ranked = rows.withColumn("__p", priority)
    best = F.min_by(F.struct(*values), F.col("__p")).alias("__best")
    return ranked.groupBy(*keys).agg(best).select(*keys, "__best.*")


def common_samples(rows: DataFrame, sample: str, roles: Sequence[str] = ROLES) -> DataFrame:
    """Samples that have a row for every role."""
    seen = rows.filter(F.col("role").isin(*roles)).groupBy(sample)
    has = [F.bool_or(F.col("role") == r).alias(r) for r in roles]
    everywhere = F.lit(True)
    for r in roles:
        everywhere = everywhere & F.col(r)
    return seen.agg(*has).filter(everywhere).select(sample)


def matched_rows(
    candidates: DataFrame,
    temperatures: Sequence[float],
    roles: Sequence[str] = ROLES,
    values: Sequence[str] = ("sample_id", "temperature", "prompt_version", "prompt", "response", "answer"),
) -> DataFrame:
    """One correct target per role, only for samples where all roles have one.

    All roles of a sample are picked in one aggregation: one shuffle, no join.
    """
    ranked = eligible(candidates).withColumn("__p", priority_of(F.col("temperature"), temperatures))

    def best(role: str) -> Column:
        row = F.struct(F.lit(role).alias("role"), *values)
        return F.min_by(row, F.when(F.col("role") == role, F.col("__p"))).alias(role)

    def found(role: str) -> Column:
        return F.bool_or(F.col("role") == role).alias(f"__has_{role}")

    per_sample = ranked.groupBy("sample_index").agg(
        *[best(r) for r in roles], *[found(r) for r in roles]
    )
    complete = F.lit(True)
    for r in roles:
        complete = complete & F.col(f"__has_{r}")
    return (
        per_sample.filter(complete)
        .select("sample_index", F.explode(F.array(*roles)).alias("__r"))
        .select("sample_index", "__r.*", F.lit(SELECTION_RULE).alias("selection_rule"))
    )


def pair_rows(pairs: DataFrame) -> DataFrame:
    """The narrow schema of preference training; blank texts are left out."""
    keep = present(F.col("prompt")) & present(F.col("chosen")) & present(F.col("rejected"))
    return pairs.filter(keep).select("prompt", "chosen", "rejected")
