"""Re-deriving stored decisions and comparing numbers with a tolerance."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.functions.matching import audit_label
from plenum.functions.text import flag
from plenum.operators.fusion import FALLBACK_ROLE, ROLES

# Task types the audit accepts.
AUDITED_TASKS = ("yes_no", "multiple_choice", "mixed")
# Tolerances of the published comparisons.
EXACT_TOLERANCE = 5e-12
POINT_TOLERANCE = 0.0051
DECISION_TOLERANCE = 1e-12


def rederive(stored: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """Add the label, majority flag and correctness that the votes imply."""
    task = F.when(F.col("task_type").isin(*AUDITED_TASKS), F.col("task_type")).otherwise(
        F.raise_error(F.lit("task type is not audited"))
    )
    out = stored.withColumn("__gold", audit_label(F.col("gold_answer"), task))
    for role in roles:
        out = out.withColumn(f"label_{role}", audit_label(F.col(f"vote_{role}"), task))
    a, b, c = (F.col(f"label_{r}") for r in roles)
    ab, ac, bc = flag(a == b), flag(a == c), flag(b == c)
    answer = F.when(ab | ac, a).when(bc, b).otherwise(F.col(f"label_{FALLBACK_ROLE}"))
    return (
        out.withColumn("answer", answer)
        .withColumn("majority", ab | ac | bc)
        .withColumn("unanimous", ab & bc)
        .withColumn("correct", flag(F.col("answer") == F.col("__gold")))
        .withColumn("stored_label", audit_label(F.col("stored_answer"), task))
    )


# Stored rates that must follow from the re-derived counts.
AUDITED_RATES = {
    "accuracy": "correct", "majority_coverage": "majority", "unanimous_rate": "unanimous", "oracle_any_role_accuracy": "oracle", "parse_rate": "parsed",
}


def decision_audit(stored: DataFrame, cell: list[str], roles: Sequence[str] = ROLES) -> DataFrame:
    """Mismatch counters and re-derived totals per cell, in one aggregation."""
    def differs(stored_name: str, name: str) -> Column:
        return F.count_if(~F.col(stored_name).eqNullSafe(F.col(name)))

    right = {r: flag(F.col(f"label_{r}") == F.col("__gold")) for r in roles}
    oracle = F.lit(False)
    for hit in right.values():
        oracle = oracle | hit
    agreements = []
    for left, other in combinations(roles, 2):
        agree = flag(F.col(f"label_{left}") == F.col(f"label_{other}"))
        agreements.append(F.count_if(agree).alias(f"{left}_{other}_agree"))
        agreements.append(F.count_if(agree & right[left]).alias(f"{left}_{other}_agree_correct"))

    return (
        rederive(stored)
        .groupBy(*cell)
        .agg(
            F.count(F.lit(1)).alias("decisions"),
            differs("stored_label", "answer").alias("vote_mismatches"),
            differs("stored_majority", "majority").alias("majority_mismatches"),
            differs("stored_correct", "correct").alias("correct_mismatches"),
            F.count_if(F.col("__gold").isNull()).alias("invalid_gold"),
            F.count_if("correct").alias("correct"),
            F.count_if("majority").alias("majority"),
            F.count_if("unanimous").alias("unanimous"),
            F.count_if(F.col("answer").isNotNull()).alias("parsed"),
            F.count_if(oracle).alias("oracle"),
            *[F.count_if(hit).alias(f"{r}_correct") for r, hit in right.items()],
            *agreements,
        )
    )


def aggregate_checks(audited: DataFrame, recorded: DataFrame, cell: list[str], roles: Sequence[str] = ROLES) -> DataFrame:
    """Add how many stored metrics were compared, and how many differ from the re-derived counts.

    Rates may differ by ``DECISION_TOLERANCE``, pair counts not at all; a cell
    without stored metrics fails in all of them.
    """
    rates = AUDITED_RATES | {f"{r}_accuracy": f"{r}_correct" for r in roles}
    pairs = [f"{a}_{b}_{kind}" for a, b in combinations(roles, 2) for kind in ("agree", "agree_correct")]
    names = [*rates, *pairs]
    known = recorded.select(*cell, *[F.col(n).alias(f"__{n}") for n in names])
    tests = [F.abs(F.col(count) / F.col("decisions") - F.col(f"__{rate}")) <= DECISION_TOLERANCE for rate, count in rates.items()]
    tests += [F.col(p) == F.col(f"__{p}") for p in pairs]
    failed = F.lit(0)
    for test in tests:
        failed = failed + F.when(F.coalesce(test, F.lit(False)), 0).otherwise(1)
    joined = audited.join(known, cell, "left")
    return joined.select(*audited.columns, F.lit(len(names)).alias("aggregate_checks"), failed.alias("aggregate_mismatches"))


def identity_problems(stored: DataFrame, cell: list[str], key: str, rounds: int, round_: str = "round") -> DataFrame:
    """Per cell: ids that occur twice in a round, and ids without exactly the rounds 0..n-1."""
    per_round = stored.groupBy(*cell, key, round_).agg(F.count(F.lit(1)).alias("rows"))
    per_id = per_round.groupBy(*cell, key).agg(
        F.max("rows").alias("most"), F.count(F.lit(1)).alias("n"), F.min(round_).alias("first"), F.max(round_).alias("last")
    )
    whole = (F.col("n") == rounds) & (F.col("first") == 0) & (F.col("last") == rounds - 1)
    return per_id.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("most") > 1).alias("duplicate_ids"), F.count_if(~whole).alias("broken_rounds")
    )


def tolerance_violations(
    observed: DataFrame, expected: DataFrame, keys: list[str], value: str, tolerance: float
) -> DataFrame:
    """Rows missing on a side or further apart than the tolerance."""
    left = observed.select(*keys, F.col(value).alias("observed"))
    right = expected.select(*keys, F.col(value).alias("expected"))
    gap = F.abs(F.col("observed") - F.col("expected"))
    return left.join(right, keys, "full").filter(
        F.coalesce(gap > tolerance, F.lit(True))
    )


def long_form(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Value columns to rows (metric, value)."""
    return df.unpivot(keys, values, "metric", "value")


def section(name: str, compared: DataFrame, failed: DataFrame, values: int = 1) -> DataFrame:
    """One row: the compared rows times ``values``, and the failures."""
    checks = compared.agg((F.count(F.lit(1)) * values).alias("n"), F.lit(0).cast("bigint").alias("bad"))
    bad = failed.agg(F.lit(0).cast("bigint").alias("n"), F.count(F.lit(1)).alias("bad"))
    return checks.unionByName(bad).agg(F.sum("n").alias("checks"), F.sum("bad").alias("failures")).select(
        F.lit(name).alias("section"), "checks", "failures"
    )
