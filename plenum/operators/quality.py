"""Contract checks: every check returns its violations as a DataFrame.

The work is aggregates and anti joins on the cluster; ``enforce`` only asks
whether there is a first violation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.names import PIPELINE
from plenum.functions.text import present, strip
from plenum.operators.fusion import ROLES

# Required splits, evaluation sizes, pair rounds and minimum.
REQUIRED_SPLITS = {"mmlu": ("train", "validation", "test")}
DEFAULT_SPLITS = ("train",)
EXPECTED_ROWS = {"boolq": 3270, "sciq": 1000, "bbh": 1260, "arc": 3548, "mmlu": 14042}
PAIR_ROUNDS = (1, 4)
MIN_PAIRS = 256
PROTOCOL = {
    "pipeline": PIPELINE,
    "decision_rule": "single_final_actor_answer",
    "uses_majority_vote": False,
    "uses_judge_fallback": False,
}


class ContractError(RuntimeError):
    """A checked table breaks its contract."""


def enforce(violations: DataFrame, what: str) -> None:
    """Strict mode: raise with the first violation."""
    first = violations.limit(1).head()
    if first is not None:
        raise ContractError(f"{what}: {first.asDict()}")


def required_splits(rows: DataFrame, required: DataFrame) -> DataFrame:
    """Required (dataset, split) pairs without any row."""
    return required.join(rows.select("dataset", "split").distinct(), ["dataset", "split"], "left_anti")


def required_files(files: DataFrame, expected: DataFrame, path: str = "path") -> DataFrame:
    """Expected paths that no scanned row came from."""
    return expected.join(files.select(path).distinct(), path, "left_anti")


def expected_rows(rows: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Groups whose row count differs from the expected one."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("actual"))
    both = expected.join(counted, keys, "full")
    return both.select(
        *keys, "expected", F.coalesce("actual", F.lit(0)).alias("actual")
    ).filter(~F.col("expected").eqNullSafe(F.col("actual")))


def duplicate_ids(rows: DataFrame, key: str, groups: Sequence[str] = ()) -> DataFrame:
    """Blank or repeated ids."""
    counted = rows.groupBy(*groups, key).agg(F.count(F.lit(1)).alias("rows"))
    return counted.filter((F.col("rows") > 1) | ~present(F.col(key).cast("string")))


def rounds_not_contiguous(records: DataFrame, key: str, rounds: str = "rounds", count: int | None = None) -> DataFrame:
    """Records whose rounds are not exactly 0..n-1 in order."""
    found = F.col(rounds)["round"].cast("array<int>")  # compiled, and of a stored table only this field is read
    size = F.size(rounds) if count is None else F.lit(count)
    wanted = F.when(size > 0, F.sequence(F.lit(0), size - 1))
    broken = records.filter(~F.coalesce(found == wanted, F.lit(False)))
    return broken.select(key, F.size(rounds).alias("rounds"))


def coverage(actual: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys without a row (missing) and rows nobody expected (extra)."""
    both = expected.select(*keys, F.lit(1).alias("__want"), F.lit(0).alias("__have")).unionByName(
        actual.select(*keys, F.lit(0).alias("__want"), F.lit(1).alias("__have"))
    )
    # counted in one group-by, not joined: sides that are dealt out by a key alike need no shuffle
    sides = both.groupBy(*keys).agg(F.max("__want").alias("__want"), F.max("__have").alias("__have"))
    unknown = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])  # such a key is equal to none
    wanted, there = F.col("__want") == 1, F.col("__have") == 1
    problems = F.array(
        F.when(wanted & (~there | unknown), F.lit("missing")), F.when(there & (~wanted | unknown), F.lit("extra"))
    )
    return sides.filter(~(wanted & there) | unknown).select(*keys, F.explode(F.array_compact(problems)).alias("problem"))


def coverage_report(violations: DataFrame) -> DataFrame:
    """Every violation, with the count of its side as ``total``."""
    counts = violations.groupBy("problem").agg(F.count(F.lit(1)).alias("total"))
    return violations.join(counts, "problem")


def candidate_grid(
    samples: DataFrame, candidates: DataFrame, temperatures: Sequence[float], roles: Sequence[str] = ROLES
) -> DataFrame:
    """Grid keys that do not have exactly one candidate."""
    keys = ["sample_index", "role", "temperature"]
    wanted = request_grid(samples.select("sample_index"), temperatures, roles).withColumn("__want", F.lit(1))
    have = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    both = wanted.join(have, keys, "full")
    count = F.coalesce(F.col("rows"), F.lit(0))
    return both.select(*keys, count.alias("rows"), F.col("__want").isNotNull().alias("expected")).filter(
        (F.col("rows") != 1) | ~F.col("expected")
    )


def request_grid(
    samples: DataFrame, temperatures: Sequence[float], roles: Sequence[str] = ROLES
) -> DataFrame:
    """samples x roles x temperatures by expanding each row: no join at all."""
    return samples.withColumn("role", F.explode(F.array(*[F.lit(r) for r in roles]))).withColumn(
        "temperature", F.explode(F.array(*[F.lit(float(t)) for t in temperatures]))
    )


def sample_signature(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def alignment(
    rows: DataFrame, keys: list[str], signature: Column, roles: Sequence[str] = ROLES
) -> DataFrame:
    """Keys where a role is missing or repeated, or the sample texts differ."""
    per_role = [F.count_if(F.col("role") == r) for r in roles]
    exact = reduce(lambda a, b: a & b, [c == 1 for c in per_role])
    marked = rows.withColumn("__sig", signature)
    return (
        marked.groupBy(*keys)
        .agg(
            exact.alias("roles_complete"),
            (F.min("__sig") == F.max("__sig")).alias("same_sample"),
            F.count(F.lit(1)).alias("rows"),
        )
        .filter(~F.col("roles_complete") | ~F.col("same_sample"))
    )


def protocol(rows: DataFrame, key: str, allowed: Mapping[str, object] = PROTOCOL) -> DataFrame:
    """Rows with a constant column that is not the allowed value (NULL is not)."""
    wrong = F.array(
        *[F.when(~F.col(name).eqNullSafe(F.lit(value)), F.lit(name)) for name, value in allowed.items()]
    )
    return rows.select(key, F.array_join(F.array_compact(wrong), ",").alias("wrong")).filter("wrong != ''")


def pair_problems(
    pairs: DataFrame, agent: str, iteration: int, allowed: DataFrame, keys: Sequence[str] = ("sample_index", "round")
) -> DataFrame:
    """One row per (pair key, problem).

    Reads agent, iteration, prompt, chosen, rejected and the key columns.
    """
    low, high = PAIR_ROUNDS
    tests = {
        "provenance": ~(F.col("agent").eqNullSafe(F.lit(agent)) & F.col("iteration").eqNullSafe(F.lit(iteration))),
        "round": ~F.coalesce(F.col("round").between(low, high), F.lit(False)),
        "blank": ~(present(F.col("prompt")) & present(F.col("chosen")) & present(F.col("rejected"))),
        "identical": F.coalesce(strip(F.col("chosen")) == strip(F.col("rejected")), F.lit(False)),
    }
    found = F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])
    known = allowed.select(keys[0]).distinct().withColumn("__known", F.lit(True))
    # the pairs are read once: every test is a column of its row
    marked = pairs.select(*keys, found.alias("__found")).join(known.hint("merge"), keys[0], "left")
    alike = Window.partitionBy(*keys)
    counted = marked.withColumn("__n", F.count(F.lit(1)).over(alike)).withColumn(
        "__at", F.row_number().over(alike.orderBy(F.lit(1)))
    )
    more = F.array(
        F.when((F.col("__n") > 1) & (F.col("__at") == 1), F.lit("repeated")),
        F.when(F.col("__known").isNull(), F.lit("unexpected sample")),
    )
    return counted.select(*keys, F.explode(F.array_compact(F.concat("__found", more))).alias("problem"))


def unbalanced_roles(rows: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """Samples without exactly one row per role, unknown roles, blank ids."""
    per_role = [F.count_if(F.col("role") == r) for r in roles]
    exact = reduce(lambda a, b: a & b, [c == 1 for c in per_role])
    return (
        rows.groupBy("sample_id")
        .agg(exact.alias("__exact"), F.count_if(~F.col("role").isin(*roles)).alias("unknown_roles"), F.count(F.lit(1)).alias("rows"))
        .filter(~F.col("__exact") | (F.col("unknown_roles") > 0) | ~present(F.col("sample_id")))
        .drop("__exact")
    )


def too_few_pairs(pairs: DataFrame, agents: DataFrame, minimum: int = MIN_PAIRS) -> DataFrame:
    """Agents below the minimum; an agent without any pair is listed too."""
    if minimum < 1:
        raise ValueError(f"minimum must be positive, got {minimum}")
    counted = pairs.groupBy("agent").agg(F.count(F.lit(1)).alias("pairs"))
    return (
        agents.join(counted, "agent", "left")
        .select("agent", F.coalesce("pairs", F.lit(0)).alias("pairs"))
        .filter(F.col("pairs") < minimum)
    )


def declared_rows(rows: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Batches to redo: counts that differ from the manifest, or unlisted ones."""
    return expected_rows(rows, manifest, keys)


def accounting(summary: DataFrame, samples: int | Column, pairs: Column, rounds: int = 4) -> DataFrame:
    """Rows of the summary where the selection counts do not add up."""
    size = F.lit(samples) if isinstance(samples, int) else samples
    tests = {
        "total": F.col("total_rounds") != size * rounds,
        "selected": F.col("selected_rounds") != pairs,
        "sum": F.col("selected_rounds") + F.col("dropped_rounds") != F.col("total_rounds"),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))
    return summary.withColumn("problem", F.explode(found))


def trials_not_contiguous(rows: DataFrame, groups: list[str], sample: str) -> DataFrame:
    """Groups whose trials are not 0..n-1 or do not cover the same samples."""
    # sums of half hashes fit a bigint, a decimal is made of each row only in the sum of whole ones
    mark = F.xxhash64(sample)
    halves = F.struct(F.sum(F.shiftright(mark, 32)).alias("high"), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))
    per_trial = rows.select(*groups, "trial", sample).distinct().groupBy(*groups, "trial").agg(
        F.count(sample).alias("samples"), halves.alias("set_hash")
    )
    return (
        per_trial.groupBy(*groups)
        .agg(
            F.count(F.lit(1)).alias("trials"),
            F.min("trial").alias("first"),
            F.max("trial").alias("last"),
            ((F.min("samples") == F.max("samples")) & (F.min("set_hash") == F.max("set_hash"))).alias("same_samples"),
        )
        .filter((F.col("first") != 0) | (F.col("last") != F.col("trials") - 1) | ~F.col("same_samples"))
    )


def unregistered(rows: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(registry.select(*keys).distinct(), keys, "left_anti")


def registered(rows: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(registry.select(*keys).distinct(), keys, "left_semi")


def set_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows (with multiplicity) on one side only, from one signed count per row."""
    signed = expected.withColumn("__n", F.lit(1)).unionByName(actual.withColumn("__n", F.lit(-1)))
    surplus = signed.groupBy(*expected.columns).agg(F.sum("__n").alias("__n")).filter("__n <> 0")
    side = F.when(F.col("__n") > 0, "missing").otherwise("extra").alias("side")
    return surplus.select(*expected.columns, side, F.explode(F.expr("sequence(1L, abs(__n))")).alias("__copy")).drop("__copy")
