"""Repeatable samples, splits, ids and batches from hash orders.

A hash of seed and key orders the rows; the same content and seed always give
the same choice.  Ranks come from bucket offsets (see ``ranking``), so neither
a hot group nor a large sample size ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.seeds import order_hash
from plenum.operators.ranking import (
    HASH_PREFIX, bucket_counts, hash_bucket, key_bucket, match_groups, offsets, staged, with_position, with_range_rank,
)


def _positive(n: int | None) -> None:
    if n is not None and n <= 0:
        raise ValueError(f"sample size must be positive or None, got {n}")


def sample_random(df: DataFrame, key: str, n: int | None, seed: int) -> DataFrame:
    """Exactly n rows (all when n is None or not smaller than the table)."""
    _positive(n)
    if n is None:
        return df
    hashed = df.withColumn("__hash", order_hash(seed, F.col(key)))
    return with_position(
        hashed, [], [F.col("__hash"), F.col(key)], hash_bucket(F.col("__hash")),
        "__position", limit=F.lit(n),
    ).drop("__hash", "__position")


def _stratified(
    named: DataFrame, counts: DataFrame, groups: list[str], limit: Column, quota: Column, digits: int
) -> DataFrame:
    """Shared core: a quota per stratum first, the rest by hash, ``limit`` in all.

    ``named`` has __hash, __bucket, __key and __group, ``counts`` its rows per
    stratum and bucket; ``groups`` are outer groups (splits).  Only rows that
    can still be chosen are ever sorted.
    """
    inner = [*groups, "__group"]
    per_group = offsets(counts, inner).withColumnRenamed("__before", "__in_group")
    overall = offsets(counts, groups).withColumnRenamed("__before", "__in_all")
    placed = match_groups(named, per_group, [*inner, "__bucket"])
    open_rows = match_groups(placed, overall, [*groups, "__bucket"]).filter(
        (F.col("__in_group") < quota) | (F.col("__in_all") < limit)
    )
    inside = Window.partitionBy(*inner, "__bucket").orderBy("__hash", "__key")
    flagged = open_rows.withColumn(
        "__first", F.col("__in_group") + F.row_number().over(inside) - 1 < quota
    ).drop("__bucket", "__in_group", "__in_all")
    tier = F.when(F.col("__first"), "0").otherwise("1")
    return with_position(
        staged(flagged, "open-rows"), groups, [tier, F.col("__hash"), F.col("__key")],
        F.concat(tier, hash_bucket(F.col("__hash"), digits)), "__position", limit=limit,
    )


def sample_stratified(
    df: DataFrame, key: str, n: int | None, seed: int, group: str = "subject", digits: int = HASH_PREFIX
) -> DataFrame:
    """n rows in all, at least max(1, n div groups) of every group first."""
    _positive(n)
    if n is None:
        return df
    named = (
        df.withColumn("__group", F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("unknown")))
        .withColumn("__key", F.col(key))
        .withColumn("__hash", order_hash(seed, F.col(key)))
        .withColumn("__bucket", hash_bucket(F.col("__hash"), digits))
    )
    counts = staged(bucket_counts(named, ["__group"]), "strata")
    groups = counts.agg(F.countDistinct("__group")).scalar()
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) / groups))
    # with one group the quota is n itself, so the choice is the random one
    chosen = _stratified(named, counts, [], F.lit(n), quota, digits)
    return chosen.select(*df.columns)


def sample_bundle(
    df: DataFrame, settings: DataFrame, key: str, split: str, base_seed: int, group: str = "subject", digits: int = HASH_PREFIX
) -> DataFrame:
    """Per-split strategy, size and seed offset from a small settings table.

    Strategies: full, random, stratified_by_subject.  A split without settings
    or without a size is kept whole.
    """
    named = (
        df.join(settings, split, "left")
        .withColumn("__n", F.when(F.coalesce(F.col("strategy"), F.lit("full")) != "full", F.col("max_samples")))
        .withColumn("__seed", F.lit(base_seed) + F.coalesce(F.col("seed_offset"), F.lit(0)))
        .withColumn(
            "__group",
            F.when(
                F.col("strategy") == "stratified_by_subject",
                F.coalesce(F.nullif(F.col(group), F.lit("")), F.lit("unknown")),
            ).otherwise("all"),
        )
        .withColumn("__key", F.col(key))
        .withColumn("__hash", order_hash(F.col("__seed"), F.col(key)))
        .withColumn("__bucket", hash_bucket(F.col("__hash"), digits))
    )
    kept_whole = named.filter(F.col("__n").isNull()).select(*df.columns)
    sized = named.filter(F.col("__n").isNotNull())
    counts = staged(bucket_counts(sized, [split, "__group"]), "strata")
    strata = counts.groupBy(split).agg(F.countDistinct("__group").alias("__groups"))
    sized = match_groups(sized, strata, [split])
    quota = F.greatest(F.lit(1), F.floor(F.col("__n") / F.col("__groups")))
    chosen = _stratified(sized, counts, [split], F.col("__n"), quota, digits)
    return kept_whole.unionByName(chosen.select(*df.columns))


REMAINDER_BUCKETS = 4096


def allocate(sizes: DataFrame, total: int, name: str = "name", size: str = "size") -> DataFrame:
    """Exact total over groups in proportion to their size: largest remainders
    first, ties by name.

    A histogram of the remainders tells in which bucket the last one lies that
    is rounded up.  Buckets before it are rounded up, later ones down, and only
    the groups of that bucket are ranked, range by range; so no task holds all
    groups, however many there are or however many remainders are equal.
    """
    if total < 0:
        raise ValueError("total must not be negative")
    base = staged(sizes, "sizes")
    rows = base.agg(F.sum(size)).first()[0] or 0
    if not rows:
        return base.withColumn("allocated", F.lit(0).cast("bigint"))
    if rows < total:
        raise ValueError(f"cannot allocate {total} rows")
    quota = F.try_divide((F.col(size) * total).cast("double"), F.lit(rows).cast("double"))
    base = base.withColumn("__quota", F.coalesce(quota, F.lit(0.0))).withColumn("__floor", F.floor("__quota"))
    base = base.withColumn("__rest", F.col("__quota") - F.col("__floor"))
    base = base.withColumn("__bucket", F.floor((1 - F.col("__rest")) * REMAINDER_BUCKETS))  # in falling order of the remainder
    histogram = base.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("__floor").alias("floor")).orderBy("__bucket").collect()
    left = total - sum(r["floor"] for r in histogram)
    cut = -1
    for r in histogram:  # at most REMAINDER_BUCKETS + 1 rows
        cut = r["__bucket"]
        if left <= r["n"]:
            break
        left -= r["n"]
    ranked = with_range_rank(base.filter(F.col("__bucket") == cut), [F.col("__rest").desc(), F.col(name)], "__rank")
    up = F.when(F.col("__bucket") < cut, 1).otherwise((F.coalesce("__rank", F.lit(left + 1)) <= left).cast("int"))
    apart = base.filter(F.col("__bucket") != cut).withColumn("__rank", F.lit(None).cast("bigint"))
    both = apart.unionByName(ranked).withColumn("allocated", F.col("__floor") + up)
    return both.drop("__quota", "__floor", "__rest", "__bucket", "__rank")


def split_quotas(
    sizes: DataFrame, test: int | float, validation: int | float, exact: bool, name: str
) -> DataFrame:
    """Rows for test and validation per category.  Exact totals share what is
    left after test; ratios are cut off per category."""
    if not exact:
        return sizes.select(
            name, "size",
            F.floor(F.col("size") * F.lit(test)).alias("n_test"),
            F.floor(F.col("size") * F.lit(validation)).alias("n_validation"),
        )
    first = allocate(sizes, int(test), name).withColumnRenamed("allocated", "n_test")
    rest = first.withColumn("left", F.col("size") - F.col("n_test"))
    return allocate(rest, int(validation), name, "left").select(
        name, "size", "n_test", F.col("allocated").alias("n_validation")
    )


def split_stratified(
    df: DataFrame,
    key: str,
    seed: int,
    category: str = "subject",
    test: int | float = 0.25,
    validation: int | float = 0.10,
    exact: bool = False,
    digits: int = HASH_PREFIX,
) -> DataFrame:
    """Per category: test, validation and train cut from a seeded order, then
    numbered from 0 inside each split.  The rows are read twice, once to count."""
    hashed = df.withColumn("__hash", order_hash(seed, F.col(key)))
    bucket = hash_bucket(F.col("__hash"), digits)
    counts = staged(bucket_counts(hashed.withColumn("__bucket", bucket), [category]), "categories")
    sizes = counts.groupBy(category).agg(F.sum("__n").alias("size"))
    quotas = split_quotas(sizes, test, validation, exact, category)
    order = [F.col("__hash"), F.col(key)]
    ranked = with_position(hashed, [category], order, bucket, "__rank", counts=counts)
    n_test, n_val = F.col("n_test"), F.col("n_validation")
    split = (
        F.when(F.col("__rank") < n_test, "test")
        .when(F.col("__rank") < n_test + n_val, "validation")
        .otherwise("train")
    )
    cut = match_groups(ranked, quotas.drop("size"), [category]).withColumn("source_split", split)
    numbered = with_position(
        staged(cut.drop("n_test", "n_validation", "__rank"), "split-rows"), ["source_split"], order, bucket, "source_index",
    )
    return numbered.drop("__hash")


def source_position(df: DataFrame, groups: list[str], key: str, target: str = "source_index") -> DataFrame:
    """Position of a row inside its split, in the order of an integer key."""
    return with_position(df, groups, [F.col(key)], key_bucket(F.col(key)), target)


def assign_sample_id(
    df: DataFrame, key: str, seed: int, dataset: str = "dataset", split: str = "split", existing: str | None = None
) -> DataFrame:
    """Dense sample_index in sampling order; sample_id where the row has none."""
    hashed = df.withColumn("__hash", order_hash(seed, F.col(key)))
    numbered = with_position(
        hashed, [dataset, split], [F.col("__hash"), F.col(key)],
        hash_bucket(F.col("__hash")), "sample_index",
    ).drop("__hash")
    made = F.format_string("%s_%s_%08d", F.col(dataset), F.col(split), F.col("sample_index"))
    return numbered.withColumn(
        "sample_id", made if existing is None else F.coalesce(F.col(existing), made)
    )


def expand_trials(samples: DataFrame, trials: int) -> DataFrame:
    """Repeat every sample; ids get a suffix and the index stays dense."""
    if trials < 1:
        raise ValueError(f"trials must be positive, got {trials}")
    if trials == 1:
        return samples
    missing = F.raise_error(F.lit("a sample without id cannot be repeated"))
    source = F.when(F.length("sample_id") > 0, F.col("sample_id")).otherwise(missing)
    return (
        samples.withColumn("source_sample_id", source)
        .withColumn("source_sample_index", F.col("sample_index"))
        .withColumn("trajectory", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))
        .withColumn(
            "sample_id",
            F.format_string("%s__trajectory_%02d", F.col("source_sample_id"), F.col("trajectory")),
        )
        .withColumn("sample_index", F.col("source_sample_index") * trials + F.col("trajectory"))
    )


def shard(df: DataFrame, index: str, shards: int, which: int) -> DataFrame:
    """Rows whose position modulo the shard count is ``which``."""
    if shards < 1 or not 0 <= which < shards:
        raise ValueError(f"invalid shard {which} of {shards}")
    return df.filter(F.pmod(F.col(index), F.lit(shards)) == which)


def with_batch(df: DataFrame, groups: list[str], key: str, size: int) -> DataFrame:
    """Batch number of each row in key order."""
    if size < 1:
        raise ValueError("batch size must be at least 1")
    return source_position(df, groups, key, "__position").withColumn(
        "batch_index", F.floor(F.col("__position") / size)
    ).drop("__position")


def batches(df: DataFrame, groups: list[str], key: str, size: int) -> DataFrame:
    """First and last key and row count of each batch."""
    return with_batch(df, groups, key, size).groupBy(*groups, "batch_index").agg(
        F.min(key).alias("first_index"), F.max(key).alias("last_index"), F.count(F.lit(1)).alias("rows")
    )
