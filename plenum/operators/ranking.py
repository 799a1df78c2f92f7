"""Exact ranks and top-N selections that never put one group into one task.

A rank inside a group is split in two: the number of rows in earlier order
buckets (a small aggregate) plus the rank inside the bucket.  A group that
holds a third of all rows is therefore sorted by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plenum.session import scratch_path

# Hex digits of the hash that make a bucket, 16 ** 3 = 4096 of them.  A task sorts one bucket of a
# group, so take one more digit for each 16 times the rows; results do not depend on it.
HASH_PREFIX = 3
KEY_WIDTH = 100_000  # distinct integer keys per bucket


def hash_bucket(hexed: Column, digits: int = HASH_PREFIX) -> Column:
    """Leading hex digits: buckets of a uniform hash, in hash order."""
    return F.substring(hexed, 1, digits)


def key_bucket(key: Column, width: int = KEY_WIDTH) -> Column:
    """Equal ranges of an integer key, in key order."""
    return F.floor(key / width)


def numbers_first(df: DataFrame, keys: list[str]) -> list[str]:
    """The keys of a group-by with numbers in front, long ones first.

    Its sort compares eight bytes of the first key before it compares whole rows,
    and the names of a few data sets or roles, or the numbers of a few trials,
    would be alike in them.
    """
    kinds, widths = dict(df.dtypes), ("bigint", "int", "smallint", "tinyint")
    return sorted(keys, key=lambda k: widths.index(kinds[k]) if kinds[k] in widths else len(widths))


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table below the shared folder and go on from its files.

    What several later steps read is then computed once, and outlives executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_counts(df: DataFrame, groups: list[str], bucket: str = "__bucket") -> DataFrame:
    """Rows per (group, bucket): one small table that all offsets come from."""
    return df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias("__n"))


def offsets(counts: DataFrame, groups: list[str], bucket: str = "__bucket") -> DataFrame:
    """Rows of the group in all earlier buckets, per (group, bucket)."""
    before = (
        Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    )
    summed = counts.groupBy(*groups, bucket).agg(F.sum("__n").alias("__n"))
    return summed.select(
        *groups, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )


def match_groups(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys where NULL equals NULL, so no row gets lost."""
    renamed = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(renamed[f"__k_{k}"])
    return left.join(renamed, same).drop(*[f"__k_{k}" for k in keys])


def with_position(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    bucket: Column,
    target: str = "position",
    limit: Column | None = None,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Add the 0-based position of each row inside its group.

    ``bucket`` must not decrease along ``order``.  With ``limit`` only positions
    below it are kept, and buckets that start beyond it are dropped before
    anything is sorted.  ``counts`` are the rows per (group, bucket) where the
    caller has them already.
    """
    named = df.withColumn("__bucket", bucket)
    before = offsets(bucket_counts(named, groups) if counts is None else counts, groups)
    joined = match_groups(named, before, [*groups, "__bucket"])
    if limit is not None:
        joined = joined.filter(F.col("__before") < limit)
    inside = F.row_number().over(Window.partitionBy(*groups, "__bucket").orderBy(*order))
    ranked = joined.withColumn(target, (F.col("__before") + inside - 1).cast("bigint"))
    if limit is not None:
        ranked = ranked.filter(F.col(target) < limit)
    return ranked.drop("__bucket", "__before")


def with_range_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the rank from 1 in the order of all rows, by ranges that are sorted task by task.

    ``order`` must tell all rows apart, or rows alike are ranked in any order.  The
    only list that one task orders has a row for each range.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = staged(sorted_rows, "ranges").withColumn("__range", F.shiftright("__at", 33))
    ends = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(starts, "__range").withColumn(name, F.col("__before") + inside + 1).drop("__at", "__range", "__before")
