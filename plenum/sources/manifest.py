"""Stage manifests and file inventories.

A finished stage records its fingerprint and, per artifact, rows and content
hash.  A later job accepts the stage only while all of them still match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.functions.fingerprint import table_fingerprint
from plenum.sources import files

MANIFEST_SCHEMA = "stage string, fingerprint string, artifact string, rows bigint, content_hash string"


def describe(df: DataFrame, stage: str, fingerprint: str, artifact: str, columns: list[str] | None = None) -> DataFrame:
    """The manifest row of one artifact table."""
    return table_fingerprint(df, columns).select(
        F.lit(stage).alias("stage"), F.lit(fingerprint).alias("fingerprint"), F.lit(artifact).alias("artifact"),
        "rows", "content_hash",
    )


def record(manifest: DataFrame, path: str) -> None:
    """Append manifest rows to the stage table."""
    manifest.write.mode("append").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def stage_status(expected: DataFrame, stored: DataFrame, actual: DataFrame) -> DataFrame:
    """One row per expected stage: complete, stale or missing.

    ``expected`` has stage and fingerprint, ``stored`` the manifest rows and
    ``actual`` the recomputed (stage, artifact, rows, content_hash).  A stage
    without artifacts is not accepted.
    """
    found = stored.select(
        "stage", F.col("fingerprint").alias("__fp"), "artifact", F.col("rows").alias("__rows"),
        F.col("content_hash").alias("__hash"),
    ).join(actual.select("stage", "artifact", "rows", "content_hash"), ["stage", "artifact"], "left")
    matches = found.join(expected, "stage", "right").select(
        "stage",
        F.col("artifact").isNotNull().alias("has_artifact"),
        F.coalesce(
            (F.col("__fp") == F.col("fingerprint"))
            & (F.col("__rows") == F.col("rows"))
            & (F.col("__hash") == F.col("content_hash"))
            & (F.col("rows") > 0),
            F.lit(False),
        ).alias("match"),
    )
    status = F.when(~F.bool_or("has_artifact"), "missing").when(F.bool_and("match"), "complete").otherwise("stale")
    return matches.groupBy("stage").agg(status.alias("status"), F.count_if("has_artifact").alias("artifacts"))


def blocked_inputs(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Upstream inputs whose recorded identity (fingerprint, path, hash) is not
    the expected one; any of them blocks the job."""
    keys = ["stage", "artifact"]
    have = stored.select(
        *keys, *[F.col(c).alias(f"__{c}") for c in ("fingerprint", "path", "content_hash")]
    )
    same = F.lit(True)
    for c in ("fingerprint", "path", "content_hash"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    reason = (
        F.when(F.col("__fingerprint").isNull(), "missing")
        .when(~F.col("fingerprint").eqNullSafe(F.col("__fingerprint")), "stale")
        .when(~F.col("path").eqNullSafe(F.col("__path")), "redirected")
        .otherwise("corrupted")
    )
    return expected.join(have, keys, "left").filter(~same).select(*keys, reason.alias("reason"))


def shard_blockers(expected: DataFrame, markers: DataFrame) -> DataFrame:
    """Shards without a marker or with one of another fingerprint."""
    have = markers.select("stage", "shard", F.col("fingerprint").alias("__found"))
    return (
        expected.join(have, ["stage", "shard"], "left")
        .filter(~F.col("fingerprint").eqNullSafe(F.col("__found")))
        .select("stage", "shard", F.when(F.col("__found").isNull(), "missing").otherwise("stale").alias("reason"))
    )


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path below root, size and sha-256 of every file, read as streams on the executors."""
    return files.digests(files.listing(spark, root), root)


def inventory_problems(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Listed files that are missing or differ in size or, when given, hash."""
    have = found.select("path", F.col("bytes").alias("__bytes"), F.col("sha256").alias("__sha"))
    problem = (
        F.when(F.col("__bytes").isNull(), "missing")
        .when(F.col("__bytes") != F.col("bytes"), "size")
        .when(F.col("sha256").isNotNull() & (F.col("sha256") != F.col("__sha")), "hash")
    )
    return manifest.join(have, "path", "left").withColumn("problem", problem).filter("problem is not null").select("path", "problem")
