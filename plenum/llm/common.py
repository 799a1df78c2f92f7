"""What the operators of this subpackage share: tables, row identity, saved steps."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.session import scratch_path

# A batch of whole texts must fit beside the JVM heap, so batches are short.
BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}

ASCII_LOWER = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
)


def prepared(spark: SparkSession) -> SparkSession:
    """Short Arrow batches for the Python stages, whose workers must find this package.

    Where it was not shipped with the job, workers look for it where the driver has it.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    for key, value in BATCH_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write a step below ``spark.checkpoint.dir`` and go on from the files.

    Cuts the lineage in a way that survives lost executors, and keeps a Python
    stage from running again for each reader of its result.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def identity(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Null-safe key of a document: two longs that equal rows share.

    Rows with equal id and text are one document; rows that only share an id
    (or have none) stay apart by their text.
    """
    return [
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-1).cast("long")).alias("k_id"),
        F.xxhash64(F.col(doc_id), F.col(text)).alias("k_text"),
    ]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Pure ASCII text takes the plain, faster function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )
