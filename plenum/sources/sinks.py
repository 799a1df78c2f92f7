"""Writing rows: JSON lines, metrics, CSV summaries, in key order.

Spark's commit protocol makes a job's output appear whole or not at all.  To
keep an older output when a new job fails, data goes to a staging folder that
replaces the target after the job has committed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Key columns of the written tables.
SORT_KEYS = {
    "evaluation": ["trial", "sample_index"],
    "pairs": ["sample_index", "round"],
    "trajectories": ["sample_index"],
    "sft_rows": ["sample_index", "role", "temperature"],
    "audit": ["shard", "batch_index"],
    "baseline": ["sample_index", "sample_id"],
}
SUMMARY_COLUMNS = [
    "model", "method", "dataset", "samples", "expected_samples", "accuracy", "parse_rate",
    "trials", "metrics_path",
]


def in_key_order(df: DataFrame, table: str) -> DataFrame:
    """Global order for a sink (the only place where rows are sorted)."""
    return df.orderBy(*SORT_KEYS[table])


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def replace_dir(spark: SparkSession, staged: str, target: str) -> None:
    """Put a finished staging folder in the place of the target."""
    fs, jvm = _filesystem(spark, target)
    new, old = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(target)
    aside = jvm.org.apache.hadoop.fs.Path(f"{target}.old-{uuid.uuid4().hex[:8]}")
    had_old = fs.exists(old)
    if had_old and not fs.rename(old, aside):
        raise OSError(f"cannot move {target} aside")
    fs.mkdirs(old.getParent())
    if not fs.rename(new, old):
        if had_old:
            fs.rename(aside, old)
        raise OSError(f"cannot move {staged} to {target}")
    if had_old:
        fs.delete(aside, True)


def write_jsonl(df: DataFrame, path: str, keys: list[str] | None = None) -> int:
    """JSON lines with NULL fields kept; returns the rows written.

    The count comes from the write itself (an observation), not a second scan.
    """
    spark, staged = df.sparkSession, f"{path}.staging-{uuid.uuid4().hex[:8]}"
    seen = Observation()
    rows = df.orderBy(*keys) if keys else df
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.option(
        "ignoreNullFields", "false"
    ).json(staged)
    replace_dir(spark, staged, path)
    return int(seen.get["rows"])


def write_metrics(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Metrics as one partitioned table instead of many documents."""
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def metrics_documents(df: DataFrame, keys: list[str]) -> DataFrame:
    """Each metrics row as a JSON document with sorted keys."""
    names = sorted(c for c in df.columns if c not in keys)
    body = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return df.select(*keys, body.alias("document"))


def write_csv_summary(results: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """The long result matrix sorted by (model, dataset, method).

    One file on purpose: the matrix has one row per cell.
    """
    wanted = columns or [c for c in SUMMARY_COLUMNS if c in results.columns]
    ordered = results.select(*wanted).orderBy("model", "dataset", "method")
    ordered.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
