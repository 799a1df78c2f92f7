"""Scoring that goes on while records arrive.

Spark's checkpoint knows which input a batch holds; ``commits.BatchLog`` knows
which files a batch wrote.  A batch that was killed after some of its writes is
repeated by Spark and gets its record then; readers see the tables of whole
batches only.  The log belongs to a run (by default that of the checkpoint's
path, which carries the fingerprint), so a changed run starts an own one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.functions.text import strip
from plenum.session import shared_dir
from plenum.sources import records
from plenum.streaming import commits, seen


def record_stream(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """JSON-lines files of a folder as a stream, schema given.

    ``_broken`` holds a line that is no object of the schema and is null
    otherwise; blank lines are skipped.  Sinks keep broken lines apart.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path).filter(F.length(strip(F.col("value"))) > 0)
    parsed = records.parsed_lines(lines, schema)
    return parsed.select(
        *[F.col(f"r.{name}").alias(name) for name in schema.names], F.when(F.col("__broken"), F.col("value")).alias("_broken")
    )


def whole_rows(stream: DataFrame) -> DataFrame:
    """The rows of a record stream that are not broken."""
    return stream.filter("_broken is null").drop("_broken")


def checkpoint_path(spark: SparkSession, job: str, fingerprint: str) -> str:
    return f"{shared_dir(spark)}/stream/{job}/{fingerprint}/checkpoint"


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Process what is there, batch by batch, and stop; a later run resumes."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()


def batch_log(spark: SparkSession, target: str, checkpoint: str, fingerprint: str | None, **tables: str) -> commits.BatchLog:
    return commits.BatchLog(spark, target, fingerprint or checkpoint, {"rows": target} | tables)


def _numbered(rows: DataFrame, batch_id: int) -> DataFrame:
    return rows.withColumn("batch", F.lit(batch_id).cast("bigint"))


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*(f for f in schema.fields if f.name != "batch"), T.StructField("batch", T.LongType())])


def _commit_stateful(log: commits.BatchLog, batch: DataFrame, batch_id: int) -> None:
    """Commit a batch of a stream with state; a batch that is there already is run all the same, for its state."""
    if not log.commit(batch_id, {"rows": _numbered(batch, batch_id)}):
        batch.write.format("noop").mode("overwrite").save()


def score_incrementally(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, violations: str,
    fingerprint: str | None = None,
) -> DataFrame:
    """Score arriving records and return the table of all committed batches, with their ``batch``.

    Broken lines of a batch go to ``violations``; both tables of a batch are
    published by one record (see ``broken_lines`` to read the other one).
    """
    log = batch_log(stream.sparkSession, target, checkpoint, fingerprint, violations=violations)

    def both(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        broken = batch.filter("_broken is not null").select("_broken")
        log.commit(batch_id, {"violations": _numbered(broken, batch_id), "rows": _numbered(score(whole_rows(batch)), batch_id)})
        batch.unpersist()

    run_batches(stream, both, checkpoint)
    return log.rows("rows", _with_batch(score(whole_rows(stream)).schema))


def broken_lines(spark: SparkSession, target: str, checkpoint: str, violations: str, fingerprint: str | None = None) -> DataFrame:
    """(_broken, batch) of all committed batches."""
    log = batch_log(spark, target, checkpoint, fingerprint, violations=violations)
    return log.rows("violations", T.StructType([T.StructField("_broken", T.StringType()), T.StructField("batch", T.LongType())]))


def _latest(changes: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    last = F.max_by(F.struct("batch", *values), "batch").alias("__last")
    return changes.groupBy(*groups).agg(last).select(*groups, "__last.*")


def running_counts(
    stream: DataFrame, groups: list[str], conditions: dict[str, str], target: str, checkpoint: str,
    fingerprint: str | None = None, fold_every: int = 16,
) -> DataFrame:
    """Counters that grow with the stream; the latest value per group.

    Update mode gives the changed groups of each batch.  Every ``fold_every``
    batches the changes are folded into one row a group, so a reader meets at
    most one row a group and the changes of the batches since.
    """
    log = batch_log(stream.sparkSession, target, checkpoint, fingerprint)
    counted = whole_rows(stream).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.count_if(F.expr(test)).alias(name) for name, test in conditions.items()],
    )
    schema, values = _with_batch(counted.schema), ["samples", *conditions]

    def write(batch: DataFrame, batch_id: int) -> None:
        _commit_stateful(log, batch, batch_id)
        if batch_id - log.state().folded >= fold_every:
            log.fold({"rows": _latest(log.rows("rows", schema), groups, values).select(*schema.names)})
            log.forget()

    run_batches(counted, write, checkpoint, "update")
    return _latest(log.rows("rows", schema), groups, values).drop("batch")


def first_of_each_id(
    stream: DataFrame, keys: list[str], target: str, checkpoint: str, event_time: str | None = None, delay: str | None = None,
    fingerprint: str | None = None, index: seen.IndexShape = seen.IndexShape(),
) -> DataFrame:
    """Rows whose id was not seen before; repeats are dropped.

    With an event time the state of the stream is bounded by the allowed delay.
    Without one, ids of all time count: they are kept in a bucketed table beside
    the target (see ``seen``), and the stream itself has no state.
    """
    spark, rows = stream.sparkSession, whole_rows(stream)
    if event_time is None:
        log = batch_log(spark, target, checkpoint, fingerprint, ids=f"{target}/_ids", filters=f"{target}/_filters")
        known = seen.SeenIds(log, keys, rows.select(*keys).schema, index)
        run_batches(rows, known.keep_new, checkpoint)
    else:
        log = batch_log(spark, target, checkpoint, fingerprint)
        fresh = rows.withWatermark(event_time, delay or "1 day").dropDuplicatesWithinWatermark(keys)
        run_batches(fresh, lambda batch, batch_id: _commit_stateful(log, batch, batch_id), checkpoint)
    return log.rows("rows", _with_batch(rows.schema))


def dropped_rows(received: DataFrame, kept: DataFrame) -> DataFrame:
    """How many rows came in, stayed and were dropped."""
    both = received.select(F.lit(1).alias("r"), F.lit(0).alias("k")).unionByName(
        kept.select(F.lit(0).alias("r"), F.lit(1).alias("k"))
    )
    return both.agg(F.sum("r").alias("received"), F.sum("k").alias("kept"), (F.sum("r") - F.sum("k")).alias("dropped"))
