"""Ids seen so far, as a bucketed table with a membership filter for each bucket.

An id falls into a bucket by its hash.  A bucket's filter is a Bloom filter in an
array of longs; ids that it does not hold are new without reading anything else.
The others are looked up, exactly, in the stored ids of their own buckets only.
New rows, their ids and the changed filters are published by one record of the
batch log, so a repeated batch changes nothing.  Every few batches the ids of all
batches and the newest filters are folded into one file set.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.streaming import commits


@dataclass(frozen=True)
class IndexShape:
    """Choose ``buckets`` so that a bucket gets some ``bits`` / 10 ids; results do not depend on it."""

    buckets: int = 256
    bits: int = 1 << 16
    hashes: int = 4
    fold_every: int = 16


FILTERS = "bucket int, words array<bigint>, batch bigint"


class SeenIds:
    """The index of one run, in the tables ``ids`` and ``filters`` of its log; new rows go to ``rows``."""

    def __init__(self, log: commits.BatchLog, keys: list[str], key_schema: T.StructType, shape: IndexShape):
        self.log, self.keys, self.shape = log, keys, shape
        self.id_schema = key_schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.lit("bucket"), *self.keys), F.lit(self.shape.buckets)).cast("int")

    def _bits(self) -> Column:
        """Places of an id in the filter of its bucket."""
        places = [F.pmod(F.xxhash64(F.lit(k), *self.keys), F.lit(self.shape.bits)).cast("int") for k in range(self.shape.hashes)]
        return F.array(*places)

    def _maybe(self) -> Column:
        """Whether the filter ``words`` has all places ``bits`` of an id."""
        word = lambda at: F.get("words", F.floor(at / 64).cast("int"))
        held = F.forall("bits", lambda at: F.getbit(word(at), at % 64) == 1)
        return F.coalesce(held, F.lit(False))

    def _filters(self, rows: DataFrame) -> DataFrame:
        """(bucket, words) of the ids of ``rows`` (bucket, bits)."""
        at = rows.select("bucket", F.explode("bits").alias("at"))
        words = at.groupBy("bucket", F.floor(F.col("at") / 64).cast("int").alias("word")).agg(
            F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("set")
        )
        # at most bits / 64 words a bucket
        held = words.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("word", "set"))).alias("m"))
        places = F.sequence(F.lit(0), F.lit((self.shape.bits - 1) // 64))
        return held.select("bucket", F.transform(places, lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0).cast("bigint"))).alias("words"))

    def _stored_filters(self) -> DataFrame:
        """The newest filter of every bucket."""
        schema = self.log.spark.createDataFrame([], FILTERS).schema
        rows = self.log.rows("filters", schema)
        return rows.groupBy("bucket").agg(F.max_by("words", "batch").alias("words"))

    def _ids(self, buckets: set[int] | None = None) -> DataFrame:
        def wanted(file: commits.StoredFile) -> bool:
            found = re.search(r"/bucket=(\d+)/", file.path)
            return buckets is None or found is not None and int(found[1]) in buckets

        return self.log.rows("ids", self.id_schema, wanted)

    def _same(self, left: DataFrame, right: DataFrame) -> Column:
        return reduce(Column.__and__, [left[k].eqNullSafe(right[f"__{k}"]) for k in self.keys])

    def split(self, batch: DataFrame) -> tuple[DataFrame, set[int], DataFrame]:
        """Rows of a batch that are new, the buckets that had to be read for that, and the persisted rows behind both."""
        first = batch.dropDuplicates(self.keys).withColumns({"bucket": self._bucket(), "bits": self._bits()})
        placed = first.join(self._stored_filters(), "bucket", "left").withColumn("maybe", self._maybe()).drop("words")
        placed.persist()
        doubtful = placed.filter("maybe")
        buckets = {r["bucket"] for r in doubtful.select("bucket").distinct().collect()}  # at most shape.buckets numbers
        known = self._ids(buckets).withColumnsRenamed({k: f"__{k}" for k in self.keys})
        unseen = doubtful.join(known, self._same(doubtful, known), "left_anti")
        return placed.filter("not maybe").unionByName(unseen).drop("maybe"), buckets, placed

    def keep_new(self, batch: DataFrame, batch_id: int) -> None:
        """Publish the new rows of a batch; one that was published before changes nothing."""
        if self.log.has(batch_id):
            return
        names = batch.columns
        fresh, _, placed = self.split(batch)
        fresh.persist()
        own = self._filters(fresh.select("bucket", "bits"))
        old = self._stored_filters().withColumnRenamed("words", "before")
        joined = own.join(old, "bucket", "left")
        merged = F.when(F.col("before").isNull(), F.col("words")).otherwise(
            F.zip_with("words", "before", lambda a, b: a.bitwiseOR(b))
        )
        stamp = F.lit(batch_id).cast("bigint").alias("batch")
        self.log.commit(
            batch_id,
            {
                "ids": fresh.select("bucket", *self.keys).repartition("bucket"),
                "filters": joined.select("bucket", merged.alias("words"), stamp),
                "rows": fresh.select(*names, stamp),
            },
            {"ids": ["bucket"]},
        )
        if batch_id - self.log.state().folded >= self.shape.fold_every:
            self.fold(batch_id)
        fresh.unpersist()
        placed.unpersist()

    def fold(self, batch_id: int) -> None:
        """One set of ids files and one filter a bucket, in place of those of all batches."""
        ids = self._ids().withColumn("bucket", self._bucket()).repartition("bucket")
        filters = self._stored_filters().withColumn("batch", F.lit(batch_id).cast("bigint"))
        self.log.fold({"ids": ids, "filters": filters}, {"ids": ["bucket"]})
        self.log.forget()
