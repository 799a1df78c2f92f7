"""Gold answers, request deduplication, unions and ordered merges."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plenum.functions.matching import answers_match, task_or_default


def attach_gold(completions: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Gold answer and task type beside each completion, the match, and ``known``.

    A completion whose sample does not exist is not known and not correct; a
    missing answer matches a missing gold of a known sample only.  Adaptive
    execution splits a key that holds a large share of the completions.
    """
    lookup = samples.select(key, "gold", "task_type", F.lit(True).alias("known"))
    joined = completions.join(lookup, key, "left")
    typed = joined.withColumns(
        {"task_type": task_or_default(F.col("task_type")), "known": F.coalesce("known", F.lit(False))}
    )
    hit = answers_match(F.col("answer"), F.col("gold"), F.col("task_type"))
    return typed.withColumn("correct", F.col("known") & hit)


def unmatched_completions(completions: DataFrame, samples: DataFrame, key: str = "sample_id") -> DataFrame:
    """Completions per key that no sample has, as violations."""
    return completions.join(samples.select(key), key, "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("completions"))


def distinct_requests(requests: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Each prompt once, with its hash and how often it is asked.

    Only valid for deterministic requests.  One count by prompt, which combines
    before the shuffle and sorts nothing; a prompt that is null is left out.
    """
    users = requests.filter(F.col(prompt).isNotNull()).groupBy(prompt).agg(F.count(F.lit(1)).alias("users"))
    return users.select(F.sha2(F.col(prompt), 256).alias("prompt_hash"), prompt, "users")


def fan_back(requests: DataFrame, answers: DataFrame, prompt: str = "prompt") -> DataFrame:
    """Give every request the answer of its prompt; adaptive execution splits a hot prompt."""
    return requests.withColumn("prompt_hash", F.sha2(F.col(prompt), 256)).join(answers, "prompt_hash", "left")


def union_parts(parts: Sequence[DataFrame | None], strict: bool = False) -> DataFrame:
    """Concatenate sub-tables; a missing one is skipped, or an error if strict."""
    if strict and any(p is None for p in parts):
        raise ValueError("a required part is missing")
    present = [p for p in parts if p is not None]
    if not present:
        raise ValueError("no part to concatenate")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), present)


def merge_sorted(parts: Sequence[DataFrame], keys: list[str], position: str) -> DataFrame:
    """Shards to one globally sorted table, stable for equal keys.

    Shard and position are part of the sort, so the range partitioner can cut
    a key that fills many partitions.
    """
    tagged = [p.withColumn("shard", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionByName, tagged).orderBy(*keys, "shard", position)


def unsorted_rows(part: DataFrame, key: str, position: str, width: int = 100_000) -> DataFrame:
    """Rows that come behind a larger key in their shard (order check on request).

    Each position range compares inside itself; range maxima link the ranges.
    """
    ranged = part.withColumn("__r", F.floor(F.col(position) / width))
    inside = Window.partitionBy("__r").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    # ranges are linked in two levels, so no task sees more than `width` of them
    tops = ranged.groupBy("__r").agg(F.max(key).alias("__top")).withColumn("__s", F.floor(F.col("__r") / width))
    near = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    far = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    spans = tops.groupBy("__s").agg(F.max("__top").alias("__most")).select("__s", F.max("__most").over(far).alias("__far"))
    before = tops.join(spans, "__s").select("__r", F.greatest(F.max("__top").over(near), F.col("__far")).alias("__before"))
    largest = F.greatest(F.col("__before"), F.max(key).over(inside))
    return ranged.join(before, "__r").withColumn("__largest", largest).filter(
        F.col(key) < F.col("__largest")
    ).drop("__r", "__before", "__largest")
