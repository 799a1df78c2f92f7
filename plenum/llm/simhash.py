"""SimHash near-duplicates: pigeonhole blocks, joined and verified by Hamming distance.

A fingerprint of 64 bits is cut into ``blocks`` pieces.  Two fingerprints that
differ in at most ``distance`` bits differ in at most that many pieces, so they
agree on some choice of ``blocks - distance`` pieces.  Each choice is a join
key of some 38 bits, which keeps the groups small at any size of the corpus.
Only distinct fingerprints enter the join, so copies never meet in pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.common import ASCII_LOWER, identity, saved
from plenum.llm.graph import components

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 2
BLOCKS = 5
# Groups above this size are linked through shared neighbours, not by pairs.
PAIR_GROUP = 128
_STEP = 1 << 16


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of one whole text (null and wordless: zero)."""
    tokens = (text or b"").translate(ASCII_LOWER).split()
    if not tokens:
        return 0
    size = min(words, len(tokens))
    total, counts = len(tokens) - size + 1, np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, _STEP):
        stop = min(start + _STEP, total)
        columns = [tokens[start + i : stop + i] for i in range(size)]
        hashes = np.fromiter(
            (digest(b" ".join(shingle), SEED) for shingle in zip(*columns)), dtype="<u8", count=stop - start
        )
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total).view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def with_fingerprint(documents: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Add the fingerprint of every whole text as a long."""
    return documents.withColumn(name, _fingerprints(F.col(text).cast("binary")))


def as_hex(fingerprint_column: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint_column), 16, "0"))


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Signed masks of all choices of ``blocks - distance`` pieces."""
    bounds = [BITS * i // blocks for i in range(blocks + 1)]
    pieces = [((1 << (b - a)) - 1) << a for a, b in zip(bounds, bounds[1:])]
    masks = [sum(choice) for choice in combinations(pieces, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _differing(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _links_by_pairs(blocks: DataFrame, distance: int) -> DataFrame:
    left = blocks.select("c", "key", F.col("fp").alias("a"))
    right = blocks.select("c", "key", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (_differing("a", "b") <= distance)
    return left.join(right, (left.c == right.c) & (left.key == right.key) & close).select("a", "b")


def _points(blocks: DataFrame, masks: list[int], flips: int) -> DataFrame:
    """(fp, point): all values that differ from a member in at most ``flips`` of the bits its block leaves free."""
    free = F.element_at(F.array(*[F.lit(~m) for m in masks]), F.col("c") + 1)
    bit = F.expr("shiftleft(1L, i)")
    level = blocks.select("fp", free.alias("free"), F.col("fp").alias("point"), F.lit(-1).alias("last"))
    points = level
    for _ in range(flips):
        level = (
            level.select("fp", "free", "point", "last", F.explode(F.expr(f"sequence(0, {BITS - 1})")).alias("i"))
            .filter((F.col("i") > F.col("last")) & (F.col("free").bitwiseAND(bit) != 0))
            .select("fp", "free", F.col("point").bitwiseXOR(bit).alias("point"), F.col("i").alias("last"))
        )
        points = points.union(level)
    return points.select("fp", "point").distinct()


def _links_by_neighbours(blocks: DataFrame, masks: list[int], distance: int) -> DataFrame:
    """Links inside large groups, linear in their size.

    Two members within ``distance`` share a point that is at most half of it away
    from one (rounded down) and from the other (rounded up); members that share
    such a point are within the distance.  Each is linked to the least of the nearer
    members of the point, which keeps components.
    """
    near, far = distance // 2, (distance + 1) // 2
    points = _points(blocks, masks, far)
    closer = points if near == far else _points(blocks, masks, near)
    least = closer.groupBy("point").agg(F.min("fp").alias("a"))
    linked = points.join(least, "point").filter("a <> fp")
    return linked.select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))


def links(
    fingerprints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, pair_group: int = PAIR_GROUP
) -> DataFrame:
    """Links (a, b), a < b, that connect all distinct values of column ``fp`` within ``distance``.

    Groups of up to ``pair_group`` members give all their verified pairs;
    larger ones give links with the same components.  Nulls are ignored.
    """
    masks = block_masks(blocks, distance)
    keys = F.array(*[F.struct(F.lit(c).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for c, m in enumerate(masks)])
    keyed = fingerprints.select("fp").na.drop().distinct().select("fp", F.explode(keys).alias("k")).select("fp", "k.c", "k.key")
    large = saved(keyed.groupBy("c", "key").count().filter(F.col("count") > pair_group).select("c", "key"), "large-blocks")
    pairs = _links_by_pairs(keyed.join(large, ["c", "key"], "left_anti"), distance)
    if large.isEmpty():
        return pairs.distinct()
    return pairs.union(_links_by_neighbours(keyed.join(large, ["c", "key"]), masks, distance)).distinct()


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """Per document row: doc_id, fingerprint (long), component_id, root, k_id, k_text.

    root is the least fingerprint of the component.

    component_id is the smallest doc_id reachable through links, itself
    included.  Null and wordless texts have fingerprint zero and are linked
    like any other; repeated rows share a fingerprint and so a component; a
    null doc_id is returned, but never names a component unless all its
    members have none; other columns are not touched.  No rows: no rows.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = saved(
        with_fingerprint(rows.select("doc_id", "text", *identity())).drop("text"), "fingerprints"
    )
    nodes = saved(prints.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(links(nodes, **limits))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    member = placed.join(names, "root").select(F.col("fp").alias("fingerprint"), "root", "component_id")
    return prints.join(member, "fingerprint").select("doc_id", "fingerprint", "component_id", "root", "k_id", "k_text")


def keep_first(documents: DataFrame, **limits: int) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Of repeated rows, and of texts under one id, one stays; so does one of a
    group without any id.  Columns are those of the input.
    """
    found = near_duplicates(documents, **limits)
    kept = (
        found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root")
        .agg(F.min("k_id").alias("k_id"), F.min("k_text").alias("k_text"))
    )
    named = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), *identity()
    )
    return (
        named.join(kept, ["k_id", "k_text"], "left_semi")
        .dropDuplicates(["k_id", "k_text"])
        .select("__row.*")
    )
