"""Prefix trie of conversations, built over range partitions with a splitter skeleton.

A conversation is a path of turns.  Sorted by (path, id), the members of a trie
node stand in one run, and range partitioning cuts that run only if the node is a
prefix of a splitter's path.  So the trie of the splitter paths (the skeleton) is
sent to all workers; each sorted shard finishes every other node by itself with
one open node a level, and gives partial counts for skeleton nodes, which a
grouped sum completes.  Equal paths are split by id, so a conversation that a
third of all ids share is dealt to many shards as well.

A turn is 16 bytes of SHA-256 of its role and text; texts themselves are not
shuffled.  A conversation is held as one row of its turns' digests.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import saved

DIGEST = 16  # bytes a turn
SHARD_PATHS = 20_000  # conversations a shard, about
LEAST_SHARD = 64
OVERSAMPLE = 16  # sampled paths for each splitter
SAMPLE_BYTES = 32 << 20  # of sampled paths that reach the driver
SPLITTER_TURNS = 256  # a longer splitter path ends there
SKELETON_NODES = 100_000  # of all splitter paths together
CHUNK = 4096  # ids in one piece of a skeleton node's list
OUT_ROWS = 8192

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY_HASH = hashlib.sha256().hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256; the length of the role keeps role and text apart."""
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(both, 256), 1, 2 * DIGEST)


def sequences(turns: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """(conv_id, turns): the digests and text bytes of every conversation in order.

    Ordered by turn (null first), equal turn numbers by role and text digest; a
    null role or text counts as empty.  Rows without a conversation id belong to none.
    """
    role, text = (F.coalesce(turns[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.select(
        turns[conv_id].cast("long").alias("conv_id"),
        F.struct(
            turns["turn"].isNotNull().alias("numbered"), turns["turn"].alias("turn"), role.alias("role"),
            turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"),
        ).alias("t"),
    ).filter(F.col("conv_id").isNotNull())
    # conversations with one base stand in one partition, for rebuilding
    placed = rows.withColumn("base", base_of(F.col("conv_id"))).repartition("base")
    ordered = placed.groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return ordered.select("base", "conv_id", F.transform("t", lambda t: F.struct(t["digest"], t["bytes"])).alias("turns"))


def base_of(conv_id: Column) -> Column:
    return conv_id - conv_id % 5


def taken(conv_id: Column) -> Column:
    """How many turns come from the base conversation."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): the base conversation's first turns, then the own ones after as many.

    A base has at most nine conversations, so they are put together in one row.
    """
    groups = sequences(turns).groupBy("base").agg(F.collect_list(F.struct("conv_id", "turns")).alias("convs"))
    own = groups.select("base", "convs", F.explode("convs").alias("c"))
    base = F.get(F.filter("convs", lambda c: c["conv_id"] == F.col("base")), F.lit(0))
    start = F.coalesce(F.slice(base["turns"], 1, 8), F.slice(F.col("c.turns"), 1, 0))
    parts = own.select(F.col("c.conv_id").alias("conv_id"), start.alias("start"), F.col("c.turns").alias("own"))
    h = taken(F.col("conv_id"))
    whole = F.concat(F.slice("start", F.lit(1), h), F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0))))
    path = parts.select("conv_id", whole.alias("t"))
    return path.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("t", lambda t: t["digest"]), "")).alias("path"),
        F.transform("t", lambda t: t["bytes"]).alias("sizes"),
    )


def splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Up to ``shards`` - 1 keys (path, id) that cut the sorted paths into parts of about equal size.

    They come from a sample by a hash of the id whose bytes on the driver are bounded;
    a path of more than SPLITTER_TURNS turns is cut there, and with many long ones
    fewer splitters are kept.  Which keys are chosen changes no result.
    """
    if shards < 2:
        return []
    whole = F.octet_length("path") <= SPLITTER_TURNS * DIGEST
    key = F.substring("path", 1, SPLITTER_TURNS * DIGEST)
    sizes = paths.agg(F.count("*").alias("n"), F.avg(F.octet_length(key) + 40).alias("bytes")).first()
    want = min(OVERSAMPLE * shards, int(SAMPLE_BYTES / sizes["bytes"]))
    share = min(1.0, want / max(1, sizes["n"]))
    drawn = paths.filter(F.pmod(F.xxhash64("conv_id", F.lit("splitter")), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = drawn.select(key.alias("path"), F.when(whole, F.col("conv_id")).alias("id")).collect()
    least = -(1 << 63)
    keys = sorted({(bytes(r["path"]), least if r["id"] is None else r["id"]) for r in rows})
    step = max(1, len(keys) // shards)
    keys = keys[step::step][: shards - 1]
    nodes = sum(len(p) // DIGEST + 1 for p, _ in keys)
    return keys[:: -(-nodes // SKELETON_NODES)] if nodes > SKELETON_NODES else keys


def skeleton_of(keys: list[tuple[bytes, int]]) -> dict[bytes, int]:
    """All prefixes of the splitter paths, the root first, with their numbers."""
    found = {path[:end] for path, _ in keys for end in range(0, len(path) + 1, DIGEST)} | {b""}
    return {path: k for k, path in enumerate(sorted(found, key=lambda p: (len(p), p)))}


@dataclass(slots=True)
class _Open:
    """A node whose members are still being read."""

    number: int | None  # in the skeleton
    size: int  # bytes of the last text
    least: int
    members: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: object = None  # running hash of ended ids
    pieces: list[int] = field(default_factory=list)  # ended ids of a skeleton node
    waiting: list[list] = field(default_factory=list)  # finished children, until the least id is known


def shared_turns(one: bytes, other: bytes) -> int:
    """Turns that two paths have in common at their start."""
    most = min(len(one), len(other)) // DIGEST
    for at in range(most):
        place = at * DIGEST
        if one[place : place + DIGEST] != other[place : place + DIGEST]:
            return at
    return most


COLUMNS = [f.split()[0] for f in NODE.split(", ")]
OUT = f"kind string, number int, size long, shard int, piece long, ids string, {NODE}"
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}


class Shard:
    """One pass over the sorted paths of one shard; only the nodes of the present path are open."""

    def __init__(self, shard: int, skeleton: dict[bytes, int]):
        self.shard, self.skeleton = shard, skeleton
        self.stack: list[_Open] = []
        self.path = b""
        self.piece = 0
        self.out: list[tuple] = []

    def add(self, conv_id: int, path: bytes, sizes: list[int]) -> None:
        keep = shared_turns(self.path, path) + 1 if self.stack else 0
        while len(self.stack) > keep:
            self.close()
        self.path = path
        for at in range(len(self.stack), len(path) // DIGEST + 1):
            known = not at or self.stack[-1].number is not None
            number = self.skeleton.get(path[: at * DIGEST]) if known else None
            self.stack.append(_Open(number, sizes[at - 1] if at else 0, conv_id))
        node = self.stack[-1]
        node.members += 1
        node.least = min(node.least, conv_id)
        if node.number is not None:
            node.pieces.append(conv_id)
            if len(node.pieces) >= CHUNK:
                self.flush(node)
        elif node.ends is None:
            node.ends = hashlib.sha256(b"%d" % conv_id)
        else:
            node.ends.update(b",%d" % conv_id)

    def flush(self, node: _Open) -> None:
        if node.pieces:
            ids = ",".join(map(str, node.pieces))
            self.out.append(("ends", node.number, None, self.shard, self.piece, ids, *[None] * len(COLUMNS)))
            self.piece += 1
            node.pieces = []

    def close(self) -> None:
        node = self.stack.pop()
        depth = len(self.stack)
        above = self.stack[-1] if self.stack else None
        if above is not None:
            above.members += node.members
            above.least = min(above.least, node.least)
        for child in node.waiting:
            child[2] = node.least
            self.out.append(("node", None, None, None, None, None, *child))
        if node.number is not None:
            self.flush(node)
            counted = (node.least, depth, None, node.members, node.children, node.leaves, node.saved, None)
            self.out.append(("part", node.number, node.size, None, None, None, *counted))
            return
        node.leaves = node.leaves or 1
        node.saved += (node.members - 1) * node.size
        above.children += 1
        above.leaves += node.leaves
        above.saved += node.saved
        ends = node.ends.hexdigest() if node.ends else EMPTY_HASH
        row = [node.least, depth, None, node.members, node.children, node.leaves, node.saved, ends]
        if above.number is None:
            above.waiting.append(row)
        else:
            self.out.append(("edge", above.number, None, None, None, None, *row))

    def finish(self) -> None:
        while self.stack:
            self.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(f.split() for f in OUT.split(", ")), strict=True)
    columns = zip(zip(*rows, strict=True), kinds, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, ARROW[kind]) for c, kind in columns], list(names))


def _finish_shards(skeleton: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Shard | None = None
        for batch in batches:
            for shard, path, conv_id, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.shard != shard:
                    rest = []
                    if now is not None:
                        now.finish()
                        rest = now.out
                    now = Shard(shard, skeleton)
                    now.out = rest
                now.add(conv_id, path, sizes)
                if len(now.out) >= OUT_ROWS:
                    yield _batch(now.out)
                    now.out = []
        if now is not None:
            now.finish()
            for start in range(0, len(now.out), OUT_ROWS):
                yield _batch(now.out[start : start + OUT_ROWS])

    return run


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every skeleton node's ids; its pieces arrive in order and are never put together."""
    number, running = None, None
    for batch in batches:
        done = []
        for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if key != number:
                if number is not None:
                    done.append((number, running.hexdigest()))
                number, running = key, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done])], ["number", "ends"])
    if number is not None:
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([running.hexdigest()])], ["number", "ends"])


def _complete(skeleton: dict[bytes, int], parts: list, ends: dict[int, str]) -> list[tuple]:
    """Skeleton rows (number, *node) from the summed partial counts; as many as the skeleton has nodes."""
    by_number = {r["number"]: r.asDict() for r in parts}
    paths = {k: p for p, k in skeleton.items()}
    rows = []
    for number in sorted(by_number, key=lambda k: -len(paths[k])):  # children before parents
        node = by_number[number]
        if not node["n_children"]:
            node["n_leaves"] = 1
        node["saved"] += (node["n_convs"] - 1) * node["size"]
        above = by_number[skeleton[paths[number][:-DIGEST]]] if number else None
        if above is not None:
            above["n_children"] += 1
            above["n_leaves"] += node["n_leaves"]
            above["saved"] += node["saved"]
        rows.append(
            (number, node["conv_id"], node["depth"], above and above["conv_id"], node["n_convs"], node["n_children"],
             node["n_leaves"], node["saved"], ends.get(number, EMPTY_HASH))
        )
    return rows


def trie(paths: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, path, sizes); see ``conversation_trie``."""
    spark = paths.sparkSession
    total = paths.count()
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-total // shard_paths), min(parallel, total // LEAST_SHARD))
    keys = splitters(paths, shards)
    skeleton = skeleton_of(keys)

    @F.pandas_udf("int")
    def shard_of(path, conv_id):
        return path.combine(conv_id, lambda p, c: bisect.bisect_right(keys, (bytes(p), c))).astype("int32")

    placed = paths.select(shard_of("path", "conv_id").alias("shard"), "path", "conv_id", "sizes")
    dealt = placed.repartition(max(1, min(len(keys) + 1, 4 * parallel)), "shard").sortWithinPartitions("shard", "path", "conv_id")
    found = saved(dealt.mapInArrow(_finish_shards(skeleton), OUT), "trie-parts")
    # bounded by the skeleton: SKELETON_NODES at most
    parts = found.filter("kind = 'part'").groupBy("number").agg(
        F.max("size").alias("size"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves")], F.sum("saved_tokens").alias("saved"),
    )
    pieces = found.filter("kind = 'ends'").select("number", "ids", "shard", "piece").repartition("number")
    hashed = pieces.sortWithinPartitions("number", "shard", "piece").select("number", "ids").mapInArrow(_hash_lists, "number int, ends string")
    ends = {r["number"]: r["ends"] for r in hashed.collect()}
    top = spark.createDataFrame(_complete(skeleton, parts.collect(), ends), f"number int, {NODE}")
    above = F.broadcast(top.select("number", F.col("conv_id").alias("above")))
    edges = found.filter("kind = 'edge'").join(above, "number").withColumn("parent_conv_id", F.col("above"))
    return found.filter("kind = 'node'").select(*COLUMNS).unionByName(edges.select(*COLUMNS)).unionByName(top.select(*COLUMNS))


def conversation_trie(turns: DataFrame, shard_paths: int = SHARD_PATHS) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id (least member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    A repeated row is a turn of its own; null turn numbers come first; a null role
    or text counts as empty; rows with a null conv_id belong to no conversation and
    are left out.  An empty table has no node, not even a root.  Other columns are
    not touched.
    """
    return trie(saved(rebuilt(turns), "rebuilt-paths"), shard_paths)
