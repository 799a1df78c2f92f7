"""Content hashes of a table by key range, in levels, and what a difference means for later stages.

A leaf is the order-free fingerprint of one range of an integer key; a node of the
level above stands for ``fanout`` neighbours and hashes their hashes.  Two trees are
compared from the root down, and only the children of nodes that differ are looked
at, so finding one changed row among many costs a short node list a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.functions.fingerprint import table_fingerprint
from plenum.operators.ranking import staged

WIDTH = 1_000_000  # keys in a leaf
FANOUT = 64
LEVELS = 12  # with 64 children a node this is enough for any long


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """The level above; a parent gathers the hashes of at most ``fanout`` children."""
    listed = F.array_sort(F.collect_list(F.struct("node", "rows", "hash")))
    told = F.transform(listed, lambda c: F.concat_ws(":", c["node"], c["rows"], c["hash"]))
    return nodes.groupBy((F.col("level") + 1).alias("level"), F.floor(F.col("node") / fanout).alias("node")).agg(
        F.sum("rows").alias("rows"), F.sha2(F.array_join(told, ","), 256).alias("hash")
    )


def hash_tree(df: DataFrame, key: str, columns: list[str] | None = None, width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """(level, node, rows, hash) of a table, leaves at level 0, roots at the highest one.

    Leaf n covers the keys from n * width up to the next leaf; a null key has the
    null leaf, which goes up as such.  Keys below and above zero have a root each.
    An empty table has no nodes.
    """
    leaves = table_fingerprint(df.withColumn("__leaf", F.floor(F.col(key) / width)), columns or df.columns, ["__leaf"])
    level = staged(leaves.select(F.lit(0).alias("level"), F.col("__leaf").alias("node"), "rows", F.col("content_hash").alias("hash")), "leaves")
    tree = level
    for _ in range(LEVELS):
        if level.filter("node not in (0, -1)").isEmpty():
            break
        level = staged(_parents(level, fanout), "nodes")
        tree = tree.unionByName(level)
    return tree


def _compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes of one level that differ, with the rows of both sides."""
    was = old.select("node", F.col("rows").alias("rows_before"), F.col("hash").alias("__was"))
    now = new.select(F.col("node").alias("__node"), F.col("rows").alias("rows_now"), F.col("hash").alias("__now"))
    both = was.join(now, F.col("node").eqNullSafe(F.col("__node")), "full")
    return both.filter(~F.col("__was").eqNullSafe(F.col("__now"))).select(F.coalesce("node", "__node").alias("node"), "rows_before", "rows_now")


def changed_ranges(old: DataFrame, new: DataFrame, width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """(range, first_key, last_key, rows_before, rows_now, change) of the leaves that differ between two trees.

    ``change`` is changed, added or removed.  Both trees must have the same width
    and fanout.  The comparison goes down from the highest level that both have;
    of a level it reads the children of differing nodes only.
    """
    tops = [t.agg(F.max("level")).first()[0] for t in (old, new)]
    level = min((t for t in tops if t is not None), default=0)
    differing = _compared(old.filter(F.col("level") == level), new.filter(F.col("level") == level))
    for below in range(level - 1, -1, -1):
        parents = staged(differing.select(F.col("node").alias("__parent")), "differing")
        own = F.floor(F.col("node") / fanout).eqNullSafe(F.col("__parent"))
        parts = [t.filter(F.col("level") == below).join(parents, own, "left_semi") for t in (old, new)]
        differing = _compared(*parts)
    change = F.when(F.col("rows_before").isNull(), "added").when(F.col("rows_now").isNull(), "removed").otherwise("changed")
    return differing.select(
        F.col("node").alias("range"), (F.col("node") * width).alias("first_key"), ((F.col("node") + 1) * width - 1).alias("last_key"),
        "rows_before", "rows_now", change.alias("change"),
    )


def carry_staleness(status: DataFrame, edges: DataFrame) -> DataFrame:
    """(stage, status, cause): a complete stage after one that is not complete becomes stale.

    ``status`` has stage and status, ``edges`` stage and upstream.  ``cause`` is the
    least of the stages that are stale or missing by themselves and lie before it;
    null for the others.  Rounds end when no stage changes, so after the longest
    chain of stages; a circle of stages ends as well.
    """
    bad = staged(status.filter("status <> 'complete'").select("stage", F.col("stage").alias("cause")), "stale")
    while True:
        reached = bad.join(edges.select(F.col("upstream").alias("stage"), F.col("stage").alias("later")), "stage")
        all_bad = bad.unionByName(reached.select(F.col("later").alias("stage"), "cause")).distinct()
        more = staged(all_bad, "stale")
        if more.count() == bad.count():
            break
        bad = more
    own = status.select("stage", "status")
    cause = bad.filter("stage <> cause").groupBy("stage").agg(F.min("cause").alias("cause"))
    later = F.when((F.col("status") == "complete") & F.col("cause").isNotNull(), "stale").otherwise(F.col("status"))
    return own.join(cause, "stage", "left").select("stage", later.alias("status"), "cause")
