"""Line deduplication by a segment-partition edit join.

Lines are near-duplicates if at most ``EDITS`` insertions, deletions or
replacements of characters turn one into the other.  The shorter line of such
a pair, cut into ``EDITS + 1`` segments, has one segment that the longer line
contains unchanged, near the same place (Li et al., Pass-Join).  Each distinct
line gives the segments of its own length to an index, and looks up the
substrings that the segments of lines up to ``EDITS`` shorter can match; the
bounds on their places are the multi-match-aware ones.  An edit changes at most
two character counts by one, so a pair must also agree in its counts of
characters by class but for ``2 * EDITS``; the join itself checks that, so that
lines which share a long passage are not paired for it.  Candidates are
verified with a banded bit-parallel edit distance.

A segment that very many lines share (as in numbered lines of one wording) would
pair all of them.  Such a family loses the ends that all its lines have in common,
which changes no distance, and its lines meet on what is left of them after up to
``EDITS`` deletions: two lines within the distance share such a variant.  That costs
a row for each variant instead of one for each pair of lines, and is done where it
is less.

Texts are read where they lie: only hashes of lines and segments are shuffled,
and the texts of lines that have a candidate.  Copies of a line never meet in
pairs, as only its first document takes part for it.
"""

from __future__ import annotations

from os.path import commonprefix

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.common import identity, saved
from plenum.llm.graph import components

EDITS = 2
# Shorter lines (code points) are compared for equality only: two edits would make other words of them.
MIN_CHARS = 20
# A line of white space alone is no line to compare.
NOT_BLANK = r"(?U)\S"
# Lines that share a segment, from which on they may meet on variants instead; counted in one line of SAMPLED.
FAMILY, SAMPLED = 512, 16
# Rows of line hashes that may be broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of two strings is at most ``edits``.

    Common ends are taken off; the rest runs through a bit vector that holds
    the vertical differences of the 2 * edits + 1 diagonals around the main one.
    """
    if len(a) < len(b):
        a, b = b, a
    gap = len(a) - len(b)
    if gap > edits:
        return False
    head, most = 0, len(b)
    while head < most and a[head] == b[head]:
        head += 1
    tail, most = 0, most - head
    while tail < most and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not b:
        return True  # only the gap is left
    width = 2 * edits + 1
    full = (1 << width) - 1
    # bit k of column j stands for row j - edits + k (rows and columns from 1)
    up, down = full & ~((1 << edits) - 1), 0
    found, last = gap, 1 << (gap + edits)
    rows = "\0" * edits + a + "\0" * (width + edits)
    for j, char in enumerate(b):
        equal = 0
        for k in range(width):
            row = j - edits + k
            if 0 <= row < len(a) and rows[j + k] == char:
                equal |= 1 << k
        diagonal = ((((equal & up) + up) ^ up) | equal | down) & full
        right = (down | ~(diagonal | up)) & full
        left = diagonal & up
        if not diagonal & last:
            found += 1
            if found > edits:
                return False
        below = diagonal >> 1
        up = (left | ~(below | right)) & full
        down = below & right
    return True


def _lines(documents: DataFrame, distinct: bool, min_chars: int, short: bool = False) -> DataFrame:
    """Lines of at least ``min_chars``; ``distinct``: each text once for a document, without its place.

    ``short``: shorter lines too, but for blank ones.
    """
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    keyed = documents.select(*identity(), (F.array_distinct(split) if distinct else split).alias("lines"))
    if distinct:
        rows = keyed.select("k_id", F.explode("lines").alias("line"))
    else:
        rows = keyed.select("k_id", "k_text", F.posexplode("lines").alias("line_no", "line"))
    wanted = F.char_length("line") >= min_chars
    if short:
        wanted = wanted | F.col("line").rlike(NOT_BLANK)
    return rows.filter(wanted).withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit("g"), F.col("line"))})


def _bound(length: Column, part: int, edits: int) -> Column:
    return F.floor(length * part / (edits + 1)).cast("int")


def _segment(length: Column, part: int, shift: int, edits: int) -> Column:
    """Hash of a segment of lines of a length, taken from ``line`` with its start moved by ``shift``."""
    start = _bound(length, part, edits)
    size = _bound(length, part + 1, edits) - start
    return F.xxhash64(length, F.lit(part), F.substring(F.col("line"), start + shift + 1, size))


def index_keys(edits: int) -> Column:
    return F.array(*[_segment(F.col("n"), part, 0, edits) for part in range(edits + 1)])


def probe_keys(edits: int) -> Column:
    """Keys of the substrings to look up among lines of the same length and up to ``edits`` shorter."""
    keys = []
    for gap in range(edits + 1):
        for part in range(edits + 1):
            least = max(-part, gap - (edits - part))
            most = min(part, gap + (edits - part))
            keys += [_segment(F.col("n") - gap, part, shift, edits) for shift in range(least, most + 1)]
    return F.array(*keys)


CLASSES, _BITS = 16, 4


@F.pandas_udf(T.LongType())
def _class_counts(lines: pd.Series) -> pd.Series:
    """Counts of the code points by their last four bits, each modulo 16, in one long."""
    points = np.frombuffer("".join(lines).encode("utf-32-le"), dtype="<u4") % CLASSES
    sizes = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    owners = np.repeat(np.arange(len(lines)) * CLASSES, sizes)
    counts = np.bincount(owners + points, minlength=CLASSES * len(lines)).reshape(-1, CLASSES) % (1 << _BITS)
    packed = (counts.astype(np.uint64) << (np.arange(CLASSES, dtype=np.uint64) * np.uint64(_BITS))).sum(1, dtype=np.uint64)
    return pd.Series(packed.view(np.int64))


def _count_distance(a: str, b: str) -> Column:
    """Lower bound of the sum of differences of two packed counts."""
    total = F.lit(0)
    for at in range(0, CLASSES * _BITS, _BITS):
        one, two = (F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << _BITS) - 1)).cast("int") for c in (a, b))
        gap = F.abs(one - two)
        total = total + F.least(gap, F.lit(1 << _BITS) - gap)
    return total


def _maybe_broadcast(df: DataFrame, most: int) -> DataFrame:
    """Broadcast a written table of checked size; a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def _segments(documents: DataFrame, repeated: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(h, n, counts, own, sought): each distinct line with its index and probe keys, from its first document."""
    lines = _lines(documents, True, min_chars).withColumn("n", F.char_length("line"))
    first = lines.join(repeated.select("h", "g", "first_id"), ["h", "g"], "left").filter(
        F.col("first_id").isNull() | (F.col("first_id") == F.col("k_id"))
    )
    return saved(
        first.select("h", "n", _class_counts("line").alias("counts"), index_keys(edits).alias("own"), probe_keys(edits).alias("sought")),
        "line-segments",
    )


def _ordered() -> Column:
    """Whether a line ``b`` looks up line ``a``: the longer one the shorter, of two lines of one length the greater hash the other."""
    longer = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    return (F.col("a") != F.col("b")) & longer


def _candidates(keyed: DataFrame, families: DataFrame | None, edits: int) -> DataFrame:
    """Distinct pairs of line hashes (a, b) that share a segment which is no family's, a < b."""
    index = keyed.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"), F.explode("own").alias("key"))
    probe = keyed.select(F.col("h").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"), F.explode("sought").alias("key"))
    if families is not None:
        index = index.join(families.select("key"), "key", "left_anti")
    near = _ordered() & (_count_distance("ca", "cb") <= 2 * edits)
    met = index.join(probe, (index.key == probe.key) & near)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def variants(core: str, edits: int) -> set[str]:
    """A string and all that is left of it after up to ``edits`` deletions."""
    level, found = {core}, {core}
    for _ in range(edits):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        found |= level
    return found


def _variant_count(length: Column, edits: int) -> Column:
    """Upper bound of the number of variants of a string."""
    total, term = F.lit(1.0), F.lit(1.0)
    for k in range(1, edits + 1):
        term = term * F.greatest(length - (k - 1), F.lit(0)) / k
        total = total + term
    return total


@F.pandas_udf(T.StructType([T.StructField("head", T.IntegerType()), T.StructField("tail", T.IntegerType())]))
def _common_ends(lines: pd.Series, others: pd.Series) -> pd.DataFrame:
    """Lengths of the common start and the common end of two lines."""
    rows = []
    for line, other in zip(lines, others):
        rows.append((len(commonprefix([line, other])), len(commonprefix([line[::-1], other[::-1]]))))
    return pd.DataFrame(rows, columns=["head", "tail"])


def _families(documents: DataFrame, keyed: DataFrame, edits: int, min_chars: int, family: int, sampled: int, rows: int) -> tuple | None:
    """(families, members) of the segments that many lines share and whose lines are alike enough for variants.

    Members are (key, side, h, g, n, core); side 0 is the line that has the
    segment, 1 a line that looks it up.  None without such segments.
    """
    # which segments are taken decides the way, not the result, so a sample of the lines is enough to find them
    some = keyed.filter(F.pmod("h", F.lit(sampled)) == 0).select(F.explode("own").alias("key"))
    large = saved(some.groupBy("key").count().filter(F.col("count") * sampled > family).select("key"), "shared-segments")
    if large.isEmpty():
        return None
    large = _maybe_broadcast(large, rows)
    sides = [
        keyed.select(F.lit(side).alias("side"), "h", "n", F.explode(F.array_distinct(keys)).alias("key")).join(large, "key", "left_semi")
        for side, keys in enumerate(("own", "sought"))
    ]
    members = saved(sides[0].unionByName(sides[1]), "family-members")
    hashes = saved(members.select("h").distinct(), "family-hashes")
    texts = (
        _lines(documents, True, min_chars).join(_maybe_broadcast(hashes, rows), "h", "left_semi")
        .select("h", "g", "line").dropDuplicates(["h", "g"])
    )
    told = saved(members.join(texts, "h"), "family-lines")
    firsts = told.groupBy("key").agg(F.min("line").alias("first"))
    ends = told.join(firsts, "key").select("key", "side", "n", _common_ends("line", "first").alias("e"))
    bounds = ends.groupBy("key").agg(
        F.min("e.head").alias("head"), F.min("e.tail").alias("tail"), F.min("n").alias("least"), F.max("n").alias("most"),
        F.count_if(F.col("side") == 0).alias("lines"),
    )
    bounds = bounds.withColumn("tail", F.least("tail", F.col("least") - F.col("head")))
    cost = _variant_count(F.col("most") - F.col("head") - F.col("tail"), edits)
    families = saved(bounds.withColumn("cost", cost).filter(F.col("cost") < F.col("lines")).select("key", "head", "tail"), "families")
    if families.isEmpty():
        return None
    core = F.substring(F.col("line"), F.col("head") + 1, F.col("n") - F.col("head") - F.col("tail"))
    cores = told.join(families, "key").select("key", "side", "h", "g", "n", core.alias("core"))
    return families, saved(cores, "family-cores")


def _family_links(members: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Links (a, b) of nodes inside families: lines that share a variant, verified on what the family does not have in common."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def keys(cores: pd.Series) -> pd.Series:
        signed = lambda word: xxhash.xxh64_intdigest(word.encode()) - (1 << 63)
        return pd.Series([[signed(word) for word in variants(core, edits)] for core in cores], dtype=object)

    @F.pandas_udf(T.BooleanType())
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([within(a, b, edits) for a, b in zip(left, right)], dtype=bool)

    known = members.join(texts.select("h", "g", "node"), ["h", "g"]).withColumn("v", F.explode(keys("core")))
    # few bytes in, many pairs out: a fixed number of tasks, which adaptive execution does not merge
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    one = known.filter("side = 0").select(
        "key", "v", F.col("h").alias("a"), F.col("n").alias("na"), F.col("core").alias("la"), F.col("node").alias("one")
    ).repartition(tasks, "key", "v")
    two = known.filter("side = 1").select(
        F.col("key").alias("key2"), F.col("v").alias("v2"), F.col("h").alias("b"), F.col("n").alias("nb"), F.col("core").alias("lb"),
        F.col("node").alias("two"),
    ).repartition(tasks, "key2", "v2")
    # the plain distance only spares the shuffle of pairs that share a variant and are farther apart
    met = one.join(two, (F.col("key") == F.col("key2")) & (F.col("v") == F.col("v2")) & _ordered() & (F.levenshtein("la", "lb", edits) >= 0))
    pairs = met.select("one", "two", "la", "lb").dropDuplicates(["one", "two"])
    return pairs.filter(close("la", "lb")).select(F.col("one").alias("a"), F.col("two").alias("b"))


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Links (a, b) of the nodes of ``texts`` whose lines are within ``edits``."""

    @F.pandas_udf(T.BooleanType())
    def close(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([within(a, b, edits) for a, b in zip(left, right)], dtype=bool)

    one = texts.select(F.col("h").alias("a"), F.col("node").alias("na"), F.col("line").alias("la"))
    two = texts.select(F.col("h").alias("b"), F.col("node").alias("nb"), F.col("line").alias("lb"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.filter(close("la", "lb")).select(F.col("na").alias("a"), F.col("nb").alias("b"))


def duplicate_lines(
    documents: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, broadcast_rows: int = BROADCAST_ROWS, short: bool = False,
    family: int = FAMILY, sampled: int = SAMPLED,
) -> DataFrame:
    """One row per line of at least ``min_chars`` code points; with ``short``, also per shorter line that is not blank.

    Columns: k_id, k_text (the document), line_no (from 0), class_k_id,
    class_k_text, class_line_no (the first line of the class: by document id,
    null as -1, then text hash, then place), n_links (other line texts within
    ``edits``), kept (it is that first line).  A class is a connected component
    of equal and near lines; shorter lines are in classes of equal ones, with
    no links.  Lines end at line feeds only.  Null and empty
    texts have no lines; repeated rows are one document and get equal rows; no
    rows give no rows; columns other than doc_id and text are not touched.
    """
    documents = documents.select("doc_id", "text")
    places = saved(_lines(documents, False, min_chars, short).drop("line"), "line-places")
    counted = places.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("k_id").alias("first_id"))
    repeated = saved(counted.filter("n > 1"), "repeated-lines")
    keyed = _segments(documents, _maybe_broadcast(repeated, broadcast_rows), edits, min_chars)
    families, members = _families(documents, keyed, edits, min_chars, family, sampled, broadcast_rows) or (None, None)
    pairs = saved(_candidates(keyed, None if families is None else _maybe_broadcast(families, broadcast_rows), edits), "line-pairs")
    paired = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h")))
    wanted = saved((paired if members is None else paired.union(members.select("h"))).distinct(), "paired-lines")
    texts = saved(
        _lines(documents, True, min_chars).join(_maybe_broadcast(wanted, broadcast_rows), "h", "left_semi")
        .select("h", "g", "line").dropDuplicates(["h", "g"]).withColumn("node", F.monotonically_increasing_id()),
        "line-texts",
    )
    found = _verified(pairs, texts, edits)
    if members is not None:
        inside = _family_links(members, texts, edits)
        found = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(
            inside.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        )
    links = saved(found.distinct(), "line-links")
    degree = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    linked = texts.select("h", "g", "node").join(degree, "node").join(components(links), "node", "left")
    named = linked.select("h", "g", "n_links", F.coalesce("root", "node").alias("root"))
    # a class that is one repeated line is named by its own hash
    members = saved(
        named.join(repeated, ["h", "g"], "full").select(
            "h", "g", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("root", "h").alias("class_a"),
            F.when(F.col("root").isNull(), F.col("g")).otherwise(F.lit(0)).alias("class_b"),
            F.col("root").isNull().alias("class_c"),
        ),
        "line-classes",
    )
    key = ["class_a", "class_b", "class_c"]
    first = places.join(members, ["h", "g"]).groupBy(*key).agg(F.min(F.struct("k_id", "k_text", "line_no")).alias("first"))
    classes = members.join(first, key).select("h", "g", "n_links", "first")
    here = F.struct("k_id", "k_text", "line_no")
    return places.join(classes, ["h", "g"], "left").select(
        "k_id", "k_text", "line_no",
        F.coalesce("first.k_id", "k_id").alias("class_k_id"), F.coalesce("first.k_text", "k_text").alias("class_k_text"),
        F.coalesce("first.line_no", "line_no").alias("class_line_no"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("first").isNull() | (F.col("first") == here)).alias("kept"),
    )


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, gone: pd.Series) -> pd.Series:
    kept = []
    for text, numbers in zip(texts, gone):
        drop = set(numbers)
        kept.append("\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop))
    return pd.Series(kept, dtype=object)


def drop_duplicate_lines(documents: DataFrame, **options: int) -> DataFrame:
    """Documents without the lines that repeat an earlier line, or nearly so; n_chars, if there, follows the text.

    Repeats of lines below the length of the edit join go if they are exact; blank lines stay.  Every document stays, some with an empty text; columns are those of the input.
    """
    gone = (
        duplicate_lines(documents, short=True, **options).filter("not kept").groupBy("k_id", "k_text")
        .agg(F.collect_set("line_no").alias("__gone"))  # at most the lines of one document
    )
    named = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), *identity())
    row, untouched = F.col("__row"), F.col("__gone").isNull()
    shorter = _without(F.coalesce(row["text"], F.lit("")), F.coalesce("__gone", F.array().cast("array<int>")))
    joined = named.join(gone, ["k_id", "k_text"], "left").withColumn("__text", F.when(untouched, row["text"]).otherwise(shorter))
    changed = {"text": F.col("__text")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.when(untouched, row["n_chars"]).otherwise(F.char_length("__text").cast("long"))
    return joined.select(*[changed.get(c, row[c]).alias(c) for c in documents.columns])
