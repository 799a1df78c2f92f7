"""Benchmark decontamination by a prefix-filtered set join, in native columns only.

An item's windows are its runs of ``window`` words (a shorter item is one
window).  A window is a set of word shingles; it occurs in a document only if
all of them do, so its necessary prefix is one shingle, and the rarest in the
corpus is taken.  That shingle is joined with the documents' shingles; the
window must then fit around it (positional bound) and into the document
(length bound), and its words are compared one by one.

Texts are read and split once.  A document position whose shingle occurs in
the benchmark keeps the words around it, as far as a window can reach, so
nothing has to go back to the texts, and no text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import ascii_lower, identity, saved

WINDOW = 13
SHINGLE = 5
# Hashed shingles of the benchmark that one broadcast may hold (8 bytes each);
# a larger benchmark is joined block by block, each against all documents.
BROADCAST_SHINGLES = 4_000_000
HIT_SHARE = 20  # contaminated if at least one word in so many is hit

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words of ASCII letters, digits and all other characters from U+0080 on."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), _SEPARATORS), "")


def _shingle_hash(size: int, at: Column) -> Column:
    return F.xxhash64(F.lit(size), *[F.get(F.col("words"), at + i) for i in range(size)])


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, window) with the window's words joined by blanks; items without words have none."""
    split = items.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.lit(window), F.size("words"))
    starts = split.select("item_id", "words", length.alias("length")).select(
        "item_id", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at")
    )
    return starts.select("item_id", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("window")).distinct()


def window_shingles(windows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(window, length, size, offset, h) for every shingle of every distinct window."""
    parts = windows.select("window").distinct().select("window", F.split("window", " ").alias("words"))
    sized = parts.withColumn("length", F.size("words")).withColumn("size", F.least(F.lit(shingle), F.col("length")))
    placed = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))).alias("offset"))
    hashed = F.coalesce(
        *[F.when(F.col("size") == k, _shingle_hash(k, F.col("offset"))) for k in range(1, shingle + 1)]
    )
    return placed.select("window", "length", "size", "offset", hashed.alias("h"))


def _positions(documents: DataFrame, sizes: list[int]) -> DataFrame:
    """A row per word position and shingle size, and one at -1 for the document itself."""
    split = documents.select("doc_id", *identity(), words(F.col("text")).alias("words"))
    counted = split.withColumn("n_words", F.size("words"))
    placed = counted.select("*", F.explode(F.expr("sequence(-1, n_words - 1)")).alias("pos"))
    whole = [(F.col("pos") >= 0) & (F.col("pos") + k <= F.col("n_words")) for k in sizes]
    hashes = [F.when(fits, _shingle_hash(k, F.col("pos"))) for k, fits in zip(sizes, whole)]
    if len(sizes) == 1:
        return placed.withColumn("h", hashes[0])
    # the row of the document itself must stay one row
    each = F.when(F.col("pos") < 0, F.array(F.lit(None).cast("long"))).otherwise(F.array(*hashes))
    return placed.select("*", F.explode(each).alias("h"))


def _hits(documents: DataFrame, shingles: DataFrame, window: int, shingle: int, most: int) -> DataFrame:
    """Document rows (pos -1) and the positions whose shingle occurs in the benchmark, with their surroundings."""
    known = saved(shingles.select("h", "size").distinct(), "shingles")
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())  # at most `shingle` values
    blocks = max(1, -(-known.count() // most))
    reach = window - min(sizes, default=shingle)  # words a window can have before its shingle
    first = F.greatest(F.lit(0), F.col("pos") - reach)
    around = F.slice("words", first + 1, F.lit(window + reach))
    parts = []
    for block in range(blocks):
        rows = _positions(documents, sizes or [shingle])
        some = known.filter(F.pmod("h", F.lit(blocks)) == block).select(F.col("h").alias("known")).distinct()
        found = rows.join(F.broadcast(some), F.col("h") == F.col("known"), "left")
        parts.append(
            found.filter(F.col("known").isNotNull() | ((F.col("pos") < 0) & F.lit(block == 0))).select(
                "doc_id", "k_id", "k_text", "n_words", "pos", F.col("known").alias("h"),
                F.when(F.col("pos") >= 0, first).alias("first"), F.when(F.col("pos") >= 0, around).alias("around"),
            )
        )
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return saved(union, "hits")


def _prefixes(shingles: DataFrame, hits: DataFrame) -> DataFrame:
    """The rarest shingle of each window by its count over all documents, ties by hash; unseen: no occurrence."""
    counts = hits.filter("h is not null").groupBy("h").agg(F.count("*").alias("n"))
    ranked = shingles.join(counts, "h", "left").groupBy("window", "length").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("p")
    )
    return ranked.filter("p.n > 0").select("window", "length", "p.h", "p.offset")


def occurrences(hits: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Distinct verified occurrences (k_id, k_text, start, stop, window)."""
    start = F.col("pos") - F.col("offset")
    joined = hits.filter("h is not null").join(prefixes, "h").filter((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    same = F.array_join(F.slice("around", start - F.col("first") + 1, F.col("length")), " ") == F.col("window")
    return (
        joined.filter(same)
        .select("k_id", "k_text", start.alias("start"), (start + F.col("length")).alias("stop"), "window")
        .distinct()
    )


def _hit_words(found: DataFrame) -> DataFrame:
    """Words inside the union of the occurrences of a document."""
    spans = found.select("k_id", "k_text", "start", "stop").distinct()
    covered = F.expr(
        "greatest(0, stop - greatest(start, coalesce(max(stop) OVER "
        "(PARTITION BY k_id, k_text ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))"
    )
    return spans.select("k_id", "k_text", covered.alias("n")).groupBy("k_id", "k_text").agg(F.sum("n").alias("n_hit"))


def contamination(
    documents: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    broadcast_shingles: int = BROADCAST_SHINGLES,
) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, k_id, k_text.

    Null and wordless texts have no words and are never contaminated; items
    without words have no window; repeated items count once, an item without
    an id marks words but is not listed.  Repeated document rows get equal
    results; a null doc_id is returned as such.  Empty tables give no rows, or
    no hits.  Other columns are not touched.
    """
    windows = saved(item_windows(items.select("item_id", "text"), window), "windows")
    shingles = saved(window_shingles(windows, shingle), "window-shingles")
    hits = _hits(documents.select("doc_id", "text"), shingles, window, shingle, broadcast_shingles)
    found = saved(occurrences(hits, _prefixes(shingles, hits)), "occurrences")
    listed = (
        found.select("k_id", "k_text", "window").distinct().join(windows, "window")
        .groupBy("k_id", "k_text").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        hits.filter("pos < 0").select("doc_id", "k_id", "k_text", F.col("n_words").cast("long").alias("n_words"))
        .join(_hit_words(found), ["k_id", "k_text"], "left")
        .join(listed, ["k_id", "k_text"], "left")
        .select(
            "doc_id", "n_words", n_hit.alias("n_hit"),
            F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
            ((n_hit > 0) & (n_hit * HIT_SHARE >= F.col("n_words"))).alias("contaminated"), "k_id", "k_text",
        )
    )


def keep_clean(documents: DataFrame, items: DataFrame, **options: int) -> DataFrame:
    """The document rows that are not contaminated, with the columns of the input."""
    bad = contamination(documents, items, **options).filter("contaminated").select("k_id", "k_text").distinct()
    named = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("__row"), *identity())
    return named.join(bad, ["k_id", "k_text"], "left_anti").select("__row.*")
