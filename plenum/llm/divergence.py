"""Quality rules: base counts, then Jensen-Shannon distance to language references.

Each language's reference has two histograms over all its documents: character
classes, and its most common words beside all others.  A document whose own
histograms are farther from the reference than its length explains is dropped;
below a minimum length its histograms say too little, and it is kept.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plenum.llm.common import saved

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
COMMON_WORDS = 100
# Guards: shorter documents are not compared.
GUARD_CHARS, GUARD_WORDS = 200, 100
# A distance is too large above base + slack / sqrt(length).
CHAR_LIMIT, CHAR_SLACK = 0.24, 2.0
WORD_LIMIT, WORD_SLACK = 0.28, 2.0
# A language needs so many words for a reference.
REFERENCE_WORDS = 1_000
# So many references, a kilobyte or two each, meet a document of another language at once.
BLOCK = 16

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\x0b\x0c\r"
_GROUPS = (b"aeiou", b"bcdfghjklmnpqrstvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", BLANKS[1:], b".,;:", b"!?", SYMBOLS)
CLASSES = len(_GROUPS) + 2  # other ASCII, and characters from U+0080 on


def _class_table() -> np.ndarray:
    table = np.full(256, len(_GROUPS), dtype=np.int64)
    for number, members in enumerate(_GROUPS):
        table[list(members)] = number
    table[0xC0:] = len(_GROUPS) + 1
    return table


_CLASS = _class_table()


def byte_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text, np.uint8), minlength=256)


def char_classes(count: np.ndarray) -> np.ndarray:
    """Characters by class: first bytes only, continuation bytes count for nothing."""
    first = count.copy()
    first[0x80:0xC0] = 0
    return np.bincount(_CLASS, weights=first, minlength=CLASSES)


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more; ``ids`` number the distinct words."""
    total = len(ids) - window + 1
    if total < 2:
        return 0
    mixed, wide = np.zeros(total, dtype=np.uint64), ids.astype(np.uint64)
    for at in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + wide[at : at + total]
    _, place, times = np.unique(mixed, return_inverse=True, return_counts=True)
    suspects = np.flatnonzero(times[place] > 1)
    seen: dict[bytes, list[int]] = {}
    for at in suspects.tolist():  # equal hashes are compared by their words
        seen.setdefault(ids[at : at + window].tobytes(), []).append(at)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    for places in seen.values():
        if len(places) > 1:
            np.add.at(edge, places, 1)
            np.add.at(edge, np.add(places, window), -1)
    return int((np.cumsum(edge) > 0).sum())


def js_distance(counts: np.ndarray, reference: np.ndarray) -> float:
    """Jensen-Shannon distance (base 2, from 0 to 1) of two histograms; an empty one is at distance 0."""
    if not counts.sum() or not reference.sum():
        return 0.0
    p, q = counts / counts.sum(), reference / reference.sum()
    middle = (p + q) / 2
    part = lambda a: float((a[a > 0] * np.log2(a[a > 0] / middle[a > 0])).sum())
    return float(np.sqrt(max(0.0, (part(p) + part(q)) / 2)))


class Reference:
    """Histograms of one language, read from the form in which the table of references keeps them.

    Three lines: the common words, their counts and that of all other words, the character classes.
    """

    def __init__(self, packed: bytes):
        words, counts, chars = packed.split(b"\n")
        self.words = words.split()
        self.counts = np.array(counts.split(), dtype=np.float64)
        self.chars = np.array(chars.split(), dtype=np.float64)


_reference = lru_cache(maxsize=32 * BLOCK)(Reference)


class Histograms:
    """Character classes and words of one text."""

    def __init__(self, text: bytes):
        self.bytes, words = byte_counts(text), text.split()
        self.chars, self.n_words = char_classes(self.bytes), len(words)
        self.n_chars = int(self.chars.sum())
        self.number: dict[bytes, int] = {}
        self.ids = np.fromiter((self.number.setdefault(w, len(self.number)) for w in words), dtype=np.int64, count=self.n_words)
        self.times = np.bincount(self.ids, minlength=len(self.number))

    def excess(self, reference: Reference) -> tuple[float, float]:
        """By how much the two distances pass their limits; never above zero below the guards."""
        char = word = -1.0
        if self.n_chars >= GUARD_CHARS:
            char = js_distance(self.chars, reference.chars) - CHAR_LIMIT - CHAR_SLACK / np.sqrt(self.n_chars)
        if self.n_words >= GUARD_WORDS:
            own = [self.times[self.number[w]] if w in self.number else 0 for w in reference.words]
            own = np.array([*own, self.n_words - sum(own)], dtype=np.float64)
            word = js_distance(own, reference.counts) - WORD_LIMIT - WORD_SLACK / np.sqrt(self.n_words)
        return float(char), float(word)


def measure(text: bytes | None, packed: bytes | None) -> tuple:
    """One text's row of ``MEASURED``, with the excesses over its own language's reference if it has one."""
    text = text or b""
    found = Histograms(text)
    seen, n_dup = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            n_dup += line in seen
            seen.add(line)
    n_repeat = repeated_words(found.ids)
    failed = found.n_words < MIN_WORDS or 100 * n_repeat > REPEAT_PERCENT * found.n_words
    word_chars = found.n_chars - int(found.bytes[list(BLANKS)].sum())
    char, word = (None, None) if packed is None else found.excess(_reference(packed))
    return found.n_words, word_chars, int(found.bytes[list(SYMBOLS)].sum()), n_dup, n_repeat, failed, char, word


def nearest(text: bytes | None, lang: str | None, block: list[dict]) -> tuple[float, int, str, float, float]:
    """The reference of a block that a text passes least: larger excess, 0 if it is the text's language, language, both."""
    found, best = Histograms(text or b""), []
    for row in block:
        char, word = found.excess(_reference(bytes(row["packed"])))
        best.append((max(char, word), int(row["lang"] != lang), row["lang"], char, word))
    return min(best)


def _struct(**types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in types.items()])


_COUNTS = dict.fromkeys(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), T.LongType())
_EXCESS = dict.fromkeys(("char_excess", "word_excess"), T.DoubleType())
MEASURED = _struct(**_COUNTS, base_failed=T.BooleanType(), **_EXCESS)
NEAREST = _struct(most=T.DoubleType(), foreign=T.IntegerType(), lang=T.StringType(), **_EXCESS)
RESULT = _struct(**_COUNTS, base_failed=T.BooleanType(), kept=T.BooleanType(), **_EXCESS)


@F.pandas_udf(T.ArrayType(T.LongType()))
def _classes(texts: pd.Series) -> pd.Series:
    return pd.Series([char_classes(byte_counts(t or b"")).astype(np.int64) for t in texts], dtype=object)


@F.pandas_udf(MEASURED)
def _measure(texts: pd.Series, packed: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t, p) for t, p in zip(texts, packed)], columns=MEASURED.names)


@F.pandas_udf(NEAREST)
def _nearest(texts: pd.Series, langs: pd.Series, blocks: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([nearest(*row) for row in zip(texts, langs, blocks)], columns=NEAREST.names)


def references(documents: DataFrame, common: int = COMMON_WORDS) -> DataFrame:
    """(lang, packed): the reference of every language, from all its documents, as ``Reference`` reads it."""
    named = documents.select("lang", "text").filter("lang is not null and text is not null")
    counts = saved(
        named.select("lang", F.explode(F.split("text", r"[\x20\x09-\x0D]+")).alias("word")).filter("word <> ''")
        .groupBy("lang", "word").agg(F.count("*").alias("n")),
        "language-words",
    )
    large = saved(counts.groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= REFERENCE_WORDS), "languages")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.join(large, "lang", "left_semi").withColumn("rank", rank).filter(F.col("rank") <= common)
    words = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "word", "n"))).alias("top"), F.sum("n").alias("inside"))
    sums = [F.sum(F.get("classes", F.lit(i))) for i in range(CLASSES)]
    chars = named.select("lang", _classes(F.col("text").cast("binary")).alias("classes")).groupBy("lang").agg(F.array(*sums).alias("chars"))
    others = F.array(F.col("total") - F.col("inside"))
    lines = ("top.word", F.concat("top.n", others).cast("array<string>"), F.col("chars").cast("array<string>"))
    packed = F.concat_ws("\n", *[F.array_join(line, " ") for line in lines])
    return saved(words.join(large, "lang").join(chars, "lang").select("lang", packed.cast("binary").alias("packed")), "references")


def judge(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document row: doc_id, the base counts, base_failed, kept, and both excesses.

    A document is held against the reference of its language, joined by
    ``lang``; only those too far from it, or without one, meet all references,
    block by block, and the nearest one judges (of equally near ones its own,
    then the first by name).  One row per input row, repeated rows included; a
    null text has no words and so fails; a null or unknown language has no
    reference of its own.  Without any reference both excesses are 0.  No rows
    give no rows; columns other than doc_id, text and lang are not touched.
    """
    documents = documents.select("doc_id", "text", "lang")
    known = references(documents) if known is None else known
    blocks = -(-known.count() // BLOCK)
    content = F.col("text").cast("binary")
    measured = documents.join(known, "lang", "left").select("doc_id", "lang", "text", _measure(content, "packed").alias("r"))
    measured = measured.select("doc_id", "lang", "text", "r.*")
    if not blocks:
        return _verdicts(measured, F.lit(0.0), F.lit(0.0))
    # a document that is far from its own language, or has none, may be near another
    far = F.coalesce(F.greatest(*_EXCESS) > 0, F.lit(True))
    measured = saved(
        measured.withColumns({"row": F.monotonically_increasing_id(), "far": far, "text": F.when(far, F.col("text"))}), "measured"
    )
    dealt = known.groupBy(F.pmod(F.xxhash64("lang"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("lang", "packed")).alias("block_rows"))
    met = measured.filter("far").select("row", "lang", "text", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"))
    best = met.join(dealt, "block").select("row", _nearest(content, "lang", "block_rows").alias("n")).groupBy("row").agg(F.min("n").alias("n"))
    judged = measured.drop("text").join(best, "row", "left")
    return _verdicts(judged, *[F.coalesce(f"n.{name}", name) for name in _EXCESS])


def _verdicts(measured: DataFrame, char: Column, word: Column) -> DataFrame:
    kept = ~F.col("base_failed") & (F.greatest(char, word) <= 0)
    return measured.select(
        "doc_id", *_COUNTS, "base_failed", kept.alias("kept"), char.alias("char_excess"), word.alias("word_excess")
    )
