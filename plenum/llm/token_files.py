"""Token ids as Parquet list columns, in document order, read back selectively.

Documents are range-partitioned and sorted by id, encoded with the tokenizers
library and written by Spark: one file per range, ids dictionary- or
delta-encoded, with row groups and pages of chosen size.  Parquet's page
indexes let a reader take the metadata columns alone, or the ids of a range of
documents, without touching the rest.

Texts are cut where no match of the tokenizer's split pattern can cross: before
a blank that a character other than white space follows, between a letter or
digit and a full stop or comma, and around a lone line feed.  The chunks are
encoded the same alone as inside their text, and repeat a lot, so each worker
keeps the ids of chunks it has met.  Some megabytes of text are cut at once, by
their bytes, and Arrow finds the distinct chunks in them; the new ones go to the
library together, one text with a line feed between them.  Tokens that the tokenizer's file adds to
the vocabulary are found before anything else, as the library does.

A task that writes a file also writes where each row begins among the ids of its
range, so readers only add the totals of earlier ranges.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 1_000
CACHED_CHUNKS = 700_000  # some 150 bytes each in a worker

LEARNED_CHUNKS = 20_000  # given to the library at once
PIECE_BYTES = 8 << 20  # of text that is cut and looked up at once


def _bytes_of(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for first, last in ranges:
        table[first : last + 1] = True
    return table


_BLANKS = _bytes_of((9, 13), (28, 32))
_ALNUM = _bytes_of((48, 57), (65, 90), (97, 122))
# first bytes of two-byte characters that are letters throughout, but for the signs of multiplication and division
_LETTERS = _bytes_of((0xC3, 0xC8), (0xD0, 0xD1))
_WIDE_BLANKS = [c.encode() for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
_TWO_BYTES = np.array([int.from_bytes(c) for c in _WIDE_BLANKS if len(c) == 2])
_THREE_BYTES = np.array([int.from_bytes(c) for c in _WIDE_BLANKS if len(c) == 3])


def _wide_blanks(data: np.ndarray) -> np.ndarray:
    """Where characters beyond ASCII are white space, byte by byte and one more."""
    wide = np.zeros(len(data) + 1, dtype=bool)
    at = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    padded = np.append(data, np.zeros(2, np.uint8))
    two = (padded[at].astype(np.int32) << 8) + padded[at + 1]
    for found, size in ((np.isin(two, _TWO_BYTES), 2), (np.isin((two << 8) + padded[at + 2], _THREE_BYTES), 3)):
        for k in range(size):
            wide[at[found] + k] = True
    return wide


def _bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins in them, with the end of the last."""
    _, bounds, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(texts) + 1, dtype=np.int32)
    bounds = np.frombuffer(bounds, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where chunks begin in texts (valid UTF-8) that follow each other in ``data``, each from one of ``starts`` on."""
    first = np.zeros(len(data) + 1, dtype=bool)
    first[starts] = True
    first[-1] = True
    at = np.flatnonzero((data == 32) | (data == 10) | (data == 44) | (data == 46))
    sign, before, after = data[at], data[at - 1], data.take(at + 1, mode="clip")
    wide = _wide_blanks(data)
    shown_after = ~(first[at + 1] | _BLANKS[after] | wide[at + 1])
    shown_before = ~(first[at] | _BLANKS[before] | wide[at - 1])
    letter = _ALNUM[before]
    beyond = np.flatnonzero(before >= 0x80)
    lead, last = data[at[beyond] - 2], before[beyond]
    letter[beyond] = _LETTERS[lead] & (last < 0xC0) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    spaces = at[(sign == 32) & shown_after]
    points = at[((sign == 46) | (sign == 44)) & letter & shown_before]
    lines = at[(sign == 10) & shown_after & shown_before]
    for cuts in (spaces, points, lines, lines + 1):
        first[cuts] = True
    return np.flatnonzero(first[:-1])


# Chunks of letters that are letters in every version of Unicode; with others the library decides.
_ASCII_WORD = re.compile(r"^ ?[A-Za-z]+$", re.M)
_LATIN_WORD = re.compile(r"^ ?[A-Za-z]*[À-ÖØ-öø-ɏ][A-Za-zÀ-ÖØ-öø-ɏ]*$", re.M)
# Letters, then marks: two matches of the split pattern, if no mark is an apostrophe.
_MARKED_WORD = re.compile(r"^ ?[A-Za-z]+[!-&(-/:-@\[-`{-~]+$", re.M)
_MARKS = re.compile(r"(?<=[A-Za-z])(?=[^A-Za-z\n])")


def _byte_characters() -> dict[int, str]:
    """The character that stands for a byte in a byte-level vocabulary, where it is not the same; line feeds stay."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + at) for at, b in enumerate(hidden) if b != 10}


_BYTE_CHARS = _byte_characters()
_BYTE_MAP = "".join(_BYTE_CHARS.get(b, chr(b)) for b in range(256))


class ChunkEncoder:
    """A tokenizer with the ids of chunks it has seen.

    Chunks are told apart by Arrow, a piece of a batch at a time, so only distinct ones are looked
    up.  A chunk has a number; its ids are a run of ``pool``.  A full store keeps the chunks
    that came up again since it was last full, the earliest half at most.
    """

    def __init__(self, file: str):
        self.library = Tokenizer.from_file(file)
        vocabulary = self.library.get_vocab()
        # a byte-level token has one character per byte
        self.sizes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, number in vocabulary.items():
            self.sizes[number] = len(token)
        # the same merges over words that are mapped already, one to a line
        self.words = Tokenizer.from_file(file)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        added = self.library.get_added_tokens_decoder()
        odd = {n for n, t in added.items() if t.lstrip or t.rstrip or t.single_word or t.normalized}
        self.odd = tuple(added[n].content for n in odd)  # texts with one of these go to the library whole
        cut = {added[n].content: n for n in added if n not in odd}
        self.added = tuple(sorted(cut, key=len, reverse=True))
        self.at_added = re.compile("|".join(map(re.escape, self.added)) and f"({'|'.join(map(re.escape, self.added))})")
        self.known: dict[str, int] = {content: at for at, content in enumerate(cut)}
        self.pool = np.array(list(cut.values()), dtype="<u4")
        self.starts = np.arange(len(cut))
        self.lengths = np.ones(len(cut), dtype=np.int64)
        self.again = np.ones(len(cut), dtype=bool)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.chars, self.n_base = 0, len(cut)

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, chunks: list[str]) -> None:
        """Have the library encode new chunks, as few texts of many chunks."""
        # a chunk of letters is one match of the split pattern, so only the merges are left to do
        lines = "\n".join(c for c in chunks if "\n" not in c and not (self.odd and any(map(c.__contains__, self.odd))))
        plain, other = _ASCII_WORD.findall(lines), _LATIN_WORD.findall(lines)
        if plain:
            self._store(plain, map(len, plain), self._merge("\n".join(plain).replace(" ", _BYTE_CHARS[32])), 0)
        if other:
            mapped = codecs.charmap_decode("\n".join(other).encode(), "strict", _BYTE_MAP)[0]
            self._store(other, map(len, map(str.encode, other)), self._merge(mapped), 0)
        marked = _MARKED_WORD.findall(lines)
        if marked:
            parts = _MARKS.sub("\n", "\n".join(marked))
            self._store(marked, map(len, marked), self._merge(parts.replace(" ", _BYTE_CHARS[32])), 0)
        joined = []
        for chunk in set(chunks).difference(plain, other, marked):
            alone = chunk[-1].isspace() or chunk[0].isspace() and (chunk[0] != " " or chunk[1:2].isspace())
            if alone or any(map(chunk.__contains__, self.odd)):
                ids = self._plain(chunk)  # a line feed beside it would join its white space, or that of an added token
                self._add([chunk], len(chunk), ids, np.zeros(1, np.int64), np.array([len(ids)]))
            else:
                joined.append(chunk)
        if joined:
            self._store(joined, map(len, map(str.encode, joined)), self._plain("\n".join(joined)), 1)

    def _merge(self, mapped: str) -> np.ndarray:
        return np.array(self.words.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, dtype="<u4")

    def _store(self, chunks: list[str], lengths: Iterable[int], ids: np.ndarray, between: int) -> None:
        """Cut ids at the ends of the chunks; ``between`` ids (of a line feed) stand between two."""
        ends = np.cumsum(np.fromiter(lengths, dtype=np.int64, count=len(chunks)) + between) - between
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
        starts = np.concatenate([[0], stops[:-1] + between])
        self._add(chunks, int(ends[-1]), ids, starts, stops - starts)

    def _add(self, chunks: list[str], chars: int, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + len(chunks))))
        self.new.append((ids, starts, lengths))
        self.chars += chars

    def _settle(self) -> None:
        """Append the ids of new chunks to the pool."""
        ids, starts, lengths = zip(*self.new)
        places = np.cumsum([len(self.pool), *map(len, ids[:-1])])
        self.pool = np.concatenate([self.pool, *ids])
        self.starts = np.concatenate([self.starts, *(s + place for s, place in zip(starts, places))])
        self.lengths = np.concatenate([self.lengths, *lengths])
        self.again = np.append(self.again, np.zeros(len(self.starts) - len(self.again), dtype=bool))
        self.new = []

    def _trim(self) -> None:
        """Keep the store within bounds; ids that are forgotten are found again."""
        if len(self.known) <= CACHED_CHUNKS and max(self.chars, len(self.pool)) <= 16 * CACHED_CHUNKS:
            return
        self.again[: self.n_base] = True
        chunks, kept = list(self.known), np.flatnonzero(self.again)[: self.n_base + CACHED_CHUNKS // 2]
        if len(kept) and max(sum(len(chunks[at]) for at in kept), self.lengths[kept].sum()) > 8 * CACHED_CHUNKS:
            kept = kept[: self.n_base]
        self.known = {chunks[at]: number for number, at in enumerate(kept.tolist())}
        self.pool, self.lengths = self._ids(kept), self.lengths[kept]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.again = np.zeros(len(kept), dtype=bool)
        self.chars = sum(map(len, self.known))

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of chunks, one after the other."""
        lengths = self.lengths[numbers]
        skipped = self.starts[numbers] - np.cumsum(lengths) + lengths
        places = np.repeat(skipped.astype(np.int32), lengths)
        places += np.arange(len(places), dtype=np.int32)
        return self.pool[places]

    def _numbers(self, chunks: list[str]) -> np.ndarray:
        """The numbers of distinct chunks, which are learned where they are new."""
        numbers = np.fromiter(map(self.known.get, chunks, repeat(-1)), dtype=np.int64, count=len(chunks))
        missing = np.flatnonzero(numbers < 0)
        self.again[numbers[numbers >= 0]] = True
        if len(missing):
            fresh = [chunks[at] for at in missing.tolist()]
            for at in range(0, len(fresh), LEARNED_CHUNKS):
                self._learn(fresh[at : at + LEARNED_CHUNKS])
            self._settle()
            numbers[missing] = np.fromiter(map(self.known.__getitem__, fresh), dtype=np.int64, count=len(fresh))
        return numbers

    def _encode(self, texts: pa.StringArray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each text has, and all ids; texts that are ``whole`` are one chunk."""
        data, bounds = _bytes(texts)
        if not len(data):
            return np.zeros(len(texts), dtype=np.int64), np.zeros(0, dtype="<u4")
        cuts = chunk_starts(data, bounds[:-1])
        if whole is not None:
            text = np.searchsorted(bounds[:-1], cuts, side="right") - 1
            cuts = cuts[~whole[text] | (cuts == bounds[text])]
        offsets = np.append(cuts, len(data)).astype(np.int32)
        coded = pa.StringArray.from_buffers(len(cuts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        numbers = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(self.lengths[numbers])])
        return np.diff(ends[np.searchsorted(cuts, bounds)]), self._ids(numbers)

    def _parts(self, text: str) -> list[tuple[str, bool]]:
        """A text cut around the added tokens in it; those are whole, as are texts with an odd one."""
        if any(map(text.__contains__, self.odd)):
            return [(text, True)]
        return [(part, at % 2 == 1) for at, part in enumerate(self.at_added.split(text) if self.added else [text])]

    def encode_column(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of whole texts (without nulls) has, and the ids of all, one after the other."""
        self._trim()
        raw = _bytes(texts)[0].tobytes()
        if not any(token.encode() in raw for token in (*self.added, *self.odd)):
            return self._encode(texts)
        parts = list(map(self._parts, texts.to_pylist()))
        flat = [part for row in parts for part in row]
        sizes, ids = self._encode(pa.array([p for p, _ in flat], pa.string()), np.array([w for _, w in flat]))
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return np.diff(ends[np.concatenate([[0], np.cumsum([len(row) for row in parts])])]), ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        sizes, ids = self.encode_column(pa.array(texts, pa.string()))
        return [part.tobytes() for part in np.split(ids, np.cumsum(sizes))[: len(texts)]]


@lru_cache(maxsize=2)
def encoder(file: str) -> ChunkEncoder:
    return ChunkEncoder(file)


def _decoded(column: pa.Array) -> pa.StringArray:
    """Texts of a column of bytes: nulls are empty, bytes that are not UTF-8 become replacement characters."""
    try:
        return column.cast(pa.string()).fill_null("")
    except pa.ArrowInvalid:
        return pa.array([(raw or b"").decode("utf-8", "replace") for raw in column.to_pylist()], pa.string())


def _pieces(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """(first, count) of texts that have some ``PIECE_BYTES`` together, or one longer text."""
    begins = _bytes(texts)[1][:-1]
    firsts = np.append(np.flatnonzero(np.diff(begins // PIECE_BYTES, prepend=-1)), len(texts)).tolist()
    return zip(firsts, np.diff(firsts).tolist())


TOKENS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_hash", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("part", T.IntegerType()),
        T.StructField("before", T.LongType()),
    ]
)


def tokenized(documents: DataFrame, tokenizer_file: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, text_hash, n_tokens, ids, part, before) in ascending order of doc_id (nulls first), partition by partition.

    Each document ends with ``end_id``; null and empty texts are that id alone.
    Repeated rows are written as often as they come.  ``part`` rises with the order
    of the ranges, ``before`` counts the ids of the rows before in the same part.
    An id with very many rows is dealt to several ranges, by its texts and, for
    equal rows, by their place in the input.
    """
    file = tokenizer_file or public_tokenizers.path(TOKENIZER)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, total = encoder(file), TaskContext.get().partitionId(), 0
        kind = pa.list_(pa.field("element", pa.int32(), nullable=False))
        for batch in batches:
            texts = _decoded(batch.column("text"))
            for at, n in _pieces(texts):
                sizes, ids = coder.encode_column(texts.slice(at, n))
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.view("<i4")), type=kind)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, n), batch.column("text_hash").slice(at, n), pa.array(sizes), lists,
                     pa.array(np.full(n, part, np.int32)), pa.array(total + offsets[:-1])],
                    names=TOKENS.names,
                )
                total += int(offsets[-1])

    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"),
        F.monotonically_increasing_id().alias("place"),
    )
    ranges = rows.repartitionByRange("doc_id", "text_hash", "place").sortWithinPartitions("doc_id", "text_hash")
    return ranges.drop("place").mapInArrow(encode, TOKENS)


def write_tokens(
    documents: DataFrame,
    path: str,
    tokenizer_file: str | None = None,
    end_id: int = END_ID,
    encoding: str = "dictionary",
    row_group_bytes: int = ROW_GROUP_BYTES,
    page_bytes: int = PAGE_BYTES,
    page_rows: int = PAGE_ROWS,
) -> None:
    """Write token files below ``path``; ``encoding`` of the ids is ``dictionary`` or ``delta``."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"unknown encoding {encoding}")
    tokenized(documents, tokenizer_file, end_id).write.options(
        **{
            "parquet.block.size": str(row_group_bytes),
            "parquet.page.size": str(page_bytes),
            "parquet.page.row.count.limit": str(page_rows),
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": str(encoding == "dictionary").lower(),
            "compression": "snappy",
        }
    ).parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Token rows, of the documents from ``first`` to ``last`` only where given: files, row groups and pages beyond are skipped."""
    rows = spark.read.schema(TOKENS).parquet(path)
    if first is not None:
        rows = rows.filter(F.col("doc_id") >= first)
    return rows if last is None else rows.filter(F.col("doc_id") <= last)


def _with_start(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Add ``start``, the ids before a row, to token rows: those of earlier parts and of earlier rows of the own part."""
    parts = metadata.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row per part: the only list that is ordered in one task
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("earlier"))
    return rows.join(parts, "part").withColumn("start", F.col("earlier") + F.col("before")).drop("part", "earlier", "before")


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text_hash, n_tokens, start) from the metadata columns alone."""
    rows = read_tokens(spark, path).drop("ids")
    return _with_start(rows, rows.select("part", "n_tokens"))


def _with_crc32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ids by their unsigned crc32 as little-endian unsigned 32-bit integers."""
    for batch in batches:
        lists = batch.column("ids")
        raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).cast("B")
        bounds = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
        sums = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
        kept = [batch.column(name) for name in _CHECKED.names[:-1]]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64())], names=_CHECKED.names)


_CHECKED = T.StructType([*(f for f in TOKENS.fields if f.name not in ("ids", "text_hash")), T.StructField("ids_crc32", T.LongType())])


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens, ids_crc32, all read back from the files.

    Repeated rows follow each other, each with its own start; an empty table
    gives no rows.
    """
    rows = read_tokens(spark, path)
    checked = rows.drop("text_hash").mapInArrow(_with_crc32, _CHECKED)
    return _with_start(checked, rows.select("part", "n_tokens")).select("doc_id", "start", "n_tokens", "ids_crc32")
