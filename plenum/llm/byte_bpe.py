"""Byte-level BPE with the tiktoken library: encode whole texts, decode raw bytes.

A long text is cut before it is encoded, at places where the split pattern
always starts a new match: before a single blank that stands between the text
so far and a character that is no white space.  Matches never cross such a
place, so the ids of the pieces are the ids of the text.  Where a text has no such
place for long, its matches are found here and merged one by one: the library's
own pattern overflows its stack on some hundred thousand blanks in a row.
"""

from __future__ import annotations

import re
from base64 import b64decode
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKS = "byte_bpe_50k.tiktoken"
PIECE_CHARS = 1 << 16

_SAFE = re.compile(r" (?=[^\s])")


@lru_cache(maxsize=4)
def encoding(rank_file: str) -> tiktoken.Encoding:
    """The encoding of a rank file (lines of base64 token and rank); no special tokens."""
    with open(rank_file, "rb") as lines:
        ranks = {b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cut a text at safe boundaries into pieces of about ``size`` characters.

    A text without such boundaries comes as one piece, or, where that is far
    longer than ``size``, match by match of the pattern.
    """
    start = 0
    while start < len(text):
        found = _SAFE.search(text, start + size)
        stop = found.start() if found else len(text)
        if stop - start <= 2 * size:
            yield text[start:stop]
        else:
            yield from (m.group() for m in _pattern().finditer(text[start:stop]))
        start = stop


def text_of(raw: bytes | None) -> str:
    return (raw or b"").decode("utf-8", "replace")


def encode_text(text: str, coder: tiktoken.Encoding) -> np.ndarray:
    """Ids of one whole text as unsigned 32-bit integers."""
    if len(text) <= PIECE_CHARS:
        return np.array(coder.encode_ordinary(text), dtype="<u4")
    return np.concatenate([_piece_ids(p, coder) for p in pieces(text)])


def _piece_ids(piece: str, coder: tiktoken.Encoding) -> np.ndarray:
    if len(piece) <= 2 * PIECE_CHARS:
        return np.array(coder.encode_ordinary(piece), dtype="<u4")
    # longer ones are single matches: only the merges are left to do, without the library's pattern
    return np.array(coder._core_bpe.encode_single_piece(piece.encode()), dtype="<u4")


def decode_ids(ids: np.ndarray, coder: tiktoken.Encoding) -> bytes:
    """The bytes of a sequence of ids; they need not be valid UTF-8 by themselves."""
    return coder.decode_bytes(ids.tolist())


def _rank_file(rank_file: str | None) -> str:
    return rank_file or public_tokenizers.path(RANKS)


def encode(text: Column, rank_file: str | None = None) -> Column:
    """Ids of every whole text as array<int>; null and empty texts give an empty array.

    Bytes that are no UTF-8 are read as U+FFFD.
    """
    path = _rank_file(rank_file)

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def ids_of(texts: pd.Series) -> pd.Series:
        coder = encoding(path)
        return pd.Series([encode_text(text_of(t), coder).astype("<i4") for t in texts], dtype=object)

    return ids_of(text.cast("binary"))


def decode(ids: Column, rank_file: str | None = None) -> Column:
    """Raw bytes of every sequence of ids; null gives null."""
    path = _rank_file(rank_file)

    @F.pandas_udf(T.BinaryType())
    def bytes_of(rows: pd.Series) -> pd.Series:
        coder = encoding(path)
        return pd.Series([None if r is None else decode_ids(np.asarray(r), coder) for r in rows], dtype=object)

    return bytes_of(ids)


_DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def _digests(ids: np.ndarray, coder: tiktoken.Encoding) -> tuple[int, str, str]:
    return len(ids), sha256(ids.tobytes()).hexdigest(), sha256(decode_ids(ids, coder)).hexdigest()


def encoded(documents: DataFrame, rank_file: str | None = None) -> DataFrame:
    """Per row doc_id, ids, n_tokens, ids_sha256 and decoded_sha256 of every whole text; see ``round_trip``."""
    path = _rank_file(rank_file)
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *_DIGESTS.fields])

    @F.pandas_udf(kind)
    def rows_of(texts: pd.Series) -> pd.DataFrame:
        coder, rows = encoding(path), []
        for raw in texts:
            ids = encode_text(text_of(raw), coder)
            rows.append((ids.astype("<i4"), *_digests(ids, coder)))
        return pd.DataFrame(rows, columns=kind.names)

    return documents.select("doc_id", rows_of(F.col("text").cast("binary")).alias("d")).select("doc_id", "d.*")


def round_trip(documents: DataFrame, rank_file: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every whole text; per row doc_id, n_tokens and digests of ids and bytes.

    One row per input row, repeated rows and null ids included; a null text
    counts as empty; other columns are not touched.  Ids stay in the worker, so
    only digests travel.
    """
    path = _rank_file(rank_file)

    @F.pandas_udf(_DIGESTS)
    def digests(texts: pd.Series) -> pd.DataFrame:
        coder, rows = encoding(path), []
        for raw in texts:
            ids = encode_text(text_of(raw), coder)
            rows.append(_digests(ids, coder))
        return pd.DataFrame(rows, columns=_DIGESTS.names)

    return documents.select(
        F.col(doc_id).alias("doc_id"), digests(F.col(text).cast("binary")).alias("d")
    ).select("doc_id", "d.*")
