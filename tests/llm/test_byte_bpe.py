import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plenum.llm import byte_bpe

from .conftest import ODD

CODER = byte_bpe.encoding(public_tokenizers.path(byte_bpe.RANKS))


def test_round_trip_of_odd_rows(odd, none):
    def sha(b):
        return hashlib.sha256(b).hexdigest()

    wanted = []
    for i, text in ODD:
        ids = np.array(CODER.encode_ordinary(text or ""), "<u4")
        wanted.append((i, len(ids), sha(ids.tobytes()), sha((text or "").encode())))
    got = [tuple(r) for r in byte_bpe.round_trip(odd).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert byte_bpe.round_trip(none).collect() == []
    ids = {r["n_tokens"]: len(r["ids"]) for r in byte_bpe.encoded(odd).collect()}
    assert all(a == b for a, b in ids.items())


def test_encode_and_decode_columns(odd):
    rows = odd.select("text", byte_bpe.decode(byte_bpe.encode(F.col("text"))).alias("back")).collect()
    assert all(bytes(r["back"]) == (r["text"] or "").encode() for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab1 \n\t.'sé日́\x1c\x85!", max_size=60), st.integers(1, 9))
def test_pieces_have_the_ids_of_the_text(text, size):
    parts = list(byte_bpe.pieces(text, size))
    assert "".join(parts) == text
    assert [i for p in parts for i in CODER.encode_ordinary(p)] == CODER.encode_ordinary(text)


def test_texts_without_boundaries():
    for text in ("a" * 400_000, " " * 300_000, "\n \n" * 100_000, "日本" * 150_000):
        ids = byte_bpe.encode_text(text, CODER)
        assert byte_bpe.decode_ids(ids, CODER) == text.encode()
        assert ids.tolist() == CODER.encode_ordinary(text)


def by_matches(text):
    """Ids of the matches of the pattern, one by one."""
    return [i for m in byte_bpe._pattern().finditer(text) for i in CODER._core_bpe.encode_single_piece(m.group().encode())]


@pytest.mark.parametrize("count", [10**5, 10**6, 10**7])
def test_long_runs_of_white_space(count):
    for run in (" ", "\n", "\t", " \n"):
        run = run * (count // len(run))
        places = (run, run + "end", "start" + run, "start of it" + run + " the end, 12") if count < 10**7 else ("start" + run + " end",)
        for text in places:
            ids = byte_bpe.encode_text(text, CODER)
            assert byte_bpe.decode_ids(ids, CODER) == text.encode()
            if count <= 10**6:
                assert ids.tolist() == by_matches(text)
            if count <= 10**5:
                assert ids.tolist() == CODER.encode_ordinary(text)


def test_long_runs_on_spark(make):
    texts = [(i, "a" * k + c * 10**6 + " b") for i, (k, c) in enumerate([(0, " "), (1, "\n"), (2, "\t"), (3, "x"), (4, "日")])]
    got = {r["doc_id"]: r for r in byte_bpe.round_trip(make(texts)).collect()}
    for i, text in texts:
        assert got[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[i]["n_tokens"] == len(byte_bpe.encode_text(text, CODER))
