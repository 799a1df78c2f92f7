import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import AddedToken, Tokenizer

from plenum.llm import token_files

from .conftest import ODD

FILE = public_tokenizers.path(token_files.TOKENIZER)
PLAIN = Tokenizer.from_file(FILE)
CODER = token_files.ChunkEncoder(FILE)


def ids_of(text):
    return np.array(PLAIN.encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="abZ1² \n\t\r.,'!_sé日́\x1c\x85\x00|<>endoftext", max_size=50), max_size=4))
def test_chunks_have_the_ids_of_the_text(texts):
    assert [np.frombuffer(r, '<u4').tolist() for r in CODER.encode(texts)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]


def test_letters_with_marks_are_learned_without_the_split_pattern(monkeypatch):
    """Marks after letters are a match of their own; apostrophes and digits are left to the pattern."""
    marked = [" word$$$", "word!!", " w_", "a\\^`~{|}", " Ab<br/", "x[-]", " we'll", "don't!", " w1$", " $$$", " é!!", "-", "a$b", "$a$ ,.", "end.,", "x ,y", "é.", "é,", "_.", "_,", "a\n, b", ", c"]
    coder = token_files.ChunkEncoder(public_tokenizers.path(token_files.TOKENIZER))
    whole = []
    monkeypatch.setattr(coder, "_plain", lambda text, plain=coder._plain: whole.append(text) or plain(text))

    def same(texts):
        return [np.frombuffer(r, "<u4").tolist() for r in coder.encode(texts)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]

    assert same(marked)
    by_pattern = {line for text in whole for line in text.split("\n")}
    assert not by_pattern & {" word$$$", "word!!", " w_"} and {" we'll", " w1$"} <= by_pattern
    assert same(["".join(marked), "\n".join(marked)])


def test_store_falls_back_to_its_first_entries(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_CHUNKS", 50)
    coder, rng = token_files.ChunkEncoder(FILE), random.Random(1)
    for _ in range(40):
        texts = [" ".join("".join(rng.choices("abcdef", k=5)) for _ in range(20)) for _ in range(3)]
        assert [np.frombuffer(r, '<u4').tolist() for r in coder.encode(texts)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(coder.known) < 50 + 25 + 200


def test_a_chunk_is_looked_up_once_however_often_it_comes():
    class Counted(dict):
        asked = 0

        def get(self, *args):
            self.asked += 1
            return super().get(*args)

    coder = token_files.ChunkEncoder(FILE)
    coder.known = known = Counted(coder.known)
    texts = ["many words, many words.\n" * 500, "words " * 1000, "", "été. " * 500]
    for _ in range(2):
        assert [np.frombuffer(r, "<u4").tolist() for r in coder.encode(texts)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert known.asked < 100


def test_texts_side_by_side_do_not_meet(monkeypatch):
    """Cuts look at the bytes before and after; those of the next text do not count."""
    ends = ["", " ", "a", ".", ",", "\n", "é", "×", "\u3000", "\u2009", "\u00a0", "a ", "a\n", " \u2028", " —", "\u1680.", "Ж,", "҂,", "日.", "<|endoftext|>"]
    pairs = [text for one in ends for other in ends for text in (one, other, one + other)]
    for size in (8 << 20, 1, 40):
        monkeypatch.setattr(token_files, "PIECE_BYTES", size)
        monkeypatch.setattr(token_files, "LEARNED_CHUNKS", 3)
        coder = token_files.ChunkEncoder(FILE)
        texts, got = pa.array(["of another slice", *pairs])[1:], []
        for at, n in token_files._pieces(texts):
            sizes, ids = coder.encode_column(texts.slice(at, n))
            got += [part.tolist() for part in np.split(ids, np.cumsum(sizes))[:n]]
        assert got == [PLAIN.encode(t, add_special_tokens=False).ids for t in pairs]


def test_bytes_that_are_not_utf8_are_replaced():
    column = pa.array([b"a\xc3", b"\xa9b", None, b"\xc3\xa9"], pa.binary())
    assert token_files._decoded(column).to_pylist() == ["a\ufffd", "\ufffdb", "", "é"]
    assert token_files._decoded(column[2:]).to_pylist() == ["", "é"]
    assert list(token_files._pieces(token_files._decoded(column[:0]))) == []


def test_added_tokens_are_found_as_the_library_does(make, tmp_path):
    texts = ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n", "<|endoftext", "x<|endoftext|>y. <|endoftext|>", " <|endoftext|> \n"]
    assert [np.frombuffer(r, "<u4").tolist() for r in CODER.encode(texts)] == [PLAIN.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in np.frombuffer(CODER.encode(texts[:1])[0], "<u4")
    path = str(tmp_path / "added")
    token_files.write_tokens(make(list(enumerate(texts))), path)
    at = 0
    for r in sorted(token_files.stored_documents(make([]).sparkSession, path).collect(), key=lambda r: r["doc_id"]):
        assert (r["start"], r["ids_crc32"]) == (at, zlib.crc32(ids_of(texts[r["doc_id"]]).tobytes()))
        at += r["n_tokens"]


@pytest.mark.parametrize("flag", ["lstrip", "rstrip", "single_word"])
def test_added_tokens_with_flags(tmp_path, flag):
    other = Tokenizer.from_file(FILE)
    other.add_special_tokens([AddedToken("<odd>", **{flag: True}), AddedToken("<plain>"), AddedToken("<plain>er")])
    other.save(str(tmp_path / "t.json"))
    coder, texts = token_files.ChunkEncoder(str(tmp_path / "t.json")), ["a <odd> b", "<odd>", "x<odd>y <plain> <plain>er z", "<plain>"]
    assert [np.frombuffer(r, "<u4").tolist() for r in coder.encode(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_hot_id_is_dealt_to_several_parts(llm, make, tmp_path):
    hot = [(7, "one text of an id with most of the rows")] * 600 + [(7, f"text {i}") for i in range(300)]
    rows = hot + [(i, f"other {i}") for i in range(100) if i != 7]
    path = str(tmp_path / "hot")
    llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else this little makes one part
    try:
        token_files.write_tokens(make(rows).repartition(4), path)
    finally:
        llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    stored = token_files.read_tokens(llm, path)
    sizes = [r["count"] for r in stored.groupBy("part").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < len(rows) / 2
    at, last = 0, -1
    for r in sorted(token_files.read_offsets(llm, path).collect(), key=lambda r: r["start"]):
        assert r["start"] == at and r["doc_id"] >= last
        at, last = at + r["n_tokens"], r["doc_id"]
    assert at == sum(len(ids_of(t)) for _, t in rows)


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files_hold_the_rows_in_order(llm, odd, tmp_path, encoding):
    path = str(tmp_path / encoding)
    token_files.write_tokens(odd, path, encoding=encoding)
    got = [tuple(r) for r in token_files.stored_documents(llm, path).collect()]
    assert len(got) == len(ODD)
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    at, sizes = 0, {}
    for doc, start, n, crc in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
        sizes.setdefault(doc, []).append((n, crc))
    for doc in {i for i, _ in ordered}:
        wanted = [(len(ids_of(t)), zlib.crc32(ids_of(t).tobytes())) for i, t in ODD if i == doc]
        assert sorted(sizes[doc]) == sorted(wanted)
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == [i for i, _ in ordered]
    one = token_files.read_tokens(llm, path, 3, 3).collect()
    assert [r["ids"] for r in one] == [ids_of(ODD[3][1]).astype(int).tolist()]
    plan = token_files.read_tokens(llm, path, 3, 3).select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,3)" in plan and "ids:" not in plan.split("ReadSchema")[1]
    encodings = set()
    for file in glob.glob(path + "/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            column = meta.row_group(g).column(3)
            assert column.has_offset_index
            encodings |= set(column.encodings)
    assert ("RLE_DICTIONARY" if encoding == "dictionary" else "DELTA_BINARY_PACKED") in encodings


def test_empty_table(llm, none, tmp_path):
    token_files.write_tokens(none, str(tmp_path / "none"))
    assert token_files.stored_documents(llm, str(tmp_path / "none")).collect() == []
    assert token_files.read_offsets(llm, str(tmp_path / "none")).collect() == []
