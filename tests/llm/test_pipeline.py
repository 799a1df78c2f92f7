import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from plenum.llm import byte_bpe, pu_quality

from . import test_decontaminate, test_line_dedup, test_simhash


def corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(500)]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, say(20)) for i in range(6)]
    header = "a heading that a third of all documents has in common"
    rows = []
    for i in range(120):
        lines = [say(rng.randint(5, 30)) + "." for _ in range(rng.randint(1, 6))]
        if i % 3 == 0:
            lines.insert(0, header if i % 2 else header.replace("third", "thirt"))
        if i % 11 == 0:
            lines.append(items[i % 6][1])
        if i % 7 == 0 and rows:
            lines = rows[rng.randrange(len(rows))][1].split("\n")
        text = "\n".join(lines)
        rows.append((i, text.replace(" ", "%%% ") if i % 10 == 9 else text))
    labels = [(i, int(i % 10 != 9)) for i in range(0, 120, 2)] + [(9, 0), (19, 0)]
    return rows, items, labels


@pytest.fixture(scope="module")
def folder(llm, make, tmp_path_factory):
    rows, items, labels = corpus()
    path = str(tmp_path_factory.mktemp("tables"))
    make(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    llm.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    llm.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    return path


def without_repeats(rows):
    """Brute force of the line stage: later lines of a class go."""
    degree_and_root = test_line_dedup.brute(rows)
    seen, out = set(), []
    for doc, text in sorted(rows):
        lines = []
        for at, line in enumerate(text.split("\n")):
            root = degree_and_root.get((doc, text, at), (0, None))[1]
            if root is None or root not in seen:
                lines.append(line)
            if root is not None:
                seen.add(root)
        out.append((doc, "\n".join(lines)))
    return out


def test_stages_against_brute_force(llm, folder):
    rows, items, _ = corpus()
    docs, texts = llm.read.parquet(f"{folder}/documents.parquet"), sorted(rows)
    columns = docs.columns
    model = pu_quality.train(docs, llm.read.parquet(f"{folder}/labels.parquet"))
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(llm, docs, folder)
        if at == 0:
            texts = [(i, t) for i, t in texts if model.score(np.array([pu_quality.features(t.encode())]))[0] >= 0.3]
            assert len(texts) >= 100 and all("%%%" not in t for _, t in texts)
        elif at == 1:
            texts = without_repeats(texts)
        elif at == 2:
            texts = [(i, t) for i, t in texts if (i, i) in {(d, c) for d, _, c in test_simhash.brute(texts)}]
        elif at == 3:
            texts = [(i, t) for i, t in texts if not {r[0]: r[5] for r in test_decontaminate.brute(texts, items)}[i]]
        if at < 4:
            assert out.columns == columns
            got = sorted((r["doc_id"], r["text"]) for r in out.collect())
            assert got == texts, name
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
            docs = llm.createDataFrame(out.collect(), docs.schema)
    coder = byte_bpe.encoding(public_tokenizers.path(byte_bpe.RANKS))
    last = sorted((r["doc_id"], list(r["ids"]), r["decoded_sha256"]) for r in out.collect())
    assert last == [(i, coder.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts]
    whole = sorted((r["doc_id"], list(r["ids"]), r["decoded_sha256"]) for r in entry.queries()["pipeline"](llm, folder).collect())
    assert whole == last


def test_eleven_queries_are_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1


def test_empty_documents(llm, make, tmp_path):
    make([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    llm.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    llm.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(llm, str(tmp_path)).collect() == []
