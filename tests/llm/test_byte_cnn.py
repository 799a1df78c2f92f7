import random
import zlib

import numpy as np
import pytest

from plenum.llm import byte_cnn

from .conftest import LONG, ODD

SYLLABLES = {"aa": "ka to mi re su no".split(), "bb": "schn ung ätz keit pf ßer".split(), "cc": "ção lh inho õe nh eu".split()}


def text(rng, lang, words=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(i, text(rng, lang, rng.randint(4, 80)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=500))]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    net = byte_cnn.untrained(["a", "b", "c"])
    for name in ("table", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    ids = rng.integers(97, 110, (6, byte_cnn.WINDOW + byte_cnn.REACH)).astype(np.uint8)
    labels = rng.integers(0, 3, 6)
    _, slopes = byte_cnn.gradients(net, ids, labels)
    for p, g in zip(net.parameters(), slopes):
        for at in list(np.ndindex(p.shape))[:: max(1, p.size // 7)] + [np.unravel_index(np.abs(g).argmax(), g.shape)]:
            if p is net.filters and not byte_cnn.reach_mask()[at]:
                assert g[at] == 0
                continue
            kept, losses = p[at], []
            for shift in (1e-6, -1e-6):
                p[at] = kept + shift
                losses.append(byte_cnn.gradients(net, ids, labels)[0])
            p[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-6 - g[at]) < 1e-5


def test_scores_are_those_of_the_plain_network():
    """Pair tables, blocks and pooling by halves against filters applied place by place."""
    net, rng = byte_cnn.untrained(["a", "b"]), random.Random(3)
    for words in (1, 30, 4000):
        raw = text(rng, "bb", words).encode()
        shares, weights = [], []
        padded = raw + bytes(byte_cnn.WINDOW + byte_cnn.REACH)
        for start in range(0, max(1, len(raw)), byte_cnn.WINDOW):
            best = None
            for at in range(start, start + byte_cnn.WINDOW):
                end = min(len(padded), start + byte_cnn.WINDOW + byte_cnn.REACH)
                seen = [padded[k] if k < end and k < len(raw) else 0 for k in range(at, at + byte_cnn.REACH + 1)]
                answer = net.table[seen].ravel() @ net.filters
                best = answer if best is None else np.maximum(best, answer)
            z = np.maximum(best + net.bias, 0) @ net.out + net.out_bias
            shares.append(np.exp(z) / np.exp(z).sum())
            weights.append(min(byte_cnn.WINDOW, len(raw) - start))
        wanted = np.average(shares, axis=0, weights=weights)
        (best, share), = byte_cnn.predict(net, [raw])
        assert best == wanted.argmax() and abs(share - wanted.max()) < 1e-5


def test_long_texts_in_blocks_equal_one_pass(monkeypatch):
    net, raw = byte_cnn.untrained(["a", "b"]), LONG.encode()
    whole = byte_cnn.predict(net, [raw])
    monkeypatch.setattr(byte_cnn, "BLOCK", 1)
    cut = byte_cnn.predict(net, [raw])
    assert whole[0][0] == cut[0][0] and abs(whole[0][1] - cut[0][1]) < 1e-6


def test_held_out_accuracy(make, corpus):
    odd = [(100_000 + (i or 0), t, None) for i, t in ODD] + [(None, "ka to mi re", "aa"), (1, "1234 -- !!", "aa"), (2, "日本語", None)]
    got = byte_cnn.identify(make(corpus + odd), steps=250).collect()
    assert len(got) == len(corpus) + len(odd)
    truth = {i: lang for i, _, lang in corpus}
    tested = [r for r in got if r["held_out"] and r["doc_id"] in truth and r["lang_pred"] != "und"]
    assert len(tested) > 80 and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in tested]) > 0.97
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    blank = [r for r in got if r["lang_pred"] == "und"]
    assert sorted(r["doc_id"] for r in blank) == [1, 100_001, 100_002, 100_006] and all(r["score"] == 0 for r in blank)
    assert {r["lang_pred"] for r in got} == {"aa", "bb", "cc", "und"}


def test_labels_of_held_out_documents_and_other_columns_are_not_read(make, corpus):
    other = [(i, t, "zz" if held(i) else lang) for i, t, lang in corpus]
    key = lambda rows: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in rows)
    one = byte_cnn.identify(make(corpus), steps=20).collect()
    assert key(one) == key(byte_cnn.identify(make(other), steps=20).withColumn("source", byte_cnn.F.lit("x")).collect())


def test_sample_is_bounded_and_shared_out(make, corpus):
    copies = [(10_000 + i, corpus[0][1], corpus[0][2]) for i in range(400)]
    picked = byte_cnn.sample(make(corpus + copies), most=60).groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in picked} == {"aa": 20, "bb": 20, "cc": 20}


def test_tables_without_lessons(make, none):
    assert byte_cnn.identify(none).collect() == []
    rows = byte_cnn.identify(make([(1, "words", None), (2, None, "aa"), (2, "...", "aa")])).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)] * 3
    one = byte_cnn.identify(make([(1, "ka to", "aa"), (3, "mi re", "aa"), (4, "ka to", "aa"), (6, "ka", "aa")])).collect()
    assert {(r["lang_pred"], r["score"]) for r in one} == {("aa", 1.0)}
