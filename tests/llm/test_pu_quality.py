import random
import zlib

import numpy as np

from plenum.llm import pu_quality


def corpus(n=900):
    random.seed(4)
    words = ["".join(random.choices("etaoinshrdlu", k=random.randint(2, 9))) for _ in range(400)]
    rows, truth = [], {}
    for i in range(n):
        text = ". ".join(" ".join(random.choices(words, k=12)).capitalize() for _ in range(random.randint(2, 20)))
        good = random.random() < 0.75
        if not good:
            text = random.choice([text.upper().replace(" ", "!! "), text.replace(" ", "%%% "), " ".join(w for w in text.split() for _ in range(8))])
        rows.append((i, text))
        truth[i] = int(good)
    return rows, truth


def labels(llm, pairs):
    return llm.createDataFrame(pairs, "doc_id long, quality int").selectExpr("*", "1 AS score", "2 AS text")


def test_held_out_ranking_and_prior(llm, make):
    rows, truth = corpus()
    known = [(i, truth[i]) for i in truth if i % 2]
    model = pu_quality.train(make(rows), labels(llm, known))
    assert 0.4 < model.prior < 0.9
    got = {r["doc_id"]: r for r in pu_quality.classify(make(rows), labels(llm, known)).collect()}
    assert len(got) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for i, r in got.items())
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    held = [i for i in got if got[i]["held_out"]]
    good = np.array([got[i]["score"] for i in held if truth[i]])
    bad = np.array([got[i]["score"] for i in held if not truth[i]])
    assert (good[:, None] > bad[None]).mean() > 0.97 and (good >= 0.3).mean() > 0.97


def test_held_out_and_negative_labels_are_never_used(llm, make):
    rows, truth = corpus(300)
    some = [(i, truth[i]) for i in truth]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in some]
    positive = [(i, q) for i, q in some if q == 1]
    weights = [pu_quality.train(make(rows), labels(llm, x)).weights for x in (some, flipped, positive)]
    assert np.allclose(weights[0], weights[1]) and np.allclose(weights[0], weights[2])


def test_odd_rows(llm, odd, none):
    # neither positives nor documents
    assert {r["score"] for r in pu_quality.classify(odd, labels(llm, [])).collect()} == {0.5}
    assert pu_quality.classify(none, labels(llm, [(1, 1)])).collect() == []
    mixed = labels(llm, [(4, 1), (4, 1), (4, 0), (None, 1), (99, 1), (3, None)])
    got = pu_quality.classify(odd, mixed).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    kept = pu_quality.keep_good(odd, mixed)
    assert kept.columns == odd.columns
    assert kept.count() == sum(r["predicted"] for r in got)


def test_sample_is_bounded(llm, make):
    rows, truth = corpus(400)
    features = pu_quality.featured(make(rows + [(7, rows[7][1])] * 300 + [(7, f"text {i} of one id") for i in range(200)]))
    got = pu_quality._first_by_hash(features, 50).collect()
    assert len(got) == 50 and len({(r["k_id"], r["k_text"]) for r in got}) == 50
    every = {(r["k_id"], r["k_text"]): r["n"] for r in pu_quality._first_by_hash(features, 10_000).collect()}
    assert len(every) == 600 and sorted(every.values())[-2:] == [1, 301]


def plain_risk(w, p, u, prior):
    positive, negative = np.logaddexp(0, -(p @ w)).mean(), np.logaddexp(0, u @ w).mean() - prior * np.logaddexp(0, p @ w).mean()
    return prior * positive + max(0.0, negative) + pu_quality.L2 / 2 * (w @ w)


def test_weights_minimise_the_risk():
    rng = np.random.default_rng(3)
    p = np.column_stack([rng.normal(1, 1, (300, 3)), np.ones(300)])
    u = np.column_stack([np.concatenate([rng.normal(1, 1, (200, 3)), rng.normal(-1, 1, (200, 3))]), np.ones(400)])
    w = pu_quality.nn_risk_weights(p, u, 0.5, steps=3000)
    least = plain_risk(w, p, u, 0.5)
    for _ in range(300):
        assert plain_risk(w + rng.normal(0, 0.05, 4), p, u, 0.5) > least - 1e-4
    # a row's weight is the number of its copies
    copies = pu_quality.nn_risk_weights(np.concatenate([p, p[:40], p[:40]]), u, 0.5)
    weight = np.ones(300)
    weight[:40] = 3
    assert np.allclose(copies, pu_quality.nn_risk_weights(p, u, 0.5, weight, np.ones(400)))


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(5)
    positive, unlabelled = rng.normal(2, 1, 4000), np.concatenate([rng.normal(2, 1, 3000), rng.normal(-2, 1, 7000)])
    cuts = np.unique(positive)
    above = [pu_quality.share_above(cuts, v) for v in (positive, unlabelled)]
    assert np.allclose(above[1], [(unlabelled >= c).mean() for c in cuts])
    assert abs(pu_quality.class_prior(*above, 4000, 10_000) - 0.3) < 0.03


def test_statistics_cover_all_texts(llm, make):
    rows, truth = corpus(400)
    known = [(i, truth[i]) for i in truth if i % 2]
    model = pu_quality.train(make(rows), labels(llm, known), sample=40)
    x = np.array([pu_quality.features(t.encode()) for i, t in rows if zlib.crc32(str(i).encode()) % 5])
    assert np.allclose(model.centre, x.mean(0)) and np.allclose(model.spread, np.maximum(x.std(0), 1e-3))
