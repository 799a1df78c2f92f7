import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from plenum.llm import whitening

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.DoubleType())),
        # names that the operator uses inside
        *[T.StructField(name, T.StringType()) for name in ("x", "v", "component", "n", "white", "at", "deviation")],
    ]
)


@pytest.fixture
def vectors(llm):
    return lambda rows: llm.createDataFrame([(*r, *["c"] * 7) for r in rows], SCHEMA)


def integers(vector):
    return [math.floor(64 * c) + 1_000_000 for c in vector]


def brute(rows, most=16):
    """n, deviation by id, covariance, all from exact fractions over the distinct vectors."""
    kept = [(i, integers(v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, size = len(fit), len(fit[0])
    mean = [Fraction(sum(x[k] for x in fit), n) for k in range(size)]
    matrix = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(size)] for i in range(size)]
    deviation = {i: sum((n * x[k] - n * mean[k]) ** 2 for k in range(size)) for i, x in kept}
    values, basis = np.linalg.eigh(np.array(matrix, dtype=float))
    values, basis = values[::-1][:most], basis[:, ::-1][:, :most]
    white = {i: np.array([float(x[k] - mean[k]) for k in range(size)]) @ basis / np.sqrt(values) for i, x in kept}
    return n, deviation, values / float(sum(matrix[k][k] for k in range(size))), white


def compare(df, rows):
    n, deviation, explained, white = brute(rows)
    got = whitening.whiten(df).collect()
    per = {}
    for r in got:
        assert r["n"] == n and int(r["deviation"]) == deviation[r["vec_id"]]
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
        assert r["identity_error"] < 1e-9
        per.setdefault(r["component"], []).append((r["whitened"], white[r["vec_id"]][r["component"] - 1]))
    assert sorted(per) == list(range(1, len(explained) + 1))
    for pairs in per.values():  # one sign for all rows
        mine, theirs = np.array(pairs).T
        assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-6
    return got


def test_against_exact_fractions(vectors):
    draw = np.random.default_rng(1)
    basis = draw.standard_normal((20, 20))
    rows = [(i, (draw.standard_normal(20) @ basis * 3).tolist()) for i in range(150)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # copies weigh nothing in the fit
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 18), (2002, [float("nan")] * 20), (2003, [math.inf] + [0.0] * 19), (2004, [])]
    rows += [(None, (draw.standard_normal(20)).tolist())]
    got = compare(vectors(rows), rows)
    assert len(got) == 16 * 211 and len({r["vec_id"] for r in got}) == 211


def test_small_and_flat_tables(vectors):
    assert whitening.whiten(vectors([])).collect() == []
    assert whitening.whiten(vectors([(1, None), (2, [])])).collect() == []
    flat = whitening.whiten(vectors([(1, [0.5, 2.0]), (2, [0.5, 2.0])])).collect()
    assert sorted((r["vec_id"], r["component"]) for r in flat) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert {(r["n"], int(r["deviation"]), r["whitened"], r["explained"], r["identity_error"]) for r in flat} == {(1, 0, None, None, None)}
    # one dimension without variance, one with
    rows = whitening.whiten(vectors([(1, [0.0, 1.0]), (2, [4.0, 1.0])])).collect()
    assert {(r["component"], None if r["whitened"] is None else round(abs(r["whitened"]), 9)) for r in rows} == {(1, 1.0), (2, None)}
    # of two lengths the one with more distinct vectors counts, of equal ones the longer
    mixed = whitening.whiten(vectors([(1, [1.0]), (2, [1.0]), (3, [2.0, 3.0]), (4, [5.0, 1.0])])).collect()
    assert {r["vec_id"] for r in mixed} == {3, 4}
    tied = whitening.whiten(vectors([(1, [1.0]), (2, [2.0, 3.0])])).collect()
    assert {r["vec_id"] for r in tied} == {2}


def test_values_beyond_long_sums_stay_exact(vectors):
    big = [(i, [1e13 * (i % 5), -7e12 * (i % 3), 3.0 * i]) for i in range(40)]
    n, deviation, *_ = brute(big)
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(vectors(big)).select("vec_id", "deviation").distinct().collect()}
    assert got == deviation
    assert len(whitening.whiten(vectors([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])).select("vec_id", "whitened").collect()) == 6


def test_polarisation_gives_all_covariances():
    draw = np.random.default_rng(3)
    x = draw.integers(-50, 50, (200, 7)) + 10**6
    middle = [int(v) for v in np.round(x.mean(0))]
    moved = x - middle
    squares = {(i, j): int(((moved[:, i] + (moved[:, j] if i < j else 0)) ** 2).sum()) for i in range(7) for j in range(i, 7)}
    found = whitening.covariance(200, moved.sum(0).tolist(), squares)
    assert np.allclose(found, np.cov(x.T, bias=True), rtol=1e-12, atol=1e-9)
