"""Whitening of embeddings from a covariance found by polarisation.

Only variances are ever aggregated: the exact squares of the centred values of
every dimension, and of the sum of every pair of dimensions.  The polarisation
identity cov(a, b) = (var(a + b) - var(a) - var(b)) / 2 then gives all
cross-covariances, which are assembled for a symmetric eigensolver.

Entries become integers first, so all sums are exact.  Values are centred at the
rounded mean before they are squared, which keeps them small; the fraction that
rounding leaves is taken out of the sums in whole numbers, so nothing cancels.
One row a dimension pair and partition reaches the shuffle, and the driver sees
one number a pair: both are bounded by the dimension, not by the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.common import saved

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
LONG_MAX = (1 << 63) - 1


def whole(vector: Column) -> Column:
    """The vector is there and all its entries are finite numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))  # NaN is above all numbers
    return F.coalesce(finite & (F.size(vector) > 0), F.lit(False))


def as_integers(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of every entry; entries beyond a long stop at its ends."""
    return F.transform(
        vector, lambda c: F.least(F.floor(c.cast("double") * SCALE), F.lit(LONG_MAX - OFFSET)) + F.lit(OFFSET).cast("long")
    )


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _shifted(x: np.ndarray, middle: list[int], room: int) -> np.ndarray:
    """x - middle, as longs where values up to ``room`` times the squares fit, else as Python integers."""
    near = np.array(middle, dtype=object)
    if np.abs(x.astype(np.float64) - near.astype(np.float64)).max(initial=0) < 2.0**60:
        moved = x - near.astype(np.int64)
        largest = int(np.abs(moved).max(initial=0))
        if largest * largest * room < 1 << 62:
            return moved
        return moved.astype(object)
    return x.astype(object) - near


def _totals(found: Iterator[tuple[int, int, int]]) -> pa.RecordBatch:
    """(i, j, high, low) of exact totals: high * 2^60 + low, so that sums of them cannot outgrow a decimal."""
    i, j, value = zip(*((i, j, int(v)) for i, j, v in found), strict=True)
    parts = [[Decimal(v >> 60) for v in value], [Decimal(v & ((1 << 60) - 1)) for v in value]]
    kind = pa.decimal128(38, 0)
    return pa.RecordBatch.from_arrays(
        [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(pa.array(p, kind) for p in parts)], ["i", "j", "high", "low"]
    )


def _summed(points: DataFrame, partial) -> dict[tuple[int, int], int]:
    """Exact totals over all partitions; as many as ``partial`` gives for one of them."""
    parts = points.mapInArrow(partial, "i int, j int, high decimal(38,0), low decimal(38,0)")
    rows = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    return {(r["i"], r["j"]): (int(r["high"]) << 60) + int(r["low"]) for r in rows}


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of every dimension."""
    total: np.ndarray | None = None
    for batch in batches:
        if batch.num_rows:
            x = _shifted(_matrix(batch.column(0)), [0] * len(batch.column(0)[0]), 1)
            part = x.sum(0).astype(object)
            total = part if total is None else total + part
    if total is not None:
        yield _totals((i, i, v) for i, v in enumerate(total))


def _squares(middle: list[int]):
    """Exact squares of x_i and of x_i + x_j (i < j), centred at ``middle``, summed over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = len(middle)
        total = [np.zeros(size - lag, dtype=object) for lag in range(size)]
        some = False
        for batch in batches:
            if batch.num_rows:
                some = True
                x = np.ascontiguousarray(_shifted(_matrix(batch.column(0)), middle, 4 * batch.num_rows).T)
                total[0] += (x * x).sum(1).astype(object)
                for lag in range(1, size):
                    pair = x[:-lag] + x[lag:]
                    if pair.dtype == object:
                        total[lag] += (pair * pair).sum(1)
                    else:
                        total[lag] += np.einsum("ij,ij->i", pair, pair).astype(object)
        if some:
            yield _totals((i, i + lag, v) for lag in range(size) for i, v in enumerate(total[lag]))

    return run


@dataclass
class Whitener:
    """What maps a vector of integers to its whitened components."""

    n: int
    middle: list[int]
    rest: list[int]  # sum of x - middle over the fit list
    vectors: np.ndarray  # a column for each component
    values: np.ndarray
    trace: float

    def usable(self) -> np.ndarray:
        """Components whose eigenvalue stands above rounding."""
        floor = len(self.middle) * np.finfo(float).eps * float(self.values.max(initial=0.0))
        return self.values > floor

    def project(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, on every component, over the root of its eigenvalue; NaN without variance."""
        mean = np.array([r / self.n for r in self.rest])
        centred = _shifted(x, self.middle, 1).astype(np.float64) - mean
        scale = np.where(self.usable(), np.sqrt(np.where(self.usable(), self.values, 1.0)), np.nan)
        return centred @ self.vectors / scale

    def deviation(self, x: np.ndarray) -> list[int]:
        """Exact sum over the dimensions of (n * x - S)^2."""
        largest = max(map(abs, self.rest), default=0)
        moved = _shifted(x, self.middle, 1)
        bound = self.n * int(np.abs(moved).max(initial=0)) + largest
        if moved.dtype == object or bound * bound * max(1, len(self.middle)) >= 1 << 62:
            moved = moved.astype(object) * self.n - np.array(self.rest, dtype=object)
        else:
            moved = moved * self.n - np.array(self.rest, dtype=np.int64)
        return (moved * moved).sum(1).tolist()


def covariance(n: int, rest: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """All covariances from the squares of dimensions and of dimension pairs, by polarisation."""

    def spread(square: int, left: int) -> int:  # n^2 times the variance
        return n * square - left * left

    size = len(rest)
    own = [spread(squares[i, i], rest[i]) for i in range(size)]
    found = np.empty((size, size))
    for i in range(size):
        found[i, i] = own[i] / (n * n)
        for j in range(i + 1, size):
            both = spread(squares[i, j], rest[i] + rest[j])
            found[i, j] = found[j, i] = (both - own[i] - own[j]) / (2 * n * n)
    return found


def fit(points: DataFrame, components: int = COMPONENTS) -> Whitener:
    """A whitener of the distinct integer vectors ``points.x``, all of one length."""
    sums = _summed(points, _sums)
    n = points.count()
    middle = [(2 * sums[i, i] + n) // (2 * n) for i in range(len(sums))]
    rest = [sums[i, i] - n * middle[i] for i in range(len(sums))]
    matrix = covariance(n, rest, _summed(points, _squares(middle)))
    values, vectors = np.linalg.eigh(matrix)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    leading = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[leading, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Whitener(n, middle, rest, vectors, np.maximum(values, 0.0), float(np.trace(matrix)))


def identity_error(points: DataFrame, model: Whitener) -> float | None:
    """Largest absolute entry of the covariance of whitened ``points`` minus the identity; None without variance."""
    keep = np.flatnonzero(model.usable())
    if not len(keep):
        return None

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, some = np.zeros((len(keep), len(keep))), np.zeros(len(keep)), False
        for batch in batches:
            if batch.num_rows:
                w = model.project(_matrix(batch.column(0)))[:, keep]
                total, sums, some = total + w.T @ w, sums + w.sum(0), True
        if some:
            found = [(-1, j, v) for j, v in enumerate(sums)] + [(i, j, total[i, j]) for i in range(len(keep)) for j in range(len(keep))]
            i, j, value = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(value, pa.float64())], ["i", "j", "value"]
            )

    found = points.mapInArrow(products, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    entry = {(r["i"], r["j"]): r["value"] / model.n for r in found.collect()}
    return max(
        abs(entry[i, j] - entry[-1, i] * entry[-1, j] - (i == j)) for i in range(len(keep)) for j in range(len(keep))
    )


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per row and component: the id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds a null, NaN or infinite entry are
    dropped.  The fit list holds each distinct integer vector once; repeated rows
    all get their results.  Vectors of unequal length have no common covariance:
    the length with the most distinct vectors counts (of equal ones the longer),
    rows of another length are dropped.  ``deviation`` is decimal(38,0), since its
    exact value outgrows a long at some 10^9 distinct vectors; beyond 38 digits it is null.  A component without
    variance has a null ``whitened``; ``explained`` is null if there is no variance
    at all, and so is ``identity_error``.  An empty table gives an empty one.
    """
    spark = df.sparkSession
    source = df.select(df[vec_id].alias("vec_id"), df[vector].alias("v")).filter(whole(F.col("v")))
    rows = source.select("vec_id", as_integers(F.col("v")).alias("x"))
    schema = rows.select("vec_id").schema
    named = lambda found: found.withColumnRenamed("vec_id", vec_id)
    points = saved(rows.select("x").distinct(), "distinct-vectors")
    sizes = points.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    kind = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if sizes is None:
        empty = spark.createDataFrame([], kind)
        return named(rows.select("vec_id").limit(0).join(empty, F.lit(False)))
    size = sizes["size"]
    points = points.filter(F.size("x") == size)
    model = fit(points, components)
    error = identity_error(points, model)
    shares = [float(v) / model.trace if model.trace > 0 else None for v in model.values]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                white = model.project(x)
                flat = pa.array(white.ravel(), mask=np.isnan(white.ravel()))
                ends = pa.array(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32))
                exact = [Decimal(d) if d < 10**38 else None for d in model.deviation(x)]
                exact = pa.array(exact, pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), exact, pa.ListArray.from_arrays(ends, flat)], ["vec_id", "deviation", "white"]
                )

    scored = rows.filter(F.size("x") == size).mapInArrow(score, schema.add("deviation", T.DecimalType(38, 0)).add("white", T.ArrayType(T.DoubleType())))
    each = scored.select("vec_id", "deviation", F.posexplode("white").alias("at", "whitened"))
    explained = F.element_at(F.array(*[F.lit(s).cast("double") for s in shares]), F.col("at") + 1)
    return named(
        each.select(
            "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
            explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
        )
    )
