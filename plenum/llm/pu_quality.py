"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled texts train a logistic model of text
statistics by the non-negative unbiased risk of Kiryo et al. (Positive-Unlabeled
Learning with Non-Negative Risk Estimator).  The class prior of the unlabelled
texts is estimated by the best-bin method of Garg et al. (Mixture Proportion
Estimation and PU Learning): the least ratio of the two classes' upper tails.

The risk is minimised over a bounded sample (``SAMPLE`` texts of each kind, the
first by a hash of id and text).  The centre and spread of the statistics, and the
scores behind the class prior, cover all texts that are not held out; every whole
text is scored.  Negative labels are never used.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.common import identity, saved

SAMPLE = 20_000
THRESHOLD = 0.3
FOLDS = 5
STEPS = 800
RATE = 0.05
L2 = 5e-3
CLIP = 6.0

FEATURES = (
    "words", "symbols", "pipes", "upper", "digits", "exclamations", "punctuation", "variety", "near_repeats",
    "repeated_lines", "line_chars", "word_chars", "longest_word", "non_ascii", "blanks",
)
_SYMBOLS = np.frombuffer(b"#*$%&|<>~^{}[]\\_=+@", np.uint8)
_MARKS = np.frombuffer(b".,;:", np.uint8)


def features(text: bytes | None) -> np.ndarray:
    """Statistics of one whole text; null counts as empty."""
    text = text or b""
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = max(1, int(count.sum() - count[0x80:0xC0].sum()))
    words = text.split()
    n = max(1, len(words))
    lines = [line for line in map(bytes.strip, text.split(b"\n")) if line]
    rate = lambda found, of: np.log1p(100.0 * found / of)
    same = lambda lag: sum(map(operator.eq, words, islice(words, lag, None)))
    return np.array(
        [
            np.log1p(len(words)),
            rate(count[_SYMBOLS].sum(), chars),
            rate(count[ord("|")], n),
            rate(count[65:91].sum(), chars),
            rate(count[48:58].sum(), chars),
            rate(count[ord("!")], n),
            rate(count[_MARKS].sum(), n),
            np.log1p(len(set(words))) / np.log(len(words) + 2),
            rate(sum(map(same, range(1, 5))), n),
            rate(len(lines) - len(set(lines)), max(1, len(lines))),
            np.log1p(chars / max(1, len(lines))),
            np.log1p(sum(map(len, words)) / n),
            np.log1p(max(map(len, words), default=0)),
            rate(count[0xC0:].sum(), chars),
            rate(count[32], chars),
        ],
        dtype=np.float64,
    )


@dataclass
class Model:
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last one is the constant
    prior: float

    def inputs(self, rows: np.ndarray) -> np.ndarray:
        scaled = np.clip((rows - self.centre) / self.spread, -CLIP, CLIP)
        return np.column_stack([scaled, np.ones(len(rows))])

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(self.inputs(rows) @ self.weights)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _adam(gradient, size: int, steps: int) -> np.ndarray:
    weights, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, steps + 1):
        g = gradient(weights)
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        weights = weights - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def nn_risk_weights(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, of_positive: np.ndarray | None = None,
    of_unlabelled: np.ndarray | None = None, steps: int = STEPS,
) -> np.ndarray:
    """Minimise prior * R+(P) + max(0, R-(U) - prior * R-(P)) with logistic loss, over weighted rows.

    Where the second term is negative the step goes up on it instead, so the
    model cannot fit unlabelled texts as negatives below zero risk.
    """

    share = lambda rows, of: np.full(len(rows), 1 / len(rows)) if of is None else of / of.sum()
    wp, wu = share(positive, of_positive), share(unlabelled, of_unlabelled)

    def gradient(w: np.ndarray) -> np.ndarray:
        zp, zu = positive @ w, unlabelled @ w
        loss_negative = np.logaddexp(0, zu) @ wu - prior * (np.logaddexp(0, zp) @ wp)
        pull = L2 * w
        rise = (_sigmoid(zu) * wu) @ unlabelled - prior * ((_sigmoid(zp) * wp) @ positive)
        if loss_negative < 0:
            return pull - rise
        return pull + prior * (((_sigmoid(zp) - 1) * wp) @ positive) + rise

    return _adam(gradient, positive.shape[1], steps)


def class_prior(above_p: np.ndarray, above_u: np.ndarray, n_positive: int, n_unlabelled: int, confidence: float = 0.1) -> float:
    """Share of positives among the unlabelled: the best upper bin of held scores.

    ``above_p`` and ``above_u`` are the shares of both classes at or above each cut.
    """
    slack = np.sqrt(np.log(4 / confidence) / 2) * (n_positive**-0.5 + n_unlabelled**-0.5)
    best = np.argmin((above_u + slack) / np.maximum(above_p, 1e-9))
    return float(np.clip(above_u[best] / above_p[best], 0.02, 0.98))


def share_above(cuts: np.ndarray, values: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    """Share (by weight) of values at or above each rising cut."""
    counts = np.bincount(np.searchsorted(cuts, values, "right"), weights, len(cuts) + 1)
    return counts[::-1].cumsum()[::-1][1:] / counts.sum()


def held_out(doc_id: Column) -> Column:
    """crc32(id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _first_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` distinct (k_id, k_text) of some rows with their count ``n``, the first by hash.

    A hash bound leaves few more than needed before anything is sorted; repeated rows
    count as one, with their number as weight.
    """
    order = F.xxhash64("k_id", "k_text", F.lit("sample"))
    total = rows.agg(F.approx_count_distinct(order, 0.02)).first()[0]
    share = min(1.0, (1.2 * most + 100) / max(1, total))
    near = rows.filter(F.pmod(order, F.lit(1 << 20)) <= int(share * (1 << 20)))
    each = near.groupBy("k_id", "k_text").agg(F.count("*").alias("n"), F.first("x").alias("x"))
    return each.orderBy(F.pmod(order, F.lit(1 << 20)), order).limit(most)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _feature_rows(texts: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in texts], dtype=object)


def featured(documents: DataFrame) -> DataFrame:
    """(doc_id, k_id, k_text, x) of all rows, written once: later steps read some hundred bytes a text."""
    return saved(documents.select("doc_id", *identity(), _feature_rows(F.col("text").cast("binary")).alias("x")), "features")


def _matrix(x: pd.Series) -> np.ndarray:
    return np.array(x.tolist(), dtype=np.float64).reshape(-1, len(FEATURES))


def _bins(rows: DataFrame, model: Model, cuts: np.ndarray) -> np.ndarray:
    """How many rows score between the cuts; the driver sees one number a cut."""

    @F.pandas_udf(T.IntegerType())
    def bin_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, model.score(_matrix(x)), "right").astype("int32"))

    counts = np.zeros(len(cuts) + 1)
    for row in rows.groupBy(bin_of("x").alias("bin")).count().collect():
        counts[row["bin"]] = row["count"]
    return counts


def fit(features: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the features of documents; see ``train``."""
    size = len(FEATURES)
    usable = features.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    trusted = labels.filter("quality = 1").select("doc_id").distinct()
    positive = _first_by_hash(usable.join(trusted, "doc_id", "left_semi"), sample).toPandas()  # at most `sample` rows
    rest = usable.join(trusted, "doc_id", "left_anti")
    unlabelled = _first_by_hash(rest, sample).toPandas()
    if positive.empty or unlabelled.empty:
        return Model(np.zeros(size), np.ones(size), np.zeros(size + 1), 0.5)
    moments = usable.agg(*[f(F.get("x", F.lit(i))) for f in (F.avg, F.stddev_pop) for i in range(size)]).first()
    model = Model(np.array(moments[:size]), np.maximum(np.array(moments[size:]), 1e-3), np.zeros(size + 1), 0.5)
    positive, unlabelled = (part.sort_values(["k_text", "k_id"]) for part in (positive, unlabelled))
    p, u = model.inputs(_matrix(positive["x"])), model.inputs(_matrix(unlabelled["x"]))
    wp, wu = positive["n"].to_numpy(np.float64), unlabelled["n"].to_numpy(np.float64)
    # a plain classifier of one half of the sample gives scores, which estimate the prior: those of
    # the other half of the positives against those of all unlabelled texts
    model.weights = nn_risk_weights(p[::2], u[::2], 0.5, wp[::2], wu[::2])
    held, weight = (p[1::2], wp[1::2]) if len(p) > 1 else (p, wp)
    held_scores = _sigmoid(held @ model.weights)
    cuts = np.unique(held_scores)
    between = _bins(rest, model, cuts)
    above_u = between[::-1].cumsum()[::-1][1:] / between.sum()
    model.prior = class_prior(share_above(cuts, held_scores, weight), above_u, int(weight.sum()), int(between.sum()))
    model.weights = nn_risk_weights(p, u, model.prior, wp, wu)
    return model


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` trusted positives and as many unlabelled texts, each with the number of its rows.

    Trusted are documents with label 1 that are not held out; unlabelled are
    all other documents that are not held out.  Null ids, and labels other than
    1 (null, contradicting ones beside a 1 included) trust nothing by themselves.
    Centre, spread and class prior come from all of them.  Without positives or
    without unlabelled texts every score is 0.5.
    """
    return fit(featured(documents), labels, sample)


def score(text: Column, model: Model) -> Column:
    """Score of every whole text, from 0 to 1; null counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def scores(texts: pd.Series) -> pd.Series:
        rows = np.array([features(t) for t in texts]).reshape(-1, len(FEATURES))
        return pd.Series(model.score(rows))

    return scores(text.cast("binary"))


def classify(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Per document row: doc_id, held_out, score, predicted (1 if score >= threshold), k_id, k_text.

    One row per input row; repeated rows get equal scores, a null or empty text
    is scored by its (zero) statistics.  Without positives or without
    unlabelled rows every score is 0.5.  Other columns are not touched.
    """
    rows = featured(documents)
    model = fit(rows, labels, sample)

    @F.pandas_udf(T.DoubleType())
    def scores(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(x)))

    scored = rows.select("doc_id", "k_id", "k_text", scores("x").alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "k_id", "k_text",
    )


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The document rows that are not rejected, with the columns of the input."""
    model = train(documents, labels, sample)
    return documents.filter(score(F.col("text"), model) >= threshold)
