"""Language identification by a convolutional network over bytes.

Every byte has a small vector; filters of several widths slide over a window of
fixed length, the largest answer of each filter is kept (max pooling), and a
softmax layer gives the languages.  The network is trained in numpy with Adam on
windows of a bounded sample of labelled texts, and then applied to all windows of
every whole text, in blocks, so a very long text needs no more memory than a
short one.  The shares of a text's windows are averaged by their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.llm.common import identity

UNDETERMINED = "und"
FOLDS = 4
HELD_OUT = 2
SAMPLE = 6_000  # documents to learn from, over all languages
LANGUAGES = 500  # learned values of lang; of more, those with the most documents
CUTS = 2  # windows taken of each of them
WINDOW = 192  # bytes
WIDTHS = (2, 3, 4)
FILTERS = 12  # of each width
VECTOR = 8  # numbers for each byte
STEPS = 900
BATCH = 64
RATE = 0.004
L2 = 1e-4
BLOCK = 64  # windows at once when a text is scored
REACH = max(WIDTHS) - 1


def windows(text: bytes, length: int = WINDOW) -> np.ndarray:
    """All windows of a text, one after another; each also sees the bytes its last filters reach into."""
    count = max(1, -(-len(text) // length))
    padded = np.frombuffer(text + bytes(count * length + REACH - len(text)), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, length + REACH)[::length]


@dataclass
class Network:
    languages: list[str]
    table: np.ndarray  # 256 x VECTOR
    filters: np.ndarray  # (REACH + 1) * VECTOR x number of filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.table, self.filters, self.bias, self.out, self.out_bias]


def reach_mask() -> np.ndarray:
    """1 where a filter of its width has a weight."""
    mask = np.zeros(((REACH + 1) * VECTOR, len(WIDTHS) * FILTERS), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[: width * VECTOR, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask


def untrained(languages: list[str], seed: int = 7) -> Network:
    draw = np.random.default_rng(seed)
    normal = lambda *size, scale: (draw.standard_normal(size) * scale).astype(np.float32)
    mask = reach_mask()
    filters = normal(*mask.shape, scale=1.0) * mask / np.sqrt(mask.sum(0))
    many = mask.shape[1]
    return Network(
        languages, normal(256, VECTOR, scale=0.5), filters.astype(np.float32), np.zeros(many, np.float32),
        normal(many, len(languages), scale=many**-0.5), np.zeros(len(languages), np.float32),
    )


def _columns(net: Network, ids: np.ndarray) -> np.ndarray:
    """For every place of every window, the vectors of the bytes a filter sees there."""
    rows = net.table[ids].reshape(len(ids), -1)
    return np.lib.stride_tricks.sliding_window_view(rows, (REACH + 1) * VECTOR, axis=1)[:, ::VECTOR]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def pair_tables(net: Network) -> list[np.ndarray]:
    """What every pair of bytes adds to the filters, for the first pair a filter sees, the second and so on."""
    tables = []
    for at in range(0, REACH + 1, 2):
        weight = net.filters[at * VECTOR : (at + 2) * VECTOR]
        one = net.table @ weight[:VECTOR]
        two = net.table @ weight[VECTOR:] if len(weight) > VECTOR else np.zeros_like(one)
        tables.append((one[:, None] + two[None]).reshape(1 << 16, -1).astype(np.float32))
    return tables


def probabilities(net: Network, tables: list[np.ndarray], ids: np.ndarray) -> np.ndarray:
    """Share of each language for every window (a row of bytes)."""
    found = np.empty((len(ids), len(net.languages)), np.float32)
    length = ids.shape[1] - REACH
    room = np.empty((2, min(BLOCK, len(ids)), length, net.filters.shape[1]), np.float32)
    for start in range(0, len(ids), BLOCK):
        part = ids[start : start + BLOCK].astype(np.intp)
        pairs = (part[:, :-1] << 8) | part[:, 1:]
        seen, more = room[0, : len(part)], room[1, : len(part)]
        np.take(tables[0], pairs[:, :length], axis=0, out=seen, mode="clip")
        for k, table in enumerate(tables[1:], 1):
            np.take(table, pairs[:, 2 * k : 2 * k + length], axis=0, out=more, mode="clip")
            seen += more
        while seen.shape[1] % 2 == 0:  # halves first: long rows are compared faster
            half = seen.shape[1] // 2
            seen = np.maximum(seen[:, :half], seen[:, half:])
        pooled = np.maximum(seen.max(1) + net.bias, 0)
        found[start : start + BLOCK] = _softmax(pooled @ net.out + net.out_bias)
    return found


def gradients(net: Network, ids: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross entropy of some windows, and its slope for every parameter."""
    n, mask = len(ids), reach_mask()
    columns = _columns(net, ids)
    seen = np.ascontiguousarray(columns).reshape(-1, len(net.filters)) @ net.filters
    seen = seen.reshape(n, -1, net.filters.shape[1])
    place = seen.argmax(1)  # n x filters
    row = np.arange(n)[:, None]
    top = seen[row, place, np.arange(seen.shape[2])] + net.bias
    pooled = np.maximum(top, 0)
    share = _softmax(pooled @ net.out + net.out_bias)
    loss = float(-np.log(np.maximum(share[np.arange(n), labels], 1e-12)).mean())
    slope = share.copy()
    slope[np.arange(n), labels] -= 1
    slope /= n
    back = (slope @ net.out.T) * (top > 0)
    filters = np.einsum("nf,nfk->kf", back, columns[row, place]) * mask
    through = (back[:, :, None] * net.filters.T).reshape(n, back.shape[1], REACH + 1, VECTOR)
    bytes_seen = ids[row[:, :, None], place[:, :, None] + np.arange(REACH + 1)]
    table = np.zeros_like(net.table)
    for k in range(VECTOR):
        table[:, k] = np.bincount(bytes_seen.ravel(), through[..., k].ravel(), 256)
    return loss, [table, filters, back.sum(0), pooled.T @ slope, slope.sum(0)]


def train(ids: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam over batches that hold all languages alike."""
    net = untrained(languages, seed)
    if len(languages) < 2:
        return net
    draw = np.random.default_rng(seed)
    members = [np.flatnonzero(labels == k) for k in range(len(languages))]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        chosen = draw.integers(0, len(languages), BATCH)
        rows = np.array([members[k][draw.integers(len(members[k]))] for k in chosen])
        _, slopes = gradients(net, ids[rows], labels[rows])
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, (m, v) in zip(net.parameters(), slopes, state, strict=True):
            g = g + L2 * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def predict(net: Network, texts: list[bytes], tables: list[np.ndarray] | None = None) -> list[tuple[int, float]]:
    """The best language of every text and its share, from all windows of the whole text."""
    found, tables = [], tables or pair_tables(net)
    for text in texts:
        total, seen = np.zeros(len(net.languages)), 0
        step = WINDOW * BLOCK * 64
        for start in range(0, max(1, len(text)), step):
            part = text[start : start + step + REACH]
            ids = windows(part)[: -(-step // WINDOW)]
            weight = np.minimum(WINDOW, np.maximum(0, min(len(part), step) - WINDOW * np.arange(len(ids))))
            total += weight @ probabilities(net, tables, ids).astype(np.float64)
            seen += int(weight.sum())
        best = int(total.argmax())
        found.append((best, float(total[best] / max(1, seen))))
    return found


def held_out(doc_id: Column) -> Column:
    """crc32(id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def _cuts(texts: pd.Series) -> pd.Series:
    """A few windows spread over a text, to learn from."""

    def some(text: bytes) -> list[bytes]:
        starts = np.unique(np.linspace(0, max(0, len(text) - WINDOW), CUTS).astype(int) // WINDOW * WINDOW)
        return [text[s : s + WINDOW + REACH] for s in starts.tolist()]

    return pd.Series([some(t) for t in texts], dtype=object)


def sample(documents: DataFrame, most: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """Rows (lang, text) to learn from: of every language the first documents by a hash of the text.

    At most ``most`` rows in all, shared out equally to the (at most ``languages``)
    languages.  Held-out documents, a null lang, and texts without a letter teach nothing;
    equal texts of one language count once, so a group of copies teaches no more than one text.
    """
    usable = documents.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & (F.col("lang") != UNDETERMINED) & ~held_out(F.col("doc_id")) & has_letter(F.col("text"))
    )
    order = F.pmod(F.xxhash64("text", F.lit("language")), F.lit(1 << 40))
    hashed = usable.select("lang", order.alias("o")).distinct()
    counts = hashed.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()  # one row a language
    if not counts:
        return usable.select("lang", "text").limit(0)
    each = max(1, most // len(counts))
    # a hash bound leaves few more than needed, so no task sorts a language
    bounds = {r["lang"]: min(1 << 40, int((1.3 * each + 20) / r["count"] * (1 << 40))) for r in counts}
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair]), F.col("lang"))
    near = usable.select("lang", "text", order.alias("o")).filter(F.col("o") < F.coalesce(bound, F.lit(0).cast("long")))
    first = near.groupBy("lang", "o").agg(F.min("text").alias("text"))
    ranked = first.select("*", F.row_number().over(Window.partitionBy("lang").orderBy("o")).alias("r"))
    return ranked.filter(F.col("r") <= each).select("lang", "text")


def learn(documents: DataFrame, most: int = SAMPLE, steps: int = STEPS) -> Network | None:
    """A network trained on the sample; None if no document teaches a language."""
    cut = sample(documents, most).select("lang", F.explode(_cuts(F.col("text").cast("binary"))).alias("w"))
    rows = sorted((r["lang"], bytes(r["w"])) for r in cut.collect())  # at most CUTS windows for each sampled document
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    ids = np.array([np.frombuffer(w.ljust(WINDOW + REACH, b"\0"), np.uint8) for _, w in rows])
    labels = np.array([languages.index(lang) for lang, _ in rows])
    return train(ids, labels, languages, steps)


def identify(documents: DataFrame, most: int = SAMPLE, steps: int = STEPS) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score, k_id, k_text.

    One row per input row; equal texts get equal answers.  A null text, an empty
    one and one without a letter give ``und`` with score 0, and so do all texts if
    nothing could be learned.  Of equal shares the language first in order counts.
    Languages are learned from at most ``most`` documents; all whole texts are scored.
    """
    net = learn(documents, most, steps)
    names = net.languages if net else [UNDETERMINED]

    @F.pandas_udf("at int, score double")
    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tables = pair_tables(net)
        for texts in batches:
            yield pd.DataFrame(predict(net, [t or b"" for t in texts], tables), columns=["at", "score"])

    letters = has_letter(F.col("text"))
    rows = documents.select("doc_id", "text", *identity(), letters.alias("letters"))
    if net is None:
        rows = rows.withColumn("found", F.lit(None).cast("struct<at:int,score:double>"))
    else:
        # texts without a letter go in as empty ones: they need no windows
        rows = rows.withColumn("found", answers(F.when(F.col("letters"), F.col("text")).cast("binary")))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("found.at") + 1)
    told = F.col("letters") & F.col("found").isNotNull()
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"),
        F.when(told, named).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(told, F.least(F.greatest(F.col("found.score"), F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("score"),
        "k_id", "k_text",
    )
