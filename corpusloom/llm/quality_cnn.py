"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of WIDTH bytes slide over the whole document. Their responses are max-pooled over
overlapping chunks of 2 * HALF bytes (each half belongs to two chunks), and the mean, the largest and the
least response of a filter over all chunks of a document go, with the logarithm of the number of
chunks, to a logistic output: one probability.

A filter over single bytes is a table of 256 weights for each of its WIDTH places. For scoring two
neighbouring places are added up to one table of byte pairs, so that a response costs WIDTH / 2 look-ups
of all filters at once. Training is by Adam, on a bounded sample of labelled documents (PER_CLASS of each
label, whole texts) outside the held-out fold; the same input gives the same network. Responses are held for SLAB bytes
at a time, in training as in scoring, so that a very long text takes no more memory than that beside itself.

Defined results: a null or empty text is one chunk of padding and is scored like any other; without labels
the score is 0.5, with labels of one kind only it is that label; repeated rows are all scored; an empty
table gives an empty result; further columns are kept by kept() and ignored by score().
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out_column, ready_workers
from corpusloom.llm.labelled import sample

WIDTH, FILTERS, HALF = 6, 16, 128
PER_CLASS = 1200
EPOCHS, BATCH, RATE, DECAY = 14, 64, 0.02, 1e-4
THRESHOLD = 0.3
#: Bytes whose responses are held at a time.
SLAB = HALF << 10


@dataclass
class Network:
    tables: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 3 * FILTERS + 1
    base: float

    def pairs(self) -> list[np.ndarray]:
        t = self.tables
        return [(t[j][:, None, :] + t[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes one after the other, each text padded to whole halves with at least WIDTH zeros, and the number
    of halves of each. A filter ends at its place: what it sees before a text is zeros, whatever text stands there."""
    halves = np.array([-(-(len(t) + WIDTH) // HALF) for t in texts])
    ends = np.cumsum(halves) * HALF
    x = np.zeros(int(ends[-1]) if len(texts) else 0, np.uint8)
    for t, end, h in zip(texts, ends.tolist(), halves.tolist()):
        x[end - h * HALF : end - h * HALF + len(t)] = np.frombuffer(t, np.uint8)
    return x, halves


def pooled(x: np.ndarray, pairs: list[np.ndarray]) -> np.ndarray:
    """The largest response of each filter in every half."""
    out = np.empty((len(x) // HALF, FILTERS), np.float32)
    padded = np.concatenate([np.zeros(WIDTH - 1, np.uint8), x]).astype(np.int32)
    codes = padded[:-1] * 256 + padded[1:]
    for a in range(0, len(x), SLAB):
        b = min(a + SLAB, len(x))
        r = pairs[0][codes[a:b]]
        for k, t in enumerate(pairs[1:], 1):
            r += t[codes[a + 2 * k : b + 2 * k]]
        out[a // HALF : b // HALF] = r.reshape(-1, HALF, FILTERS).max(axis=1)
    return out


def pooled_with_places(x: np.ndarray, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest response of each filter in every half, and where in x it is."""
    top, best = np.empty((len(x) // HALF, FILTERS), np.float32), np.empty((len(x) // HALF, FILTERS), np.int64)
    padded = np.concatenate([np.zeros(WIDTH - 1, np.uint8), x])
    for a in range(0, len(x), SLAB):
        b = min(a + SLAB, len(x))
        r = tables[0][padded[a:b]]
        for j in range(1, WIDTH):
            r += tables[j][padded[a + j : b + j]]
        r = r.reshape(-1, HALF, FILTERS)
        at = r.argmax(axis=1)
        top[a // HALF : b // HALF] = np.take_along_axis(r, at[:, None, :], axis=1)[:, 0, :]
        best[a // HALF : b // HALF] = at + a + np.arange(len(at))[:, None] * HALF
    return top, best


def _chunks(halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second half of every chunk, and where the chunks of each text begin. A text of one half is one chunk."""
    n = np.maximum(halves - 1, 1)
    starts = np.cumsum(n) - n
    first = np.arange(n.sum()) - np.repeat(starts, n) + np.repeat(np.cumsum(halves) - halves, n)
    return first, first + np.repeat(halves > 1, n), starts


def features(top: np.ndarray, halves: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, ...]:
    first, second, starts = _chunks(halves)
    h = np.maximum(np.maximum(top[first], top[second]) + bias, 0)
    n = np.maximum(halves - 1, 1)[:, None]
    stats = np.add.reduceat(h, starts) / n, np.maximum.reduceat(h, starts), np.minimum.reduceat(h, starts)
    return np.concatenate([*stats, np.log(n)], axis=1), h, first, second, starts


def probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(texts: list[bytes], labels: list[int], seed: int = 3) -> Network:
    random = np.random.default_rng(seed)
    y = np.array(labels, float)
    net = Network(random.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS), random.normal(0, 0.1, 3 * FILTERS + 1), 0.0)
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        net.base = 0.0 if not len(y) else 30.0 * (2 * y[0] - 1)
        return net
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    state = [[np.zeros_like(p, np.float64) for p in (net.tables, net.bias, net.out, np.zeros(1))] for _ in range(2)]
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(y))
        for a in range(0, len(order), BATCH):
            own = order[a : a + BATCH]
            x, halves = laid_out([texts[i] for i in own])
            padded = np.concatenate([np.zeros(WIDTH - 1, np.uint8), x])
            top, place = pooled_with_places(x, net.tables)
            f, h, first, second, starts = features(top, halves, net.bias)
            p = probability(f @ net.out + net.base)
            error = (p - y[own]) * weight[own] / len(own)
            d_out, d_base = f.T @ error + DECAY * net.out, error.sum()
            # back through mean, max and min to the chunks, the halves that gave the maxima, and their bytes
            d_f = error[:, None] * net.out[None, :]
            n = np.maximum(halves - 1, 1)
            text = np.repeat(np.arange(len(own)), n)
            d_h = (d_f[:, :FILTERS] / n[:, None])[text]
            for k, stat in ((1, f[:, FILTERS : 2 * FILTERS]), (2, f[:, 2 * FILTERS : 3 * FILTERS])):
                hit = h == stat[text]
                d_h += hit / np.add.reduceat(hit, starts)[text] * d_f[text, k * FILTERS : (k + 1) * FILTERS]
            d_h *= h > 0
            from_first = top[first] >= top[second]
            d_top = np.zeros_like(top, np.float64)
            np.add.at(d_top, first, d_h * from_first)
            np.add.at(d_top, second, d_h * ~from_first)
            filters = np.broadcast_to(np.arange(FILTERS), place.shape)
            d_tables = np.stack([np.bincount((padded[place + j].astype(np.int64) * FILTERS + filters).ravel(), d_top.ravel(), 256 * FILTERS).reshape(256, FILTERS) for j in range(WIDTH)])
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            base = np.array([net.base])
            for k, (value, slope) in enumerate(((net.tables, d_tables + DECAY * net.tables), (net.bias, d_h.sum(axis=0)), (net.out, d_out), (base, np.array([d_base])))):
                m, v = state[0][k], state[1][k]
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                value -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(value.dtype)
            net.base = float(base[0])
    return net


def scored(net: Network, texts: list[bytes], pairs: list[np.ndarray]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    x, halves = laid_out(texts)
    return probability(features(pooled(x, pairs), halves, net.bias)[0] @ net.out + net.base)


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    return train(*sample(docs, labels, "quality", PER_CLASS))


def score(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with one more column, score: the probability that a text is of quality 1."""
    ready_workers(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)  # a fixed number of weights

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = held.value.pairs()
        for texts in batches:
            data = [(t or "").encode("utf-8", "replace") for t in texts]
            out = [scored(held.value, data[i : i + 100], pairs) for i in range(0, len(data), 100)]
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn("score", of(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    rows = score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), fit(docs, labels))
    return rows.select("doc_id", F.coalesce(held_out_column(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return score(rows, fit(docs, labels)).where(F.col("score") >= THRESHOLD).select("row.*")
