"""Toxicity: a linear-chain conditional random field with two tags tags toxic spans.

Tokens to learn from are labelled by the documents' labels: a token is toxic if it stands in a document
labelled toxic and its word or a beginning of it occurs far more often in such documents than in clean ones.
The field has features of each token (word, its first letters, its last letters) and transitions, and is
fitted by Adam on the exact likelihood, with expectations from forward-backward. Forward-backward
marginals p of whole documents give the score and the offending spans (runs of tokens above SPAN). The score is the larger of
the largest marginal and 1 - product(1 - p * p): several tokens in doubt add up, but not the traces that
every token of a long document leaves.

Emissions depend on the token alone, so that each worker keeps them in a bounded table. Long documents are
cut into windows of WINDOW tokens that are run side by side. What a window tells its neighbours is exact: its product of
transition and emission matrices (2 x 2) takes the forward message through it in one direction and the backward message in the
other, so that marginals are those of the whole chain, however far an influence reaches.

Training takes a bounded sample: PER_CLASS documents of each label outside the held-out fold, all of their tokens
in windows of TRAIN_WINDOW. The same input gives the same field.

Defined results: a null or empty text scores 0 and has no spans; without labels of both kinds nothing
is toxic; repeated rows are all scored; an empty table gives an empty result; further columns are kept by
kept() and ignored by classify().
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import held_out_column, ready_workers
from corpusloom.llm.labelled import sample

PER_CLASS = 1500
#: Log odds above which a feature marks a token as toxic, and in how many toxic documents it stands at least.
MARK_ODDS, MARK_DOCS, MARK_SHARE = 3.0, 4, 0.03
#: Tokens of a training window, windows that are held at a time.
TRAIN_WINDOW, COLUMNS = 64, 2048
STEPS, RATE, DECAY = 120, 0.15, 2e-5
#: Tokens of a window, windows side by side.
WINDOW, GROUP = 512, 256
SPAN, THRESHOLD = 0.5, 0.5
KEPT_TOKENS = 50_000
_EDGES = b".,;:!?\"'()[]{}<>|#*$%&-_"


def token_features(token: bytes) -> list[bytes]:
    word = token.lower().strip(_EDGES) or token.lower()
    found = [b"w" + word]
    if len(word) >= 4:
        found += [b"4" + word[:4], b"s" + word[-3:]]
    if len(word) >= 5:
        found.append(b"5" + word[:5])
    return found


@dataclass
class Field:
    weights: dict[bytes, float]
    bias: float
    transitions: np.ndarray  # 2 x 2 log weights, from row to column; tag 1 is toxic

    def emission(self, token: bytes) -> float:
        get = self.weights.get
        return self.bias + sum([get(f, 0.0) for f in token_features(token)])


def forward_backward(odds: np.ndarray, a: np.ndarray, live: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """odds: weight of the toxic tag over the other, places x windows; a: 2 x 2 transition weights. live: whether a
    place is in its window. before: ratio of the forward message of the window before (NaN: there is none); after: ratio of the
    backward message at the last place (1 at a text's end). Marginals of the toxic tag, and of a toxic tag after a toxic one, after another,
    another after a toxic one (3 x places x windows, at each place but the first)."""
    n, m = odds.shape
    f = np.empty((n, m))  # forward ratio of toxic to other
    b = np.ones((n, m))  # backward ratio
    r = odds[0]
    if before is not None:
        r = np.where(np.isnan(before), r, r * (a[0, 1] + before * a[1, 1]) / (a[0, 0] + before * a[1, 0]))
    f[0] = r
    for t in range(1, n):
        r = odds[t] * (a[0, 1] + r * a[1, 1]) / (a[0, 0] + r * a[1, 0])
        f[t] = r
    back = np.ones(m) if after is None else np.where(live[-1], after, 1.0)  # a window that ends before the last place ends its text
    b[-1] = back
    for t in range(n - 2, -1, -1):
        o = odds[t + 1] * back
        back = np.where(live[t + 1], (a[1, 0] + o * a[1, 1]) / (a[0, 0] + o * a[0, 1]), 1.0)
        b[t] = back
    x = f * b
    marginal = np.where(live, x / (1 + x), 0.0)
    o = odds[1:] * b[1:]
    joint = np.stack([f[:-1] * a[1, 1] * o, a[0, 1] * o, f[:-1] * a[1, 0]])
    joint = np.where(live[1:], joint / (joint.sum(axis=0) + a[0, 0]), 0.0)
    return marginal, joint


def passages(odds: np.ndarray, a: np.ndarray, live: np.ndarray, first: np.ndarray) -> np.ndarray:
    """windows x 2 x 2: what a window makes of the forward message that enters it, up to a factor.
    first: whether a window begins its text, so that no transition leads to its first place."""
    low = np.where(first, np.array([[1.0], [0.0]]), a[:, :1])  # weight of the other tag, by tag of the message that enters
    high = odds[0] * np.where(first, np.array([[0.0], [1.0]]), a[:, 1:])
    for t in range(1, len(odds)):
        new = low * a[0, 0] + high * a[1, 0], odds[t] * (low * a[0, 1] + high * a[1, 1])
        scale = np.maximum(*new).max(axis=0)
        low, high = np.where(live[t], new[0] / scale, low), np.where(live[t], new[1] / scale, high)
    return np.stack([low, high]).transpose(2, 0, 1)


def weak_tags(texts: Iterable[list[bytes]], labels: list[int]) -> dict[bytes, bool]:
    """Features that mark a token as toxic."""
    counts = Counter(), Counter()
    for tokens, y in zip(texts, labels):
        counts[y].update({f for t in set(tokens) for f in token_features(t) if f[:1] != b"s"})
    toxic, clean = max(1, sum(labels)), max(1, len(labels) - sum(labels))
    least = max(MARK_DOCS, MARK_SHARE * toxic)
    return {f: True for f, c in counts[1].items() if c >= least and math.log((c + 0.5) / (toxic + 1)) - math.log((counts[0][f] + 0.5) / (clean + 1)) >= MARK_ODDS}


def train(texts: list[bytes], labels: list[int]) -> Field:
    marks = weak_tags((t.split() for t in texts), labels)
    if not marks or min(labels) == max(labels):
        return Field({}, -40.0, np.zeros((2, 2)))
    # a token's emission depends on the token alone: features are those of distinct tokens
    kinds: dict[bytes, int] = {}
    tokens = [np.array([kinds.setdefault(t, len(kinds)) for t in text.split()], np.int32) for text in texts]
    ids: dict[bytes, int] = {}
    of_kind, feature, marked = [], [], np.zeros(len(kinds), bool)
    for t, k in kinds.items():
        found = token_features(t)
        marked[k] = any(f in marks for f in found)
        of_kind.extend([k] * len(found))
        feature.extend(ids.setdefault(f, len(ids)) for f in found)
    of_kind, feature = np.array(of_kind, np.int32), np.array(feature, np.int32)
    m = sum(-(-len(own) // TRAIN_WINDOW) for own in tokens)
    live, truth, kind = np.zeros((TRAIN_WINDOW, m), bool), np.zeros((TRAIN_WINDOW, m), bool), np.zeros((TRAIN_WINDOW, m), np.int32)
    column = 0
    for own, y in zip(tokens, labels):
        for begin in range(0, len(own), TRAIN_WINDOW):
            part = own[begin : begin + TRAIN_WINDOW]
            live[: len(part), column], kind[: len(part), column] = True, part
            truth[: len(part), column] = marked[part] & bool(y)
            column += 1
    w, bias, trans = np.zeros(len(ids)), -3.0, np.zeros(3)  # transitions 1-1, 0-1, 1-0 against 0-0
    was, is_, both = truth[:-1], truth[1:], live[1:]
    seen = np.array([np.count_nonzero(x & both) for x in (was & is_, ~was & is_, was & ~is_)], float)
    first, second = [np.zeros_like(w), 0.0, np.zeros(3)], [np.zeros_like(w), 0.0, np.zeros(3)]
    scale = TRAIN_WINDOW / live.sum()
    for step in range(1, STEPS + 1):
        emission = bias + np.bincount(of_kind, w[feature], len(kinds))
        a = np.exp(np.array([[0.0, trans[1]], [trans[2], trans[0]]]))
        by_kind, expected = np.zeros(len(kinds)), np.zeros(3)
        for c in range(0, m, COLUMNS):
            own = slice(c, c + COLUMNS)
            marginal, joint = forward_backward(np.exp(np.clip(emission[kind[:, own]], -40, 40)), a, live[:, own])
            error = (marginal - truth[:, own]) * live[:, own]
            by_kind += np.bincount(kind[:, own].ravel(), error.ravel(), len(kinds))
            expected += joint.sum(axis=(1, 2))
        slopes = [np.bincount(feature, by_kind[of_kind], len(w)) * scale + DECAY * w, by_kind.sum() * scale, (expected - seen) * scale + DECAY * trans]
        new = []
        for k, (value, slope) in enumerate(zip((w, bias, trans), slopes)):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope * slope
            new.append(value - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8))
        w, bias, trans = new
    return Field({f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 1e-3}, float(bias), np.array([[0.0, trans[1]], [trans[2], trans[0]]]))


class Tagger:
    def __init__(self, field: Field):
        self.field, self.a = field, np.exp(field.transitions)
        self.known: dict[bytes, float] = {}

    def emissions(self, tokens: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(tokens).difference(known)
        if new:
            if len(known) + len(new) > KEPT_TOKENS:
                known.clear()
                new = set(tokens)
            for t in new:
                known[t] = self.field.emission(t)
        return np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))

    def marginals(self, texts: list[bytes]) -> list[np.ndarray]:
        """Marginals of the toxic tag for the tokens of each text."""
        scores = [self.emissions(t.split()) for t in texts]
        out = [np.zeros(len(s)) for s in scores]
        windows = [(k, begin) for k, s in enumerate(scores) for begin in range(0, len(s), WINDOW)]
        windows.sort(key=lambda w: min(WINDOW, len(scores[w[0]]) - w[1]))
        told = self.messages(scores, [w for w in windows if len(scores[w[0]]) > WINDOW])
        for group, odds, live in self.laid_out(scores, windows):
            before, after = np.array([told.get(w, (math.nan, 1.0)) for w in group]).T
            found = forward_backward(odds, self.a, live, before, after)[0]
            for c, (k, begin) in enumerate(group):
                core = out[k][begin : begin + WINDOW]
                core[:] = found[: len(core), c]
        return out

    @staticmethod
    def laid_out(scores: list[np.ndarray], windows: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
        """Windows (text and first token, by length) in groups, with their odds and which places are theirs."""
        for i in range(0, len(windows), GROUP):
            group = windows[i : i + GROUP]
            parts = [scores[k][begin : begin + WINDOW] for k, begin in group]
            odds, live = np.full((len(parts[-1]), len(group)), -40.0), np.zeros((len(parts[-1]), len(group)), bool)
            for c, part in enumerate(parts):
                odds[: len(part), c] = part
                live[: len(part), c] = True
            yield group, np.exp(np.clip(odds, -40, 40)), live

    def messages(self, scores: list[np.ndarray], windows: list[tuple[int, int]]) -> dict[tuple[int, int], tuple[float, float]]:
        """Of each window of texts of several: ratio of the forward message that enters it (NaN for the first), and of the
        backward message at its last place."""
        ways = {}
        for group, odds, live in self.laid_out(scores, windows):
            ways.update(zip(group, passages(odds, self.a, live, np.array([begin == 0 for _, begin in group]))))
        told = {}
        for k in sorted({k for k, _ in windows}):
            begins = range(0, len(scores[k]), WINDOW)
            before, after, message = [math.nan], [1.0], np.ones(2)
            for begin in begins[:-1]:
                message = ways[k, begin] @ message
                message /= message.max()
                before.append(message[1] / message[0])
            message = np.ones(2)
            for begin in reversed(begins[1:]):
                message = ways[k, begin].T @ message
                message /= message.max()
                after.append(message[1] / message[0])
            told.update(((k, begin), pair) for begin, pair in zip(begins, zip(before, reversed(after))))
        return told

    def scored(self, texts: list[bytes]) -> tuple[list[float], list[list[dict]]]:
        """Score and spans (start and end in code points) of each text."""
        scores, spans = [], []
        for text, p in zip(texts, self.marginals(texts)):
            scores.append(float(max(p.max(initial=0.0), 1 - np.prod(1 - p * p))))
            spans.append(_spans(text, p) if (p >= SPAN).any() else [])
        return scores, spans


def _spans(text: bytes, p: np.ndarray) -> list[dict]:
    """Runs of tokens above SPAN; offsets count code points."""
    found: list[dict] = []
    last = -2
    at_byte = at = 0
    for i, m in enumerate(re.finditer(rb"[^\x20\x09-\x0D]+", text)):
        if p[i] >= SPAN:
            at, at_byte = at + len(text[at_byte : m.start()].decode("utf-8", "replace")), m.start()
            start = at
            at, at_byte = at + len(text[at_byte : m.end()].decode("utf-8", "replace")), m.end()
            if i == last + 1:
                found[-1]["end"] = at
            else:
                found.append({"start": start, "end": at})
            last = i
    return found


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    return train(*sample(docs, labels, "toxic", PER_CLASS))


_SPANS = "array<struct<start:int,end:int>>"


def score(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with two more columns: score and spans."""
    ready_workers(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(field)  # bounded by the training sample

    @F.pandas_udf(f"score double, spans {_SPANS}")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(held.value)
        for texts in batches:
            scores, spans = tagger.scored([(t or "").encode("utf-8", "replace") for t in texts])
            yield pd.DataFrame({"score": scores, "spans": spans})

    return docs.withColumn("_tagged", of(F.col(text))).withColumns({"score": F.col("_tagged.score"), "spans": F.col("_tagged.spans")}).drop("_tagged")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and spans of each row of docs."""
    rows = score(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), fit(docs, labels))
    return rows.select("doc_id", F.coalesce(held_out_column(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not rejected."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    return score(rows, fit(docs, labels)).where(F.col("score") < THRESHOLD).select("row.*")
