"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: each distinct word, pair of neighbouring words and pair with one word
between (skip-gram), hashed to ``2 ** LOG2_WEIGHTS`` buckets; words are runs of letters,
digits and non-ASCII bytes, A-Z lowered. Every coordinate has its own learning rate, and L1
keeps weights at exactly zero until the evidence exceeds it, so the model is one array of
fixed size, mostly zeros: that is the bound on what is broadcast.

Training reads a bounded sample of the labelled rows: the ``SAMPLE`` with the smallest hash
of id and text (all of them if there are fewer). FTRL is sequential, so the sample is learned
in one task, in hash order, ``EPOCHS`` times; the bound on rows bounds that task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.text import LOWER, U, SpanHash, mix, pieces, spans

LOG2_WEIGHTS = 20
SAMPLE = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 3.0, 0.1

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def features(p, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (bucket, document) of a piece, sorted by document; ``wanted`` flags the
    buckets to give."""
    low = LOWER[p.buf]
    p = type(p)(p.lo, p.hi, low, p.offs)
    start, end, doc = spans(p, _WORD[low])
    w = SpanHash(low)(start, end)
    parts = [(w, doc)]
    for gap, salt in ((1, U(0xA0761D6478BD642F)), (2, U(0xE7037ED1A0B428DB))):
        if len(w) > gap:
            same = doc[gap:] == doc[:-gap]
            parts.append(((mix(w[:-gap] + salt) + w[gap:] * salt)[same], doc[gap:][same]))
    h = np.concatenate([mix(x) >> U(64 - LOG2_WEIGHTS) for x, _ in parts]).astype(np.int64)
    d = np.concatenate([x for _, x in parts])
    if wanted is not None:
        use = wanted[h]
        h, d = h[use], d[use]
    key = np.unique((d << LOG2_WEIGHTS) | h)
    return key & ((1 << LOG2_WEIGHTS) - 1), key >> LOG2_WEIGHTS


def ftrl(rows: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias. One pass after another over the rows, one row at a time."""
    size = 1 << LOG2_WEIGHTS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = [np.append(r, size) for r in rows]  # the last coordinate is the bias, without L1

    def weights(zi, ni, l1):
        w = -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2)
        w[np.abs(zi) <= l1] = 0
        return w

    for _ in range(epochs):
        for at, y in zip(rows, labels):
            l1 = np.full(len(at), L1)
            l1[-1] = 0
            w = weights(z[at], n[at], l1)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    l1 = np.full(size + 1, L1)
    l1[-1] = 0
    w = weights(z, n, l1)
    return w[:-1].astype(np.float32), float(w[-1])


@dataclass
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of (text, toxic, draw) rows; rows with a null label are not used. Without rows
    the model knows nothing and scores everything 0."""
    rows = (labelled.filter(F.col("toxic").isNotNull()).select("text", F.col("toxic").cast("int").alias("toxic"), "draw")
            .orderBy("draw", "toxic").limit(sample).coalesce(1))

    def learn(batches):
        got, labels = [], []
        for b in batches:
            labels += b.column("toxic").to_pylist()
            for p in pieces(b.column("text")):
                h, d = features(p)
                got += np.split(h, np.searchsorted(d, np.arange(1, p.n)))
        if not labels:
            return
        w, bias = ftrl(got, labels)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], bias).astype(float))],
                                         ["bucket", "weight"])

    got = rows.mapInArrow(learn, "bucket long, weight double").toArrow()  # at most one row a bucket
    at, w = got.column("bucket").to_numpy(), got.column("weight").to_numpy()
    bias = float(w[at == -1][0]) if len(at) else -40.0
    return Model(at[at >= 0], w[at >= 0], bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, held_out, text) -> doc_id, held_out, score, predicted. A null or
    empty text has no features and gets the score of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        w = np.zeros(1 << LOG2_WEIGHTS)
        w[m.buckets] = m.weights
        wanted = w != 0
        for b in batches:
            for p in pieces(b.column("text")):
                h, d = features(p, wanted)
                s = 1 / (1 + np.exp(-np.clip(np.bincount(d, weights=w[h], minlength=p.n) + m.bias, -40, 40)))
                cut = b.slice(p.lo, p.n)
                yield pa.RecordBatch.from_arrays(
                    [cut.column("doc_id"), cut.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int")
