"""Quality classifier by pairwise ranking (Bradley-Terry).

A document's score is linear in features of its whole text: shares of byte classes and of neighbouring classes, word lengths,
repetition of words and lines. Weights are learnt from preference pairs, a labelled good document before a labelled bad one, by
logistic loss on the difference of their features. The threshold is a quantile of the training scores, the one that agrees best
with the labels; scores are mapped to 0..1 so that this quantile is 0.3.

Defined cases: null and empty texts have all features 0 and are scored like any other text; a table without labels, or with one
label alone, gives everyone the score 0.5; an empty table gives an empty result; repeated rows are scored alike; very long texts are
read whole, in slices of their own; equal scores fall on the same side of the threshold; extra columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import id_field, narrow
from tessera.llm.labelled import chosen, held_out
from tessera.llm.tokens import NON_SPACE, batches, cut_words, hash_runs, slices

THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Byte classes: lower, upper, digit, other bytes of words, line break, blank, and each sign of ASCII its own."""
    out = np.zeros(256, np.int64)
    for c in range(256):
        out[c] = 0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c >= 128 else 4 if c in (10, 13) else 5 if c in (32, 9, 11, 12) else 6
    signs = [c for c in range(33, 127) if out[c] == 6]
    for k, c in enumerate(signs):
        out[c] = 7 + k
    return out


CLASS = _classes()
N = int(CLASS.max()) + 1
#: Coarser classes for pairs of neighbours: all signs are one.
COARSE = np.minimum(CLASS, 7)
WIDTH = N + 64 + 9


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per document of a slice."""
    docs, sizes = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((docs, WIDTH), np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(docs), sizes)
    out[:, :N] = np.bincount(doc * N + CLASS[data], minlength=docs * N).reshape(docs, N)
    coarse = COARSE[data]
    pair = doc[1:] * 64 + coarse[:-1] * 8 + coarse[1:]
    out[:, N : N + 64] = np.bincount(pair[doc[1:] == doc[:-1]], minlength=docs * 64).reshape(docs, 64)
    out[:, : N + 64] /= np.maximum(sizes, 1)[:, None]
    w = cut_words(0, data, offsets, NON_SPACE)
    count, more = np.diff(w.bounds), out[:, N + 64 :]
    owner, length = np.repeat(np.arange(docs), count), w.end - w.start
    mean = lambda x: np.bincount(owner, x, docs) / np.maximum(count, 1)
    more[:, 0] = np.log1p(count) / 10
    more[:, 1] = mean(length) / 10
    more[:, 2] = mean(length > 14)
    more[:, 3] = mean(length < 3)
    more[:, 4] = _repeated(owner, w.hash, docs, count)
    lone = ~np.isin(CLASS[data[w.end - 1]], (0, 1, 2, 3)) if len(w.end) else np.zeros(0, bool)
    more[:, 5] = mean(lone)
    more[:, 6] = mean((CLASS[data[w.start]] == 1) & (CLASS[data[np.minimum(w.start + 1, len(data) - 1)]] == 1))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:][data == 10] = True
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    lines = np.searchsorted(offsets, start, "right") - 1
    per = np.bincount(lines, minlength=docs)
    more[:, 7] = np.log1p(per) / 10
    more[:, 8] = _repeated(lines, hash_runs(data, start, end), docs, per)
    return out


def _repeated(owner: np.ndarray, hashes: np.ndarray, docs: int, count: np.ndarray) -> np.ndarray:
    """The share of a document's entries that repeat an earlier one of it."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    same = (o[1:] == o[:-1]) & (h[1:] == h[:-1])
    return np.bincount(o[1:][same], minlength=docs) / np.maximum(count, 1)


@dataclass
class Ranking:
    """Weights over standardised features and the map from scores to 0..1."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    quantile: float
    slope: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights
        z = self.slope * (s - self.quantile) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _featured(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, features as bytes, label of rows doc_id, text, label."""
    for batch in iterator:
        for first, data, offsets in slices(batch.column(1)):
            part = batch.slice(first, len(offsets) - 1)
            x = pa.array([row.tobytes() for row in features(data, offsets)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), x, part.column(2)], ["doc_id", "x", "label"])


def sample(docs: DataFrame, labels: DataFrame, label: str) -> list[tuple[bytes, int]]:
    """(features of the whole text as bytes, label) of the labelled rows: texts stay with the executors."""
    rows = chosen(docs, labels, label).mapInArrow(_featured, f"{id_field(docs)}, x binary, label int").collect()
    return [(bytes(r.x), r.label) for r in sorted(rows, key=lambda r: r.doc_id)]


def fit(rows: list[tuple[bytes, int]], steps: int = 400, pairs: int = 2048, l2: float = 2e-3, seed: int = 5) -> Ranking | None:
    """Learns from (features as bytes, label) rows; None without both labels."""
    y = np.array([label for _, label in rows])
    if not len(y) or y.min() == y.max():
        return None
    x = np.stack([np.frombuffer(r, np.float32) for r, _ in rows])
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-4)
    x = np.clip((x - mean) / scale, -8, 8)
    rng, good, bad = np.random.default_rng(seed), np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        diff = x[rng.choice(good, pairs)] - x[rng.choice(bad, pairs)]
        g = -(diff / (1 + np.exp(np.clip(diff @ w, -40, 40)))[:, None]).mean(0) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = x @ w
    order = np.argsort(s, kind="stable")
    ys, ss = y[order], s[order]
    # cut after k of the lowest scores: labels that agree, 0 below and 1 above; the middle of the best stretch of scores
    agree = np.concatenate([[0], np.cumsum(ys == 0)]) + (ys == 1).sum() - np.concatenate([[0], np.cumsum(ys == 1)])
    best = int(np.argmax(agree[1:-1])) + 1
    quantile = float((ss[best - 1] + ss[best]) / 2)
    slope, z0 = 1.0, np.log(THRESHOLD / (1 - THRESHOLD))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * (s - quantile) + z0, -40, 40)))
        d = s - quantile
        slope = float(np.clip(slope - ((p - y) * d).mean() / max((p * (1 - p) * d * d).mean(), 1e-6), 0.05, 6))
    return Ranking(mean, scale, w, quantile, slope)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", fitted_on: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted (score of 0.3 or more), for each document. One pass over docs beside the sample."""
    held = docs.sparkSession.sparkContext.broadcast(fit(sample(docs if fitted_on is None else fitted_on, labels, label)))

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in iterator:
            for first, data, offsets in slices(batch.column(1)):
                part = batch.slice(first, len(offsets) - 1)
                p = np.full(len(part), 0.5) if model is None else model.score(features(data, offsets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64())], ["doc_id", "score"])

    d = narrow(docs, "doc_id", "text").mapInArrow(run, f"{id_field(docs)}, score double")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """docs less the documents that the classifier rejects, all columns as they are. One pass; rows are judged where they stand."""
    held = docs.sparkSession.sparkContext.broadcast(fit(sample(docs, labels, label)))
    at = docs.columns.index("text")

    def run(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in iterator:
            for first, data, offsets in slices(batch.column(at)):
                part = batch.slice(first, len(offsets) - 1)
                yield part if model is None else part.filter(pa.array(model.score(features(data, offsets)) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
