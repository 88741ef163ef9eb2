"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network in numpy.

Every token (run of letters, digits or other characters) is hashed to one of BUCKETS words. A word's index vector is sparse
and random; its word vector is the sum of the index vectors of its neighbours over the whole corpus (one pass, summed by a
tree of tasks; 4 MB whatever the input). A document is the mean word vector over its tokens and over its distinct words,
with the share of distinct words and the log of its length. The network is fitted on a bounded sample of labelled rows and
its probabilities are calibrated by one temperature on rows that the fit did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import append_columns, no_text, sliced, summed

BUCKET_BITS, DIM, NONZERO, REACH = 14, 64, 4, 2
BUCKETS = 1 << BUCKET_BITS
OUT = [T.StructField("score", T.DoubleType())]


def _bucket(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the few entries of each word's index vector, from a fixed hash."""
    seeds = K.mix(np.arange(BUCKETS * NONZERO, dtype=np.uint64) + np.uint64(K.SECOND)).reshape(BUCKETS, NONZERO)
    return (seeds % np.uint64(DIM)).astype(np.int64), np.where(seeds >> np.uint64(63), 1, -1).astype(np.int32)


def word_vectors(texts: DataFrame) -> np.ndarray:
    """Unit word vectors (BUCKETS x DIM) from the neighbours of all tokens of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_vectors()
        total = np.zeros(BUCKETS * DIM, np.int32)
        for batch in batches:
            for w in K.words(batch.column("text"), K.TYPED_RUNS):
                b = _bucket(w.value)
                row = np.repeat(np.arange(w.hi - w.lo), np.diff(w.ptr))
                for off in range(1, REACH + 1):
                    same = np.flatnonzero(row[off:] == row[:-off])
                    left, right = b[same], b[same + off]
                    for j in range(NONZERO):
                        np.add.at(total, left * DIM + place[right, j], sign[right, j])
                        np.add.at(total, right * DIM + place[left, j], sign[left, j])
        yield sliced(total)

    total = summed(texts.mapInArrow(count, "part int, table binary"), np.int32, BUCKETS * DIM, np.int64).reshape(BUCKETS, DIM).astype(np.float64)
    return (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def features(vectors: np.ndarray, col: pa.Array) -> np.ndarray:
    out = np.zeros((len(col), 2 * DIM + 2), np.float32)
    for w in K.words(col, K.TYPED_RUNS):
        b = _bucket(w.value)
        for r in range(w.hi - w.lo):
            mine = b[w.ptr[r] : w.ptr[r + 1]]
            if len(mine):
                kinds, n = np.unique(mine, return_counts=True)
                v = vectors[kinds]
                out[w.lo + r, :DIM] = n.astype(np.float32) @ v / len(mine)
                out[w.lo + r, DIM : 2 * DIM] = v.mean(axis=0)
                out[w.lo + r, -2] = len(kinds) / len(mine)
                out[w.lo + r, -1] = np.log1p(len(mine)) / 10
    return out


@dataclass
class Model:
    vectors: np.ndarray
    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.shift) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -60, 60)))


def _nll(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_network(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, part: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 2e-3, decay: float = 1e-4) -> Model:
    """Adam on the log loss; ``part`` (0 to 4) sets one fifth of the rows aside for the temperature."""
    rng = np.random.default_rng(7)
    aside = part == 0 if (part == 0).any() and (part > 0).any() else np.ones(len(y), bool)
    fit = ~aside if (~aside).any() else aside
    shift, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-4
    z = ((x[fit] - shift) / scale).astype(np.float64)
    t = y[fit]
    p = {"w1": rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, np.sqrt(1 / hidden), hidden), "b2": np.zeros(1)}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(t))
        for lo in range(0, len(t), 256):
            i = order[lo : lo + 256]
            pre = z[i] @ p["w1"] + p["b1"]
            h = np.maximum(pre, 0)
            err = (1 / (1 + np.exp(-np.clip(h @ p["w2"] + p["b2"], -60, 60))) - t[i]) / len(i)
            back = np.outer(err, p["w2"]) * (pre > 0)
            grad = {"w1": z[i].T @ back + decay * p["w1"], "b1": back.sum(axis=0), "w2": h.T @ err + decay * p["w2"], "b2": err.sum(keepdims=True)}
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, shift, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]), 1.0)
    logits, truth = model.logit(x[aside]), y[aside]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    model.temperature = float(min(grid, key=lambda g: _nll(logits / g, truth)))
    return model


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20000) -> Model | None:
    """Word vectors from all of ``docs``; the network from about ``max_rows`` labelled rows that ``train`` keeps (all, if there
    are fewer; else those with the smallest hash of their id). Null labels don't count; several labels of a row are averaged; of
    rows that repeat an id the one with the smallest hash of its text counts.
    """
    known = labels.where(train & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.avg(label_col).alias("__y"))
    total = known.count()
    if not total:
        return None
    share = int(min(1.0, max_rows / total) * (1 << 30))
    some = known.where(F.pmod(F.xxhash64(F.lit("quality"), "__id"), F.lit(1 << 30)) < share)
    vectors = word_vectors(docs.select(no_text(F.col(text_col)).alias("text")))
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    # At most about max_rows ids: small enough to send to every task by construction. Of rows that repeat an id one counts.
    rows = docs.select(F.col(id_col).alias("__id"), no_text(F.col(text_col)).alias("text")).join(F.broadcast(some), "__id")
    rows = rows.groupBy("__id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("__y").alias("__y"))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(held.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("__y"), batch.column("part"), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "part", "x"])

    got = rows.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(5)).cast("int")).select("__y", "part", "text").mapInArrow(turn, "y double, part int, x binary").toPandas().sort_values(["x", "y"], ignore_index=True)
    if not len(got):
        return None
    x = np.stack([np.frombuffer(b, np.float32) for b in got["x"]])
    return fit_network(vectors, x, got["y"].to_numpy(float), got["part"].to_numpy())


def rate(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with score (0 to 1). Null counts as empty text, which gets the score of no words;
    without a model every score is 0.5. Equal texts have equal scores."""
    if model is None:
        return append_columns(docs, lambda b: {"score": [0.5] * b.num_rows}, OUT)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return append_columns(docs, lambda b: {"score": pa.array(held.value.score(features(held.value.vectors, b.column(text_col))).astype(np.float64))}, OUT)
