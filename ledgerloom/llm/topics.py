"""Topics for mixing: k-means over projected tf-idf vectors, each language about its own centre.

A text's vector is the sum, over its distinct words, of fixed random signs weighted by the word's inverse document
frequency; from it goes the mean of its language, so that topics part texts by subject and not by language. Frequencies,
means and the rounds of k-means run over all documents; only the first centres come from a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import discard, pieces, settle, sliced, summed

#: Words are hashed to 2**WORD_BITS counters (half a MB); vectors have DIM numbers.
WORD_BITS, DIM = 16, 32
#: Texts (those with the smallest hashes) from which the first centres are picked, and rounds over all texts after that.
FIRST, ROUNDS = 2048, 6
#: Languages with a mean of their own; more end the run.
MOST_LANGS = 100_000


@dataclass
class Topics:
    #: Signs times inverse document frequency of each hashed word.
    words: np.ndarray
    means: dict[str, np.ndarray]
    centres: np.ndarray

    def assign(self, vectors: np.ndarray, langs: list[str]) -> np.ndarray:
        """Nearest centre of each vector; ties go to the first."""
        zero = np.zeros(DIM, np.float32)
        x = unit(vectors - np.array([self.means.get(v, zero) for v in langs], np.float32).reshape(-1, DIM))
        far = (x * x).sum(1)[:, None] - 2 * (x.astype(np.float64) @ self.centres.T.astype(np.float64)) + (self.centres**2).sum(1)
        return far.argmin(axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 1e-6)


def _distinct(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed word) of the distinct words of each row, in order."""
    row = np.repeat(np.arange(w.hi - w.lo), np.diff(w.ptr))
    both = np.unique(row << WORD_BITS | (w.value >> np.uint64(64 - WORD_BITS)).astype(np.int64))
    return both >> WORD_BITS, both & ((1 << WORD_BITS) - 1)


def vectors(words: np.ndarray, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, numbers of words) of the texts of a column; a text without words has a vector of zeros."""
    out, count = [np.zeros((0, DIM), np.float32)], [np.zeros(0, np.int64)]
    for w in K.words(col, K.LETTER_WORDS):
        x = np.zeros((w.hi - w.lo, DIM), np.float32)
        row, word = _distinct(w)
        if len(row):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            x[row[first]] = np.add.reduceat(words[word], first, axis=0)
        out.append(unit(x))
        count.append(np.diff(w.ptr))
    return np.concatenate(out), np.concatenate(count)


def fit(rows: DataFrame, k: int, dims: list[str]) -> tuple[Topics | None, DataFrame]:
    """(topics, table of dims, topic and n_tokens of every row with words) from rows of text, __lang and ``dims``. None and an
    empty table if no row has words."""
    spark = rows.sparkSession

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << WORD_BITS, np.int64)
        for batch in batches:
            for w in K.words(batch.column("text"), K.LETTER_WORDS):
                np.add.at(table, _distinct(w)[1], 1)
        yield sliced(table)

    df = summed(rows.select("text").mapInArrow(frequencies, "part int, table binary"), np.int64, 1 << WORD_BITS)
    signs = (K.mix(np.arange(1 << WORD_BITS, dtype=np.uint64) + np.uint64(K.SECOND))[:, None] >> np.arange(DIM, dtype=np.uint64) & np.uint64(1)).astype(np.float32) * 2 - 1
    texts = rows.count()
    weight = np.where(df > 0, np.log((1.0 + texts) / np.maximum(df, 1)), 0)
    words = (signs * weight[:, None]).astype(np.float32)
    held = spark.sparkContext.broadcast(words)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                x, n = vectors(held.value, part.column("text"))
                use = pa.array(n > 0)
                listed = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), DIM).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([a.filter(use) for a in (*[part.column(c) for c in ("mark", *dims)], pa.array(n), listed)], names=["mark", *dims, "n_tokens", "x"])

    fields = ", ".join(["mark long", *(f"{d} string" for d in dims), "n_tokens long", "x array<float>"])
    table = settle(rows.select("text", F.xxhash64("text").alias("mark"), *dims).mapInArrow(place, fields), "vectors")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            x, langs = _matrix(batch), batch.column("__lang").to_pylist()
            names, at = np.unique(np.array(langs, object).astype(str), return_inverse=True)
            for j, name in enumerate(names):
                mine = x[at == j].astype(np.float64)
                total[name] = total.get(name, 0) + np.append(mine.sum(axis=0), len(mine))
        for name, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * (DIM + 1)), pa.array(np.arange(DIM + 1), pa.int32()), pa.array(x)], names=["lang", "at", "s"])

    found = table.select("__lang", "x").mapInArrow(sums, "lang string, at int, s double").groupBy("lang", "at").agg(F.sum("s").alias("s"))
    langs = table.select("__lang").distinct().limit(MOST_LANGS + 1).count()
    if langs > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    means: dict[str, np.ndarray] = {}
    for lang, at, s in found.collect():
        means.setdefault(lang, np.zeros(DIM + 1))[at] = s
    model = Topics(words, {v: (x[:DIM] / x[DIM]).astype(np.float32) for v, x in means.items()}, np.zeros((0, DIM), np.float32))
    if not means:
        return None, table.select(*dims, F.lit(None).cast("string").alias("__topic"), "n_tokens")
    some = table.groupBy("mark").agg(F.min(F.struct("__lang", "x")).alias("r")).orderBy("mark").limit(FIRST).select("r.*").collect()
    zero = np.zeros(DIM, np.float32)
    model.centres = _spread(unit(np.array([np.array(x, np.float32) - model.means.get(v, zero) for v, x in some], np.float32)), k)

    for _ in range(ROUNDS):
        now = spark.sparkContext.broadcast(model)

        def join(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(now.value.centres), DIM + 1))
            for batch in batches:
                x, langs = _matrix(batch), batch.column("__lang").to_pylist()
                at = now.value.assign(x, langs)
                own = unit(x - np.array([now.value.means.get(v, zero) for v in langs], np.float32).reshape(-1, DIM))
                np.add.at(total, at, np.hstack([own, np.ones((len(own), 1))]))
            k_at = np.repeat(np.arange(len(total)), DIM + 1)
            yield pa.RecordBatch.from_arrays([pa.array(k_at, pa.int32()), pa.array(np.tile(np.arange(DIM + 1), len(total)), pa.int32()), pa.array(total.ravel())], names=["k", "at", "s"])

        total = np.zeros((len(model.centres), DIM + 1))
        for c, at, s in table.select("__lang", "x").mapInArrow(join, "k int, at int, s double").groupBy("k", "at").agg(F.sum("s").alias("s")).collect():
            total[c, at] = s
        now.unpersist()
        after = np.where(total[:, DIM:] > 0, total[:, :DIM] / np.maximum(total[:, DIM:], 1), model.centres).astype(np.float32)
        done = np.allclose(after, model.centres, atol=1e-6)
        # Sums of floats depend on the order of tasks in their last digits; centres don't.
        model.centres = np.round(after, 5)
        if done:
            break
    now = spark.sparkContext.broadcast(model)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = now.value.assign(_matrix(batch), batch.column("__lang").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(d) for d in dims), pa.array([f"t{i}" for i in at]), batch.column("n_tokens")], names=[*dims, "__topic", "n_tokens"])

    named = table.select(*dims, "n_tokens", "x").mapInArrow(name, ", ".join([*(f"{d} string" for d in dims), "__topic string", "n_tokens long"]))
    cells = settle(named.groupBy(*dims, "__topic").agg(F.sum("n_tokens").alias("n_tokens")), "cells")
    discard(table)
    return model, cells


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, DIM)


def _spread(sample: np.ndarray, k: int) -> np.ndarray:
    """Up to k centres: the sample's vector nearest its mean, then each time the one farthest from those picked."""
    picked = [int(((sample - sample.mean(axis=0)) ** 2).sum(axis=1).argmin())]
    far = ((sample - sample[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k and far.max() > 1e-6:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
    return sample[picked].astype(np.float32)
