"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of every run of ``reach`` neighbouring ``gram``-word shingles the smallest value is kept, so any
passage of ``gram + reach - 1`` words (the threshold) that two documents share holds the same anchor at the same place.
Occurrences of one anchor in different documents are joined and extended both ways, in two steps. First by the whole
surroundings that a window over the anchor can reach: where they are the same as in a smaller document, the match extends
over all windows at the anchor. Only where one anchor has several surroundings, so where matches begin or end, each of its
windows of threshold length is compared, once for each different surroundings and not for each document. A window that a
smaller document also has is a repeat; neighbouring repeats merge into maximal ones.

Surroundings and windows are compared by 128 bits each. Bitmaps of bounded size keep unshared anchors and surroundings out of
the shuffles; they never decide a result. Every aggregate combines before it shuffles and every join is an equi-join that
adaptive execution can split, so a passage in a third of all documents stays spread out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import append_columns, discard, no_text, pieces, settle, shielded, Bitmap

U = np.uint64
LAST = (1 << 63) - 1
OUT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("kept_text", T.StringType()),
    T.StructField("repeats", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
]
#: Stands for the words before the first and after the last one of a text; and the bases of the second halves of 128 bits.
EDGE, OTHER = U(0x5851F42D4C957F2D), 0xDA942042E4DD58B5


def winnow(value: np.ndarray, at: np.ndarray, gram: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows that start at ``at``: position and value of the anchor that each chooses (the last of equals)."""
    g = K.windows(value, gram)
    best, off = g[at].copy(), np.zeros(len(at), np.int64)
    for j in range(1, reach):
        other = g[at + j]
        less = other <= best
        best[less] = other[less]
        off[less] = j
    return at + off, best


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(value: np.ndarray, at: np.ndarray, k: int, base: int) -> np.ndarray:
    """One value for each run of k words that starts at ``at``."""
    out = value[at].copy()
    for j in range(1, k):
        out = out * U(base) + value[at + j]
    return K.mix(out + U(k))


class Seeds:
    """Anchors of a chunk of texts: start and anchor of each window, and row, place and value of each anchor."""

    def __init__(self, w: K.Words, min_words: int, gram: int):
        self.reach = min_words - gram + 1
        self.start, row = K.starts(w.ptr, min_words)
        place, value = winnow(w.value, self.start, gram, self.reach) if len(self.start) else (self.start, np.zeros(0, U))
        new = np.append(True, place[1:] != place[:-1])[: len(place)]
        self.anchor_of = np.cumsum(new) - 1
        self.off = place - self.start
        self.row, self.place, self.value = row[new], place[new], value[new]
        self.words, self.gram = w, gram

    def around(self, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of the surroundings of some anchors: all words that a window over the anchor can hold."""
        w, pad = self.words, self.reach - 1
        n = np.diff(w.ptr)
        padded = np.full(len(w.value) + 2 * pad * len(n), EDGE)
        padded[np.arange(len(w.value)) + pad * (2 * np.repeat(np.arange(len(n)), n) + 1)] = w.value
        at = self.place[use] + 2 * pad * self.row[use]
        return _runs(padded, at, self.gram + 2 * pad, K.SECOND), _runs(padded, at, self.gram + 2 * pad, OTHER)


def _owned(around: np.ndarray, ord_: np.ndarray) -> np.ndarray:
    """One value of surroundings and document."""
    return K.mix(around ^ K.mix(ord_.view(U) + U(K.BASE)))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, gram: int = 5) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_removed, kept_text (kept words, one space between) and repeats
    (maximal word ranges [start, end) removed).

    A word goes if a window of ``min_words`` words over it also starts in a document with a smaller id; the first
    document keeps its words, and repeats inside one document stay. Null text has no words; a null id counts as larger
    than any other, and null ids are equal to each other, as are repeated ids: neither takes words from the other.
    Texts of fewer than ``min_words`` words lose nothing. Columns of any name may be there; those of the names of new ones are
    replaced.
    """
    return shielded(docs, [id_col, text_col], [f.name for f in OUT], lambda d: _remove_repeats(d, id_col, text_col, min_words, gram))


def _remove_repeats(docs: DataFrame, id_col: str, text_col: str, min_words: int, gram: int) -> DataFrame:
    if not 1 <= min_words - gram + 1 <= 62:
        raise ValueError("min_words must be at least gram, and at most 61 more")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("ord"), no_text(F.col(text_col)).alias("text"))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Seeds, pa.RecordBatch]]:
        for batch in batches:
            for part in pieces(batch):
                for w in K.words(part.column("text"), K.BLANK_WORDS):
                    s = Seeds(w, min_words, gram)
                    if len(s.start):
                        yield s, part.slice(w.lo, w.hi - w.lo)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, _ in chunks(batches):
            yield pa.RecordBatch.from_arrays([_signed(s.value)], names=["anchor"])

    shared = settle(rows.select("text").mapInArrow(anchors, "anchor long").groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    known = Bitmap(shared, shared.count())
    discard(shared)

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, part in chunks(batches):
            use = np.flatnonzero(known.may_have(s.value))
            a, b = s.around(use)
            ord_ = part.column("ord").to_numpy()[s.row[use]]
            yield pa.RecordBatch.from_arrays([_signed(s.value[use]), _signed(a), _signed(b), pa.array(ord_)], names=["anchor", "a", "b", "ord"])

    joined = rows.mapInArrow(seeds, "anchor long, a long, b long, ord long").groupBy("anchor", "a", "b").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi"))
    places = settle(joined, "surroundings")
    several = places.groupBy("anchor").agg(F.min("a").alias("a0"), F.max("a").alias("a1")).where("a0 < a1").select("anchor")
    ends = settle(places.join(several, "anchor", "left_semi").select("a", "lo"), "ends")

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_signed(_owned(batch.column("a").to_numpy().view(U), batch.column("lo").to_numpy()))], names=["own"])

    first = Bitmap(ends.mapInArrow(owned, "own long"), ends.count())
    discard(ends)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows at anchors with several surroundings, from the first document of each surroundings."""
        for s, part in chunks(batches):
            use = np.flatnonzero(known.may_have(s.value))
            a, b = s.around(use)
            ord_ = part.column("ord").to_numpy()[s.row[use]]
            mine = first.may_have(_owned(a, ord_))
            at = np.full(len(s.value), -1)
            at[use[mine]] = np.flatnonzero(mine)
            which = at[s.anchor_of]
            win = np.flatnonzero(which >= 0)
            which = which[win]
            w = s.words.value
            yield pa.RecordBatch.from_arrays(
                [_signed(a[which]), _signed(b[which]), pa.array(ord_[which]), pa.array(s.off[win].astype(np.int32)), _signed(_runs(w, s.start[win], min_words, K.SECOND)), _signed(_runs(w, s.start[win], min_words, OTHER))],
                names=["a", "b", "ord", "off", "x", "y"],
            )

    windows = settle(rows.mapInArrow(extend, "a long, b long, ord long, off int, x long, y long").distinct(), "windows")
    earliest = windows.groupBy("x", "y").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("x", "y", F.col("lo").alias("least"))
    again = windows.join(earliest, ["x", "y"]).where("ord > least").groupBy("a", "b", F.col("ord").alias("lo")).agg(F.bit_or(F.expr("shiftleft(1L, off)")).alias("own"))
    marks = settle(places.select("a", "b", "lo", "hi").join(again, ["a", "b", "lo"], "left").where("lo < hi or own is not null").select("a", "b", "lo", F.coalesce("own", F.lit(0).cast("long")).alias("own")), "marks")
    discard(places, windows)
    known.drop()
    first.drop()
    wanted = marks.select("a")
    repeated = Bitmap(wanted, wanted.count())

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, part in chunks(batches):
            a, b = s.around(np.arange(len(s.value)))
            use = np.flatnonzero(repeated.may_have(a))
            at = pa.array(s.row[use])
            yield pa.RecordBatch.from_arrays([_signed(a[use]), _signed(b[use]), part.column("ord").take(at), part.column("mark").take(at)], names=["a", "b", "ord", "mark"])

    # Rows with one id, null say, are told apart by their texts: no id is a hot key.
    found = rows.withColumn("mark", F.xxhash64("text")).mapInArrow(occurrences, "a long, b long, ord long, mark long").join(marks, ["a", "b"])
    found = found.withColumn("own", F.when(F.col("ord") > F.col("lo"), F.lit(-1).cast("long")).when(F.col("ord") == F.col("lo"), F.col("own"))).where("own <> 0")
    later = found.groupBy("ord", "mark").agg(F.collect_set(F.struct("a", "own")).alias("__later"))

    base = docs.withColumn("__ord", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))).withColumn("__mark", F.xxhash64(no_text(F.col(text_col))))
    whole = base.join(later.withColumnsRenamed({"ord": "__ord", "mark": "__mark"}), ["__ord", "__mark"], "left")

    def cut(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        listed = batch.column("__later")
        sizes = np.array([x or 0 for x in pa.compute.list_value_length(listed).to_pylist()], np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        flat = listed.flatten()
        have = _owned(flat.field("a").to_numpy(zero_copy_only=False).view(U), owner)
        order = np.argsort(have)
        have, own = have[order], flat.field("own").to_numpy(zero_copy_only=False)[order]
        n_words, n_removed, texts, spans = [], [], [], []
        for w in K.words(batch.column(text_col), K.BLANK_WORDS):
            s = Seeds(w, min_words, gram)
            gone = np.zeros(len(w.value) + 1, np.int64)
            if len(s.start) and len(have):
                ask = _owned(s.around(np.arange(len(s.value)))[0], s.row + w.lo)
                at = np.minimum(np.searchsorted(have, ask), len(have) - 1)
                bits = np.where(have[at] == ask, own[at], 0)
                hit = s.start[bits[s.anchor_of] >> s.off & 1 > 0]
                np.add.at(gone, hit, 1)
                np.subtract.at(gone, hit + min_words, 1)
            gone = np.cumsum(gone)[:-1] > 0
            for r in range(w.hi - w.lo):
                a, b = int(w.ptr[r]), int(w.ptr[r + 1])
                mine = gone[a:b]
                n_words.append(b - a)
                n_removed.append(int(mine.sum()))
                texts.append(b" ".join(w.text(a + int(i)) for i in np.flatnonzero(~mine)).decode())
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)])
        return {"n_words": n_words, "n_removed": n_removed, "kept_text": texts, "repeats": spans}

    return append_columns(whole, cut, OUT).drop("__ord", "__mark", "__later")
