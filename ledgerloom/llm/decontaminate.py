"""Benchmark decontamination as a prefix-filtered containment join.

An item's windows (``size`` consecutive words, or the whole item if it is shorter) are sets of word shingles. Containment
needs *every* shingle of a window, so under an order by rarity its necessary prefix is the rarest shingle alone: only texts
with that shingle are candidates for the window. Texts are joined with windows on that one shingle. Its place in the window
fixes where the window would have to start (positional bound) and the text must have room for it (length bound); what is
left is verified word by word.

Rarity is counted over all documents; windows whose rarest shingle no document has are gone before the join. Items, windows,
counts and candidates are tables: nothing of them is gathered on the driver or sent to all executors but bitmaps of bounded
size, which only keep places out of the shuffles that a join would drop anyway. Equal texts are looked at as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import textkernel as K
from .common import Bitmap, append_columns, discard, no_text, pieces, settle, shielded, sized_rows

U = np.uint64
OUT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
]
WINDOW = pa.schema([("passage", pa.string()), ("n", pa.int32()), ("id", pa.string())])
SHINGLE = pa.schema([("passage", pa.string()), ("n", pa.int32()), ("gram", pa.int64()), ("place", pa.int32())])
PLACE = pa.schema([("mark", pa.string()), ("gram", pa.int64()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.string())])
_DDL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """Distinct (passage, n, id): the windows of items(id, text), their words joined by one space."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                ids = batch.column("id").to_pylist()
                for w in K.words(batch.column("text"), K.LETTER_WORDS):
                    for r in range(w.hi - w.lo):
                        own = w.texts(int(w.ptr[r]), int(w.ptr[r + 1]))
                        n = min(size, len(own))
                        for i in range(len(own) - n + 1 if n else 0):
                            yield b" ".join(own[i : i + n]).decode(), n, ids[w.lo + r]

        yield from sized_rows(rows(), WINDOW, lambda r: len(r[0]))

    return items.mapInArrow(cut, _ddl(WINDOW)).distinct()


def shingles_of(windows: DataFrame, gram: int) -> DataFrame:
    """(passage, n, gram, place): every shingle of every window; a window of fewer words than ``gram`` is one shingle."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                for w in K.words(part.column("passage"), K.LETTER_WORDS):
                    n = np.diff(w.ptr)
                    for k in np.unique(np.minimum(n, gram)).tolist():
                        at, row = K.starts(w.ptr, k)
                        use = np.minimum(n[row], gram) == k
                        at, row = at[use], row[use]
                        from_row = pa.array(w.lo + row)
                        yield pa.RecordBatch.from_arrays([part.column("passage").take(from_row), part.column("n").take(from_row), pa.array(K.windows(w.value, k)[at].view(np.int64)), pa.array((at - w.ptr[row]).astype(np.int32))], schema=SHINGLE)

    return windows.mapInArrow(cut, _ddl(SHINGLE))


def rarities(texts: DataFrame, known: DataFrame, lengths: list[int], mask: Bitmap) -> DataFrame:
    """(gram, count) of the known shingles over all texts, combined in each task before the shuffle; ``mask`` may have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            u, inv = np.unique(np.concatenate(held), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(np.bincount(inv, np.concatenate(sizes), len(u)).astype(np.int64))], names=["gram", "n"])

        for batch in batches:
            for w in K.words(batch.column("text"), K.LETTER_WORDS):
                for k in lengths:
                    at, _ = K.starts(w.ptr, k)
                    value = K.windows(w.value, k)[at]
                    u, n = np.unique(value[mask.may_have(value)], return_counts=True)
                    held.append(u)
                    sizes.append(n)
            if sum(map(len, held)) > 1 << 20:
                yield flush()
                held, sizes = [], []
        if held:
            yield flush()

    return texts.mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("count")).join(known, "gram", "left_semi")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, gram: int = 3) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, hits (word ranges [start, end) inside occurring windows, merged) and
    item_ids (distinct, sorted as strings; of the items with an occurring window).

    Words are runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters. Null or empty texts have no words
    and no hits; null or empty items have no windows; a null item id counts as the text ``null``. Equal windows of several
    items hit all of them; repeated rows are judged alike. An empty table of items hits nothing. Columns of any name may be there;
    those of the names of new ones are replaced.
    """
    return shielded(docs, [text_col], [f.name for f in OUT], lambda d: _decontaminate(d, items, text_col, item_id, item_text, size, gram))


def _decontaminate(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, size: int, gram: int) -> DataFrame:
    listed = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), no_text(F.col(item_text)).alias("text"))
    owners = settle(windows_of(listed, size), "windows")
    shingles = settle(shingles_of(owners.select("passage", "n").distinct(), gram), "shingles")
    lengths = [r[0] for r in owners.select(F.least("n", F.lit(gram))).distinct().collect()]
    texts = docs.select(no_text(F.col(text_col)).alias("text"))
    known = settle(shingles.select("gram").distinct(), "grams")
    common = Bitmap(known, known.count())
    counts = rarities(texts, known, lengths, common)
    # The rarest shingle of each window; ties go to the smaller value, then to the earlier place. One that no text has can't occur.
    least = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "gram", "place"))
    anchors = shingles.join(counts, "gram", "left").groupBy("passage", "n").agg(least.alias("a")).where("a.count > 0")
    anchors = settle(anchors.select("passage", "n", "a.gram", "a.place"), "anchors")
    common.drop()
    wanted = anchors.select("gram").distinct()
    mask = Bitmap(wanted, wanted.count())
    marked = texts.select("text", F.md5(F.col("text").cast("binary")).alias("mark"))
    reach = size - 1

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                marks = batch.column("mark").to_pylist()
                for w in K.words(batch.column("text"), K.LETTER_WORDS):
                    new = np.array([m not in seen for m in marks[w.lo : w.hi]])
                    for k in lengths:
                        at, row = K.starts(w.ptr, k)
                        value = K.windows(w.value, k)[at]
                        use = np.flatnonzero(new[row] & mask.may_have(value)) if len(at) else []
                        for i in use:
                            r, p = int(row[i]), int(at[i])
                            a, b = max(int(w.ptr[r]), p - reach), min(int(w.ptr[r + 1]), p + size)
                            yield marks[w.lo + r], int(value[i].view(np.int64)), p - int(w.ptr[r]), p - a, b" ".join(w.texts(a, b)).decode()
                    seen.update(marks[w.lo : w.hi])

        yield from sized_rows(rows(), PLACE, lambda r: 32 + len(r[4]))

    # Positional and length bounds are in the slice: it has another number of words where the window doesn't fit.
    here = F.array_join(F.slice(F.split("around", " "), F.greatest(F.col("before") - F.col("place") + 1, F.lit(1)), F.col("n")), " ")
    found = marked.mapInArrow(find, _ddl(PLACE)).join(anchors, "gram").where((F.col("before") >= F.col("place")) & (here == F.col("passage")))
    found = settle(found.select("mark", (F.col("at") - F.col("place")).alias("start"), "n", "passage").distinct(), "found")
    mask.drop()
    discard(shingles, known)
    spans = found.groupBy("mark").agg(F.collect_set(F.struct("start", "n")).alias("__spans"))
    named = found.select("mark", "passage").distinct().join(owners.select("passage", "id"), "passage").groupBy("mark").agg(F.collect_set("id").alias("__ids"))
    hit = settle(spans.join(named, "mark").withColumnRenamed("mark", "__mark"), "hits")
    discard(found, anchors, owners)
    # Only rows whose text may have a hit meet the hits; the others stay where they are.
    key = lambda m: F.conv(F.substring(m, 1, 15), 16, 10).cast("long")
    kept = Bitmap(hit.select(key(F.col("__mark"))), hit.count())
    keyed = docs.withColumn("__mark", F.md5(no_text(F.col(text_col)).cast("binary"))).withColumn("__key", key(F.col("__mark")))

    def may_hit(batch: pa.RecordBatch) -> np.ndarray:
        return kept.may_have(batch.column("__key").to_numpy())

    def counted(batch: pa.RecordBatch) -> list[int]:
        return [int(x) for w in K.words(batch.column(text_col), K.LETTER_WORDS) for x in np.diff(w.ptr)]

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(may_hit(batch)))

    def none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In one step, as each Python step of a task is a process of its own."""
        for batch in batches:
            for part in pieces(batch):
                rest = part.filter(pa.array(~may_hit(part)))
                n = rest.num_rows
                new = [pa.array(counted(rest), pa.int64()), pa.array([[]] * n, to_arrow_type(OUT[1].dataType)), pa.array([[]] * n, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*rest.columns, *new], names=[*rest.schema.names, *(f.name for f in OUT)])

    def merge(batch: pa.RecordBatch) -> dict[str, list]:
        return {"n_words": counted(batch), "hits": [_merged(x) for x in batch.column("__spans").to_pylist()], "item_ids": [sorted(x or []) for x in batch.column("__ids").to_pylist()]}

    # A merge join at every size, so that small and large tables run one plan.
    met = append_columns(keyed.mapInArrow(some, keyed.schema).join(hit.hint("merge"), "__mark", "left"), merge, OUT).drop("__mark", "__key", "__spans", "__ids")
    return keyed.mapInArrow(none, T.StructType([*keyed.schema.fields, *OUT])).drop("__mark", "__key").unionByName(met)


def _merged(spans: list[dict] | None) -> list[dict]:
    """Maximal word ranges that the windows cover; ranges that touch become one."""
    if not spans:
        return []
    both = np.array(sorted((s["start"], s["start"] + s["n"]) for s in spans))
    end = np.maximum.accumulate(both[:, 1])
    first = np.flatnonzero(np.append(True, both[1:, 0] > end[:-1]))
    return [{"start": int(both[i, 0]), "end": int(end[j - 1])} for i, j in zip(first, [*first[1:], len(both)], strict=True)]
