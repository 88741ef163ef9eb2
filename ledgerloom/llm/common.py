"""Shared plumbing of the training-data operators: Arrow batches in, Arrow batches out."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of one output batch are closed at about this many bytes, so that long texts never pile up.
OUT_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can see (``spark.checkpoint.dir``); set under the warehouse only where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext.getCheckpointDir()
        path = held or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return path.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str) -> DataFrame:
    """Cut lineage: write to the shared folder once and read the table back, so that a lost executor costs one task, not the plan."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns whose names (in any case) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shielded(docs: DataFrame, used: list[str], new: list[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` on the table with the columns that it uses under the names that it asks for, in any case, and all others under
    numbers, so that none meets a name of its own; then all have their names again. Columns named as new ones are replaced."""
    kept, asked = without(docs, new), {u.lower(): u for u in used}
    inner = [asked.get(c.lower(), f"_{i}") for i, c in enumerate(kept.columns)]
    out = run(kept.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(kept.columns, inner, strict=True)]))
    back = dict(zip(inner, kept.columns, strict=True))
    return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns])


def append_columns(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """Row-preserving Arrow map: ``fn`` gives the new columns of a batch; columns of the same name are replaced."""
    kept = without(df, [f.name for f in fields])
    names = kept.columns + [f.name for f in fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                new = fn(piece)
                arrays = [*piece.columns, *(_typed(new[f.name], k) for f, k in zip(fields, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *fields]))


def _typed(values: object, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array | pa.ChunkedArray):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def pieces(batch: pa.RecordBatch, most: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``most`` bytes (one row at least): bounds what a task holds, whatever the length of texts."""
    if not batch.num_rows or batch.nbytes <= most:
        if batch.num_rows:
            yield batch
        return
    if batch.num_rows == 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), most)
    yield from pieces(batch.slice(half), most)


def no_text(col: Column) -> Column:
    """Null counts as empty text."""
    return F.coalesce(col, F.lit(""))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sized_rows(rows: Iterator[tuple], schema: pa.Schema, cost: Callable[[tuple], int], most: int = OUT_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches of row tuples, closed by size."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += 64 + cost(row)
        if size >= most:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more; anything outside the shared folder is left alone."""
    for t in tables:
        spark = t.sparkSession
        files = t.inputFiles()
        if files and f"/{shared_dir(spark).rpartition(':')[2].strip('/')}/" in files[0]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def pack(table: np.ndarray) -> bytes:
    """A table of counters as one compressed value."""
    return zlib.compress(table.tobytes(), 1)


#: Tables of a fixed size are summed and sent in so many slices.
SLICES = 64


def sliced(table: np.ndarray) -> pa.RecordBatch:
    """The slices of a task's table that aren't all zero, as rows (part int, table binary)."""
    parts = [(i, pack(x)) for i, x in enumerate(np.array_split(table, SLICES)) if x.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["part", "table"])


def summed(tables: DataFrame, kind: type, size: int, wide: type | None = None, last: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> np.ndarray:
    """Sum of ``sliced`` tables of ``size`` values, as type ``wide``, then ``last`` on each slice. Slices meet by a shuffle; a
    task holds one sum for each of its slices, whatever the number of tables. No table at all gives zeros."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = np.frombuffer(zlib.decompress(packed.as_buffer()), kind)
                held[part] = one.astype(wide or kind) if part not in held else np.add(held[part], one, out=held[part])
        for part, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pack(last(total))], pa.binary())], names=["part", "table"])

    found = {part: zlib.decompress(packed) for part, packed in tables.repartition("part").mapInArrow(add, "part int, table binary").collect()}
    whole = [last(x.astype(wide or kind)) for x in np.array_split(np.zeros(size, kind), SLICES)]
    return np.concatenate([np.frombuffer(found[i], x.dtype) if i in found else x for i, x in enumerate(whole)])


#: A bitmap has 16 bits a value, but never more than 2**29 (64 MB).
MOST_BITS = 29


def _slot(values: np.ndarray, bits: int) -> np.ndarray:
    x = values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)


class Bitmap:
    """Which of many 64-bit values may be in a set: never misses one, and lets more others through as it fills.

    Only for dropping rows early that a join would drop anyway, so results never depend on it; its size is bounded. Each
    slice of it is marked in one task, so no task holds the whole but those that ask.
    """

    def __init__(self, values: DataFrame, count: int):
        bits = min(MOST_BITS, max(16, (16 * count).bit_length()))
        each = bits - (SLICES.bit_length() - 1)

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = _slot(batch.column(0).to_numpy(zero_copy_only=False), bits).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> each).astype(np.int32)), pa.array((at & ((1 << each) - 1)).astype(np.int32))], names=["part", "at"])

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, np.ndarray] = {}
            for batch in batches:
                part, at = (batch.column(i).to_numpy() for i in (0, 1))
                for x in np.unique(part).tolist():
                    held.setdefault(x, np.zeros(1 << each, bool))[at[part == x]] = True
            for x, table in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()), pa.array([pack(np.packbits(table, bitorder="little"))], pa.binary())], names=["part", "table"])

        self.bits = bits
        table = np.zeros(1 << bits - 3, np.uint8)
        size = len(table) // SLICES
        for part, packed in values.mapInArrow(places, "part int, at int").repartition("part").mapInArrow(mark, "part int, table binary").collect():
            table[part * size : (part + 1) * size] = np.frombuffer(zlib.decompress(packed), np.uint8)
        #: Share of other values that get through.
        self.leak = float(np.unpackbits(table[: 1 << 20]).mean())
        self.table = values.sparkSession.sparkContext.broadcast(table)

    def may_have(self, values: np.ndarray) -> np.ndarray:
        at = _slot(values, self.bits)
        return self.table.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0

    def drop(self) -> None:
        """Executors may forget it; a task that runs again fetches it again."""
        self.table.unpersist()
