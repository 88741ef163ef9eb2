"""Records of large text files whose ends depend on quotes, read by many tasks a file.

A file is read in byte ranges, cut at a separator that ends most records: a line feed for CSV, ``}`` for arrays of flat JSON
objects. A separator counts only outside quotes, and whether a range begins inside depends on all before it. The state of a
range is the parity of its quotes, a monoid: a first scan sums it by range, prefix sums over the few ranges of a file give each
its state at the start, and in a second scan each task cuts its own records. What a range has of a record that begins or ends in
another one, at most two pieces a range, is put together by file.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import settled

_RECORD = "file string, block long, place long, record string"
_CELL = r'(?:"(?:[^"]++|"")*+"|[^",\r\n]*+)'
_ROW = re.compile(rf"{_CELL}(?:,{_CELL})*+")
#: A carriage return outside quotes also ends a row, as one with the line feed after it.
_PART = re.compile(r'(?:[^"\r]++|"(?:[^"]++|"")*+")*+')


def _quotes(lines: Column, escapes: bool) -> Column:
    bare = F.regexp_replace(lines, r"(?s)\\.", "") if escapes else lines
    return F.length(bare) - F.length(F.replace(bare, F.lit('"')))


def _ranges(spark: SparkSession, path: str, sep: str) -> DataFrame:
    return spark.read.option("lineSep", sep).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))


def starts(spark: SparkSession, path: str, sep: str, escapes: bool, closing: str | None = None) -> DataFrame:
    """(file, block, inside): whether each range begins inside quotes; one row a range. A file without the ``closing`` ends the run."""
    rows = _ranges(spark, path, sep)
    each = rows.groupBy("file", "block").agg((F.sum(_quotes(F.col("line"), escapes)) % 2).alias("odd"), F.max(F.trim(F.translate("line", "\r\n\t", "   ")).endswith(closing) if closing else F.lit(True)).alias("closed"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    bad = (F.sum("odd").over(whole) % 2 == 1) | ~F.max("closed").over(whole)
    inside = F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)) == 1
    return each.select("file", "block", F.when(bad, F.raise_error(F.lit("a quote or the document is not closed")).cast("boolean")).otherwise(inside).alias("inside"))


def _walk(batches: Iterator[pa.RecordBatch], sep: str, escapes: bool) -> Iterator[tuple[str, int, str, int, str]]:
    """(file, block, kind, place, text): whole records; ``head``: up to the first end in a range that begins inside (``through``, if there
    is none); ``tail``: after the last end. place is the first line's number in its range."""
    key, state, heading, held, place, at = None, 0, False, [], 0, 0

    def rest() -> Iterator[tuple[str, int, str, int, str]]:
        if key and held:
            yield *key, "through" if heading else "tail", place, sep.join(held)

    for batch in batches:
        files, blocks = batch.column("file"), batch.column("block").to_numpy()
        lines, inside = batch.column("line"), batch.column("inside")
        bare = pc.replace_substring_regex(lines, pattern=r"(?s)\\.", replacement="") if escapes else lines
        odd = pc.count_substring(bare, '"').to_numpy() & 1
        texts, names = lines.to_pylist(), files.to_pylist()
        lo = 0
        while lo < len(texts):
            now = (names[lo], int(blocks[lo]))
            hi = lo + 1
            while hi < len(texts) and blocks[hi] == now[1] and names[hi] == now[0]:
                hi += 1
            if now != key:
                yield from rest()
                key, held, place, at = now, [], 0, 0
                heading = inside[lo].as_py()
                state = int(heading)
            after = (state + np.cumsum(odd[lo:hi])) & 1
            begin = 0
            for end in np.nonzero(after == 0)[0].tolist():
                if held or end > begin:
                    held += texts[lo + begin : lo + end + 1]
                    yield *key, "head" if heading else "whole", place, sep.join(held)
                    held = []
                else:
                    yield *key, "head" if heading else "whole", place, texts[lo + end]
                heading, begin = False, end + 1
                place = at + begin
            held += texts[lo + begin : hi]
            state, at, lo = int(after[-1]), at + hi - lo, hi
    yield from rest()


def _rows(found: Iterator[tuple], names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in found:
        held.append(row)
        size += 64 + len(row[-1])
        if size > 1 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


_NAMES, _KINDS = ["file", "block", "place", "record"], [pa.string(), pa.int64(), pa.int64(), pa.string()]


class Shape(NamedTuple):
    """What a task makes of its records (file, block, place, record) in the Python worker that cut them: rows, and their columns."""

    each: Callable[[Iterator[tuple]], Iterator[tuple]]
    names: list[str]
    kinds: list[pa.DataType]
    ddl: str


_AS_CUT = Shape(lambda found: found, _NAMES, _KINDS, _RECORD)


def records(spark: SparkSession, path: str, sep: str, escapes: bool, closing: str | None = None, shape: Shape = _AS_CUT) -> DataFrame:
    """(file, block, place, record), or what ``shape`` makes of it: records without their separator; the first of a file has block and
    place 0. Two scans by all tasks; the table of ranges (some hundred bytes for each 128 MB) is sent to all."""
    begin = settled(starts(spark, path, sep, escapes, closing), "ranges")
    rows = _ranges(spark, path, sep).join(F.broadcast(begin), ["file", "block"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(shape.each((f, b, p, t) for f, b, k, p, t in _walk(batches, sep, escapes) if k == "whole"), shape.names, shape.kinds)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(((f, b, p, k, t) for f, b, k, p, t in _walk(batches, sep, escapes) if k != "whole"), ["file", "block", "place", "kind", "record"], [*_KINDS[:3], pa.string(), pa.string()])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            begun, held = None, []
            for batch in batches:
                for f, b, p, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == "tail":
                        begun, held = (f, b, p), [text]
                    else:
                        held.append(text)
                        if kind == "head":
                            yield *begun, sep.join(held)

        yield from _rows(shape.each(each()), shape.names, shape.kinds)

    pieces = rows.mapInArrow(ends, "file string, block long, place long, kind string, record string")
    # Ranges without an end lie between a tail and a head; a range's head comes before its tail.
    order = F.when(F.col("kind") == "tail", 1).otherwise(0)
    across = pieces.repartition("file").sortWithinPartitions("file", "block", order).mapInArrow(stitch, shape.ddl)
    return rows.mapInArrow(whole, shape.ddl).union(across)


def csv_records(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row a CSV record, as text, without the header, which must be ``columns`` in every file. A quote that doesn't begin and end a
    cell, or an empty line, ends the run."""
    header = ",".join('"' + c.replace('"', '""') + '"' for c in columns)
    names = {header, ",".join(columns)}

    def check(found: Iterator[tuple]) -> Iterator[tuple]:
        for _, block, place, record in found:
            record = record[:-1] if record.endswith("\r") else record
            first = block == 0 and place == 0
            for row in _split(record) if "\r" in record else (record,):
                if not row and len(columns) > 1:
                    raise ValueError("an empty line")
                if '"' in row and not _ROW.fullmatch(row):
                    raise ValueError("a quote must begin and end a cell")
                if first:
                    if row.removeprefix("﻿") not in names:
                        raise ValueError("header differs")
                    first = False
                else:
                    yield (row,)

    return records(spark, path, "\n", False, shape=Shape(check, ["record"], [pa.string()], "record string"))


def _split(record: str) -> Iterator[str]:
    at = 0
    while True:
        m = _PART.match(record, at)
        yield m.group()
        if m.end() >= len(record):
            return
        if record[m.end()] != "\r":
            raise ValueError("a quote must begin and end a cell")
        at = m.end() + (2 if record[m.end() : m.end() + 2] == "\r\n" else 1)
        if at >= len(record):
            return


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """One row (value) a flat object of files that each hold one array; anything else between the objects ends the run."""
    found = records(spark, path, "}", True, "]")
    text = F.trim(F.regexp_replace("record", r"(?s)^[\s﻿]+|\s+$", ""))
    first = (F.col("block") == 0) & (F.col("place") == 0)
    bare = F.when(text.startswith(F.when(first, F.lit("[")).otherwise(F.lit(","))), F.trim(F.regexp_replace(F.substr(text, F.lit(2)), r"(?s)^\s+", "")))
    bad = F.raise_error(F.concat(F.lit("not an object of an array: "), F.substring(text, 1, 40))).cast("string")
    end = F.when(first, text.rlike(r"(?s)^\[\s*\]$")).otherwise(text == "]")
    value = F.when(bare.startswith("{"), F.concat(bare, F.lit("}"))).otherwise(bad)
    return found.select(F.when(end, F.lit(None).cast("string")).otherwise(value).alias("value")).where("value is not null")
