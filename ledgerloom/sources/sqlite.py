"""SQLite files as a data source: ranges of row ids read in parallel, all from one state of each file, with its attestation.

The files lie where driver and executors see them under one path. When a read is planned, each file's change counter is noted;
every task opens the file read-only, holds a read transaction, and ends the run if the counter is another, before or after its
rows. So all ranges, and the attestation, are of one snapshot or there is none.
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

_OPS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
ATTESTED = "file string, counter long, source_rows long, max_row_bytes long, max_cell_bytes long"


def _name(text: str) -> str:
    if not text.replace("_", "").isalnum():
        raise ValueError(f"not a plain name: {text}")
    return f'"{text}"'


def change_counter(path: str) -> int:
    """The counter in the file's header, which each committed transaction raises; a write-ahead log would hide changes from it."""
    if os.path.exists(f"{path}-wal") and os.path.getsize(f"{path}-wal"):
        raise ValueError(f"{path} has a write-ahead log")
    with open(path, "rb") as f:
        head = f.read(28)
    if head[:16] != b"SQLite format 3\0":
        raise ValueError(f"{path} is no SQLite file")
    return int.from_bytes(head[24:28], "big")


@dataclass
class RowRange(InputPartition):
    path: str
    counter: int
    low: int
    high: int


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.schema, self.attests = schema, options.get("attest") == "true"
        self.table, self.parts = _name(options["table"]), int(options.get("parts", "8"))
        self.paths = sorted(options["paths"].split("\n"))
        self.columns = [c for c in options["columns"].split(",") if c]
        self.where, self.values = ["1 = 1"], []
        if "watermark" in options:
            self.where.append(f"{_name(options['watermark'])} <= ?")
            self.values.append(options["upto"])

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = _name(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name and type(f) in _OPS and isinstance(f.value, int | str) and not isinstance(f.value, bool):
                self.where.append(f"{self._cell(f.attribute[0])} {_OPS[type(f)]} ?")
                self.values.append(f.value)
            elif name and isinstance(f, IsNotNull | IsNull):
                self.where.append(f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            else:
                yield f

    def _cell(self, column: str) -> str:
        return f"CAST({_name(column)} AS TEXT)" if not self.attests and isinstance(self.schema[column].dataType, T.StringType) else _name(column)

    def _open(self, path: str) -> sqlite3.Connection:
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True, isolation_level=None)
        con.execute("BEGIN")
        con.execute(f"SELECT 1 FROM {self.table} LIMIT 1").fetchone()  # takes the read lock
        return con

    def partitions(self) -> list[RowRange]:
        out = []
        for path in self.paths:
            counter = change_counter(path)
            con = self._open(path)
            try:
                low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {self.table}").fetchone()
            finally:
                con.close()
            low, high = (0, 0) if low is None else (low, high)
            step = max(1, -(-(high - low + 1) // (1 if self.attests else self.parts)))
            out += [RowRange(path, counter, a, min(high, a + step - 1)) for a in range(low, high + 1, step)]
        return out

    def read(self, part: RowRange) -> Iterator[tuple]:
        con = self._open(part.path)
        try:
            self._same(part)
            where = f"FROM {self.table} WHERE rowid BETWEEN ? AND ? AND {' AND '.join(self.where)}"
            if self.attests:
                sizes = [f"coalesce(length(CAST({_name(c)} AS BLOB)), 0)" for c in self.columns]
                most = f"max({', '.join(sizes)})" if len(sizes) > 1 else sizes[0]
                row = con.execute(f"SELECT count(*), coalesce(max({' + '.join(sizes)}), 0), coalesce(max({most}), 0) {where}", [part.low, part.high, *self.values]).fetchone()
                yield part.path, part.counter, *row
            else:
                yield from con.execute(f"SELECT {', '.join(self._cell(f.name) for f in self.schema.fields)} {where}", [part.low, part.high, *self.values])
            self._same(part)
        finally:
            con.close()

    def _same(self, part: RowRange) -> None:
        if change_counter(part.path) != part.counter:
            raise ValueError(f"{part.path} has changed since the snapshot")


class SqliteSnapshot(DataSource):
    """Options: paths (one a line), table, columns, parts, watermark and upto, attest."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_snapshot"

    def schema(self) -> str:
        if self.options.get("attest") == "true":
            return ATTESTED
        raise ValueError("a schema is required")

    def reader(self, schema: T.StructType) -> SnapshotReader:
        return SnapshotReader(dict(self.options), schema)


def sqlite_snapshot(spark: SparkSession, paths: list[str], table: str, schema: T.StructType, watermark: tuple[str, str] | None = None, parts: int = 8, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, attestation) of the files up to the watermark. The attestation has a row a file: its change counter, rows, bytes of the
    widest row and cell. More than ``most`` rows end the run before any is read. Filters are pushed to the files, for which the
    session's setting is turned on."""
    spark.dataSource.register(SqliteSnapshot)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"paths": "\n".join(paths), "table": table, "columns": ",".join(schema.names), "parts": str(parts)}
    if watermark:
        options |= {"watermark": watermark[0], "upto": watermark[1]}
    attested = spark.read.format("sqlite_snapshot").options(**options, attest="true").load()
    if most is not None and (n := sum(r.source_rows for r in attested.select("source_rows").collect())) > most:
        raise ValueError(f"{n} rows, at most {most} are allowed")
    return spark.read.format("sqlite_snapshot").schema(schema).options(**options).load(), attested
