"""Parquet files held against a governed schema by their footers, which one job reads in parallel; no data page is touched."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOOTER = "file string, bytes long, footer_bytes long, rows long, groups array<long>, columns array<string>, nulls array<long>, problem string"
_FIELDS = ["file", "bytes", "footer_bytes", "rows", "groups", "columns", "nulls", "problem"]
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.string()]
#: Footers that one task reads.
FILES_A_TASK = 200
_PHYSICAL = {"INT32": "int32", "INT64": "int64", "DOUBLE": "double", "FLOAT": "float", "BOOLEAN": "boolean", "BYTE_ARRAY": "binary", "FIXED_LEN_BYTE_ARRAY": "fixed", "INT96": "int96"}
_SPARK = {T.LongType: "int64", T.IntegerType: "int32", T.ShortType: "int16", T.ByteType: "int8", T.DoubleType: "double", T.FloatType: "float", T.BooleanType: "boolean", T.StringType: "string", T.BinaryType: "binary", T.DateType: "date", T.TimestampType: "timestamp utc", T.TimestampNTZType: "timestamp"}


@dataclass(frozen=True)
class Limits:
    """Bounds of a delivery; a footer beyond one is a problem of its file, more rows one of the delivery."""

    file_bytes: int = 512 << 20
    footer_bytes: int = 16 << 20
    columns: int = 2000
    row_groups: int = 10_000
    rows: int = 1_000_000_000_000


def governed(schema: T.StructType) -> list[str]:
    """A schema as texts ``name type repetition``, as footers give them; nullable columns are optional. Nested columns are refused."""
    out = []
    for f in schema.fields:
        kind = f"decimal({f.dataType.precision},{f.dataType.scale})" if isinstance(f.dataType, T.DecimalType) else _SPARK.get(type(f.dataType))
        if kind is None:
            raise ValueError(f"{f.name}: {f.dataType.simpleString()} can't be governed")
        out.append(f"{f.name} {kind} {'optional' if f.nullable else 'required'}")
    return out


def _column(c) -> str:
    logical = json.loads(c.logical_type.to_json())
    kind = logical.get("Type", "None")
    if c.path != c.name or c.max_repetition_level:
        return f"{c.path} nested"
    if kind == "Decimal":
        # The narrow physical types hold so many digits.
        most = {"INT32": 9, "INT64": 18}.get(c.physical_type, 38)
        name = f"decimal({logical['precision']},{logical['scale']})" + ("" if logical["precision"] <= most else " too wide")
    elif kind == "Timestamp":
        name = "timestamp utc" if logical["isAdjustedToUTC"] else "timestamp"
    elif kind == "Int":
        name = f"{'' if logical['isSigned'] else 'u'}int{logical['bitWidth']}"
    elif kind in ("String", "Date"):
        name = kind.lower()
    else:
        name = _PHYSICAL.get(c.physical_type, c.physical_type) if kind == "None" else kind.lower()
    return f"{c.name} {name} {'optional' if c.max_definition_level else 'required'}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import pyarrow.fs
    import pyarrow.parquet as pq

    for batch in batches:
        found = []
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            scheme, _, rest = path.partition(":")
            try:
                store, at = (pa.fs.LocalFileSystem(), f"/{rest.lstrip('/')}") if scheme == "file" else pa.fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    meta = pq.ParquetFile(f).metadata
                columns = [meta.schema.column(i) for i in range(meta.num_columns)]
                groups = [meta.row_group(i) for i in range(meta.num_row_groups)]
                stats = [[g.column(i).statistics for g in groups] for i in range(len(columns))]
                nulls = [sum(s.null_count for s in held) if all(s is not None and s.has_null_count for s in held) else None for held in stats]
                found.append((path, size, meta.serialized_size, meta.num_rows, [g.num_rows for g in groups], [_column(c) for c in columns], nulls, None))
            except pa.ArrowInvalid as e:
                found.append((path, size, None, None, None, None, None, f"not Parquet: {str(e).splitlines()[0][:100]}"))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), _TYPES, strict=True)], names=_FIELDS)


def footers(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: bytes, rows, rows of each row group, columns as texts, and their nulls where the statistics say. Needs a store
    that ``pyarrow.fs`` knows (file, S3, GCS, HDFS) on the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.repartition(max(1, -(-files.count() // FILES_A_TASK))).mapInArrow(_read, FOOTER)


def problems(found: DataFrame, expected: T.StructType | None, limits: Limits = Limits(), declared_rows: int | None = None) -> DataFrame:  # noqa: B008
    """(file, problem), must be empty: columns missing, unexpected or out of order against the governed ones (name, type, precision,
    zone and nullability), sizes, row groups that don't add up; and of the delivery (null file): no file, too many rows, or others
    than declared. A required column can't hold a null, so nullability is the files' own promise. Without governed columns, those of
    the first file by name are what all must have."""
    want = F.array(*[F.lit(c) for c in governed(expected)]) if expected is not None else F.col("want")
    have = F.col("columns")
    apart = F.concat(F.transform(F.array_except(want, have), lambda c: F.concat(F.lit("missing "), c)), F.transform(F.array_except(have, want), lambda c: F.concat(F.lit("unexpected "), c)))
    twice = F.size(F.array_distinct(F.transform(have, lambda c: F.lower(F.split_part(c, F.lit(" "), F.lit(1)))))) < F.size(have)
    total = F.aggregate("groups", F.lit(0).cast("long"), lambda s, g: s + g)
    one = F.concat(
        F.coalesce(F.array_compact(F.array("problem")), F.array().cast("array<string>")),
        F.coalesce(apart, F.array().cast("array<string>")),
        F.array_compact(
            F.array(
                F.when((F.size(apart) == 0) & (have != want), "columns are in another order"),
                F.when(twice, "one name for two columns"),
                F.when(F.size("columns") > limits.columns, "too many columns"),
                F.when(F.size("groups") < 1, "no row group"),
                F.when(F.size("groups") > limits.row_groups, "too many row groups"),
                F.when(total != F.col("rows"), "row groups don't add up"),
                F.when(F.col("footer_bytes") > limits.footer_bytes, "footer is too large"),
                F.when(F.col("bytes") > limits.file_bytes, "file is too large"),
            )
        ),
    )
    rows = found if expected is not None else found.crossJoin(F.broadcast(found.agg(F.min_by("columns", "file").alias("want"))))
    each = rows.select("file", F.explode(one).alias("problem"))
    sums = found.agg(F.count("*").alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
    text = F.concat(F.lit(f"{declared_rows} rows declared, "), F.col("rows").cast("string"), F.lit(" found"))
    whole = F.array_compact(F.array(F.when(F.col("n") == 0, "no file"), F.when(F.col("rows") > limits.rows, "too many rows"), F.when(F.lit(declared_rows is not None) & (F.col("rows") != F.lit(declared_rows or 0)), text)))
    return each.union(sums.select(F.lit(None).cast("string").alias("file"), F.explode(whole).alias("problem")))
