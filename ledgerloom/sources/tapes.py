"""Readers and writers of delivered tapes. Cells stay text until a mapping types them; checks are lazy DataFrames or one pass."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import INTEGER_TEXT, definition_hash, digest_sums, value_kind
from .footers import Limits, footers, problems
from .ranges import csv_records, json_objects


def _text(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Header required and equal to ``columns``; a row of another width, or an unclosed quote, ends the run. Empty cells are null. A file
    is read by as many tasks as it has ranges, whatever line breaks its cells hold."""
    if len(set(columns)) != len(columns):
        raise ValueError("column names must be unique")
    cells = F.from_csv("record", F.lit(", ".join(f"`{c}` STRING" for c in columns)), {"mode": "FAILFAST", "escape": '"', "maxCharsPerColumn": "-1"})
    return csv_records(spark, path, columns).select(cells.alias("r")).select(*[F.col(f"r.`{c}`").alias(c) for c in columns])


def read_json_array(spark: SparkSession, path: str, columns: list[str], by_line: bool = False) -> DataFrame:
    """Files that hold one array of flat objects, each read by as many tasks as it has ranges; or one array a line. Values must be text,
    whole numbers, booleans or null; a fractional number ends the run, as it would lose digits."""
    if by_line:
        rows = spark.read.text(path).select(F.parse_json("value").alias("v"))
        return _flat(rows.select(F.explode(F.col("v").try_cast("array<variant>")).alias("r")), columns)
    return _flat(json_objects(spark, path).select(F.parse_json("value").alias("r")), columns)


def read_ndjson(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed line ends the run."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("r"))
    return _flat(lines, columns)


def _flat(rows: DataFrame, columns: list[str]) -> DataFrame:
    cells = []
    for c in columns:
        v = F.try_variant_get("r", f"$['{c}']", "variant")
        kind, text = F.schema_of_variant(v), F.try_variant_get("r", f"$['{c}']", "string")
        bad = kind.startswith("DECIMAL") & ~text.rlike(INTEGER_TEXT) | kind.isin("DOUBLE", "FLOAT") | kind.startswith("OBJECT") | kind.startswith("ARRAY")
        cells.append(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"{c}: only text, whole numbers, booleans and null"))).otherwise(text).alias(c))
    return rows.select(*cells)


def ragged_columns(spark: SparkSession, path: str, most: int = 2000) -> DataFrame:
    """The names that any object of an NDJSON file has, in order; more than ``most`` end the run."""
    keys = spark.read.text(path).where(F.trim("value") != "").select(F.explode(F.json_object_keys("value")).alias("column")).distinct()
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    checked = keys.limit(most + 1).withColumn("n", n)
    return checked.select(F.when(F.col("n") > most, F.raise_error(F.lit("too many columns"))).otherwise(F.col("column")).alias("column")).orderBy("column")


def read_parquet(spark: SparkSession, path: str, expected: T.StructType | None = None, declared_rows: int | None = None, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """Every file must have exactly the expected columns: names, order, types, precision, zone and nullability; declared rows must be
    those of the footers. Both are read from all footers by one job before any data; any difference ends the run. Without an
    expectation, all files must have the columns of one."""
    found = problems(footers(spark, path), expected, limits, declared_rows).orderBy("file", "problem").limit(20).collect()
    if found:
        raise ValueError("; ".join(f"{r.file}: {r.problem}" if r.file else r.problem for r in found))
    reader = spark.read.option("mergeSchema", False)
    return (reader if expected is None else reader.schema(expected)).parquet(path)


def partition_mismatch(df: DataFrame, expected: dict[str, str], inside: dict[str, str] | None = None) -> DataFrame:
    """Must be empty: rows whose partition columns are not the expected values; pruned to other partitions by the scan. ``inside`` names,
    per partition column, the column of the file that must agree with it on every row."""
    off: Column = F.lit(False)
    for c, v in expected.items():
        off = off | ~F.col(c).cast("string").eqNullSafe(F.lit(v))
    for c, own in (inside or {}).items():
        off = off | ~F.col(c).cast("string").eqNullSafe(F.col(own).cast("string"))
    return df.where(off)


def worksheet_rows(cells: DataFrame, sheet: str, header_row: int, columns: list[str]) -> DataFrame:
    """Cells (file, sheet, row, col, kind, value) of a visible sheet as a table of text: the header must be exactly ``columns``,
    formulas and blank rows between others end the run, blank rows at the end are dropped."""
    own = cells.where((F.col("sheet") == sheet) & (F.col("row") >= header_row) & (F.col("col") <= len(columns)))
    value = F.when(F.col("kind") == "formula", F.raise_error(F.lit("formulas are not read"))).otherwise(F.nullif(F.trim("value"), F.lit("")))
    wide = own.withColumn("value", value).groupBy("file", "row").pivot("col", list(range(1, len(columns) + 1))).agg(F.max("value"))
    named = wide.select("file", "row", *[F.col(f"`{i + 1}`").alias(c) for i, c in enumerate(columns)])
    blank = F.coalesce(*[F.col(c) for c in columns]).isNull()
    # A spreadsheet has at most 2**20 rows, so one file is one bounded group.
    file = Window.partitionBy("file")
    marked = named.withColumn("__blank", blank).withColumn("__last", F.max(F.when(~blank, F.col("row"))).over(file)).withColumn("__next", F.lead("row").over(file.orderBy("row")))
    header = F.concat_ws("\u001f", *columns) == F.lit("\u001f".join(columns))
    gap = (F.col("row") < F.col("__last")) & (F.col("__blank") | (F.col("__next") != F.col("row") + 1))
    checked = marked.where("row <= __last").withColumn(
        columns[0], F.when((F.col("row") == header_row) & ~header, F.raise_error(F.lit("header differs"))).when(gap, F.raise_error(F.lit("blank row between others"))).otherwise(F.col(columns[0]))
    )
    # The header is kept until its check has run.
    return checked.where((F.col("row") > header_row) | F.col(columns[0]).isNull()).select("file", "row", *columns)


def snapshot_query(table: str, columns: list[str], exact: list[str], watermark: tuple[str, str], order: list[tuple[str, str, str]], most: int) -> str:
    """SQL of a bounded snapshot: listed columns, exact ones as text, up to the watermark, in a total order, one row too many."""
    for name in [table, *columns, watermark[0], *[o[0] for o in order]]:
        if not name.replace("_", "").isalnum():
            raise ValueError(f"not a plain name: {name}")
    cols = ", ".join(f"CAST({c} AS VARCHAR(100)) AS {c}" if c in exact else c for c in columns)
    keys = ", ".join(f"{c} {d.upper()} NULLS {n.upper()}" for c, d, n in order)
    value = watermark[1].replace("'", "''")
    return f"SELECT {cols} FROM {table} WHERE {watermark[0]} <= '{value}' ORDER BY {keys} LIMIT {most + 1}"


def attestation_query(table: str, columns: list[str], watermark: tuple[str, str]) -> str:
    """PostgreSQL text that a snapshot of the same bounds is held against: rows, widest row and widest cell in bytes."""
    for name in [table, *columns, watermark[0]]:
        if not name.replace("_", "").isalnum():
            raise ValueError(f"not a plain name: {name}")
    row = f"ROW({', '.join(columns)})"
    cells = ", ".join(f"COALESCE(octet_length(CAST({c} AS TEXT)), 0)" for c in columns)
    value = watermark[1].replace("'", "''")
    return f"SELECT COUNT(*) AS source_rows, COALESCE(MAX(octet_length(CAST(to_json({row}) AS TEXT))), 0) AS max_row_bytes, COALESCE(MAX(GREATEST({cells})), 0) AS max_cell_bytes FROM {table} WHERE {watermark[0]} <= '{value}'"


def read_jdbc(spark: SparkSession, url: str, query: str, fetch: int = 10_000, split: tuple[str, int, int, int] | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """A snapshot over JDBC in one isolation level; ``split`` (column, low, high, parts) reads in parallel ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({query}) snapshot").option("fetchsize", fetch).option("isolationLevel", "REPEATABLE_READ")
    if split:
        column, low, high, parts = split
        reader = reader.option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.options(**(options or {})).load()


def population_limits(df: DataFrame, allowed: list[str]) -> DataFrame:
    """Rows, largest row and largest cell in bytes, and whether only allowed scalar columns are there: one pass."""
    flat = all(not isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType) for f in df.schema.fields)
    cells = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns]
    widest = F.greatest(*cells) if len(cells) > 1 else cells[0]
    return df.agg(F.count("*").alias("rows"), F.max(F.octet_length(F.to_json(F.struct("*")))).alias("max_row_bytes"), F.max(widest).alias("max_cell_bytes")).withColumn("allowed", F.lit(flat and set(df.columns) <= set(allowed)))


def infer_kinds(df: DataFrame) -> DataFrame:
    """(column, kinds, nullable) of raw text columns in one pass."""
    aggs = []
    for c in df.columns:
        aggs += [F.collect_set(F.when(F.col(c).isNotNull(), value_kind(c))).alias(f"k_{c}"), F.max(F.col(c).isNull()).alias(f"n_{c}")]
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.array_join(F.array_sort(f"k_{c}"), ",").alias("kinds"), F.coalesce(f"n_{c}", F.lit(False)).alias("nullable")) for c in df.columns])
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def content_hash(df: DataFrame) -> DataFrame:
    """Order-free fingerprint of a table: content_hash (rows and digest sums of the rows as JSON arrays of texts), field_hash (names
    and types) and rows. Combines before the shuffle."""
    digest = F.sha2(F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])), 256)
    fields = definition_hash([[f.name, f.dataType.simpleString()] for f in df.schema.fields])
    return df.agg(F.sha2(F.concat_ws(":", F.count("*"), *digest_sums(digest)), 256).alias("content_hash"), F.count("*").alias("rows")).withColumn("field_hash", F.lit(fields))


def write_snapshot(df: DataFrame, path: str, dataset: str, declared_hash: str | None = None, partition: str = "as_of_date") -> DataFrame:
    """Write once, partitioned by date, under a temporary name; gives the manifest row. The hash is taken from what was written,
    and only content that agrees with a declared hash gets its name."""
    spark = df.sparkSession
    held = f"{path}.{uuid.uuid4().hex}"
    df.write.partitionBy(partition).parquet(held)
    stamp = content_hash(spark.read.schema(df.schema).parquet(held).select(*df.columns)).first()
    here, there = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (held, path))
    store = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if declared_hash is not None and stamp["content_hash"] != declared_hash:
        store.delete(here, True)
        raise ValueError("content differs from its declared hash")
    if store.exists(there) or not store.rename(here, there):
        store.delete(here, True)
        raise FileExistsError(path)
    return spark.createDataFrame([(dataset, path, stamp["content_hash"], stamp["rows"])], "dataset_id string, path string, content_hash string, rows long")


def section_gaps(rows: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sections whose rows differ from the manifest (section_id, rows), missing and unexpected ones too."""
    have = rows.groupBy("section_id").agg(F.count("*").alias("actual"))
    return manifest.join(have, "section_id", "full").where("not (rows <=> actual)")
