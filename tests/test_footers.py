"""Folders of Parquet files held against a schema by their footers."""

import decimal

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from ledgerloom.sources import footers, tapes

GOVERNED = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("amount", T.DecimalType(12, 2)), T.StructField("at", T.TimestampType())])


def table(n=4, **other):
    columns = {
        "id": (pa.array(range(n), pa.int64()), False),
        "amount": (pa.array([decimal.Decimal("1.50")] * n, pa.decimal128(12, 2)), True),
        "at": (pa.array([0] * n, pa.timestamp("us", "UTC")), True),
    } | other
    columns = {k: v for k, v in columns.items() if v is not None}
    return pa.Table.from_arrays([a for a, _ in columns.values()], schema=pa.schema([pa.field(k, a.type, nullable) for k, (a, nullable) in columns.items()]))


def found(spark, path, **more):
    rows = footers.problems(footers.footers(spark, str(path)), GOVERNED, **more).collect()
    return sorted(((r.file.rsplit("/", 1)[1] if r.file else None, r.problem) for r in rows), key=str)


def test_a_conforming_folder_is_read(spark, tmp_path):
    for i in range(5):
        pq.write_table(table(7), tmp_path / f"{i}.parquet", row_group_size=3)
    assert found(spark, tmp_path, declared_rows=35) == []
    assert tapes.read_parquet(spark, str(tmp_path), GOVERNED, 35).count() == 35
    one = footers.footers(spark, str(tmp_path)).first()
    assert (one.rows, one.groups, one.nulls) == (7, [3, 3, 1], [0, 0, 0])


@pytest.mark.parametrize(
    "other, problem",
    [
        ({"note": (pa.array(["x"] * 4), True)}, "unexpected note string optional"),
        ({"at": None}, "missing at timestamp utc optional"),
        ({"id": (pa.array([1, 2, 3, None], pa.int64()), True)}, "unexpected id int64 optional"),
        ({"id": (pa.array(range(4), pa.int32()), False)}, "unexpected id int32 required"),
        ({"amount": (pa.array([decimal.Decimal("1.500")] * 4, pa.decimal128(12, 3)), True)}, "unexpected amount decimal(12,3) optional"),
        ({"at": (pa.array([0] * 4, pa.timestamp("us")), True)}, "unexpected at timestamp optional"),
        ({"at": (pa.array([[0]] * 4, pa.list_(pa.int64())), True)}, "unexpected at.list.element nested"),
    ],
)
def test_one_deviating_file_is_refused(spark, tmp_path, other, problem):
    pq.write_table(table(), tmp_path / "a.parquet")
    pq.write_table(table(), tmp_path / "b.parquet")
    pq.write_table(table(**other), tmp_path / "c.parquet")
    assert ("c.parquet", problem) in found(spark, tmp_path) and {f for f, _ in found(spark, tmp_path)} == {"c.parquet"}
    with pytest.raises(ValueError, match="c.parquet"):
        tapes.read_parquet(spark, str(tmp_path), GOVERNED)


def test_order_counts_limits_and_what_is_no_parquet(spark, tmp_path):
    pq.write_table(table().select(["amount", "id", "at"]), tmp_path / "a.parquet")
    (tmp_path / "b.parquet").write_bytes(b"PAR1 nothing PAR1")
    pq.write_table(table(6), tmp_path / "c.parquet", row_group_size=1)
    got = found(spark, tmp_path, declared_rows=11, limits=footers.Limits(row_groups=5, rows=9))
    assert ("a.parquet", "columns are in another order") in got and ("c.parquet", "too many row groups") in got
    assert any(f == "b.parquet" and p.startswith("not Parquet") for f, p in got)
    assert (None, "too many rows") in got and (None, "11 rows declared, 10 found") in got
    assert len(got) == 5


def test_no_file_and_ungoverned_types(spark, tmp_path):
    assert found(spark, tmp_path) == [(None, "no file")]
    with pytest.raises(ValueError, match="can't be governed"):
        footers.governed(T.StructType([T.StructField("x", T.ArrayType(T.LongType()))]))


def test_partition_column_inside_the_file(spark):
    df = spark.createDataFrame([("2024-01-31", "2024-01-31"), ("2024-01-31", None), ("2024-02-29", "2024-01-31")], "p string, own string")
    assert tapes.partition_mismatch(df, {}, {"p": "own"}).count() == 2
    assert tapes.partition_mismatch(df, {"p": "2024-01-31"}).count() == 1
