"""SQLite files read in parallel from one state, with filters at the source and an attestation."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.sqlite import sqlite_snapshot

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("amount", T.StringType()), T.StructField("day", T.StringType())])


@pytest.fixture
def files(tmp_path):
    out = []
    for n in range(2):
        con = sqlite3.connect(tmp_path / f"{n}.db")
        con.execute("CREATE TABLE loans (id INTEGER, amount NUMERIC, day TEXT)")
        con.executemany("INSERT INTO loans VALUES (?, ?, ?)", [(i * 2 + n, None if i % 10 == 3 else f"{i}.50", f"2024-01-{i % 28 + 1:02}") for i in range(200)])
        con.commit()
        con.close()
        out.append(str(tmp_path / f"{n}.db"))
    return out


def test_ranges_watermark_and_attestation(spark, files):
    rows, attested = sqlite_snapshot(spark, files, "loans", SCHEMA, ("day", "2024-01-20"), parts=5, most=400)
    got = rows.collect()
    assert len(got) == len({r.id for r in got}) == sum(r.source_rows for r in attested.collect()) and max(r.day for r in got) == "2024-01-20"
    assert rows.rdd.getNumPartitions() == 10 and {r.amount for r in got if r.id == 2} == {"1.5"}
    assert all(r.max_cell_bytes == 10 and r.max_row_bytes >= 15 for r in attested.collect())
    with pytest.raises(ValueError, match="at most"):
        sqlite_snapshot(spark, files, "loans", SCHEMA, most=10)


def test_filters_reach_the_source_and_mean_the_same(spark, files):
    rows, _ = sqlite_snapshot(spark, files, "loans", SCHEMA)
    kept = rows.where((F.col("id") >= 10) & (F.col("day") == "2024-01-05") & F.col("amount").isNotNull())
    assert sorted(r.id for r in kept.collect()) == sorted(i * 2 + n for n in range(2) for i in range(200) if i * 2 + n >= 10 and i % 28 == 4 and i % 10 != 3)


def test_a_file_that_changes_ends_the_run(spark, files):
    rows, _ = sqlite_snapshot(spark, files, "loans", SCHEMA)
    assert rows.count() == 400
    from ledgerloom.sources.sqlite import RowRange, SnapshotReader, change_counter

    reader = SnapshotReader({"table": "loans", "paths": files[0], "columns": "id"}, SCHEMA)
    part = reader.partitions()[0]
    con = sqlite3.connect(files[0])
    con.execute("DELETE FROM loans WHERE id = 0")
    con.commit()
    con.close()
    assert change_counter(files[0]) != part.counter
    with pytest.raises(ValueError, match="has changed"):
        list(reader.read(part))
    assert len(list(reader.read(RowRange(files[0], change_counter(files[0]), part.low, part.high)))) < 60


def test_refusals(spark, tmp_path):
    (tmp_path / "x.db").write_bytes(b"nothing")
    with pytest.raises(Exception, match="no SQLite file"):
        sqlite_snapshot(spark, [str(tmp_path / "x.db")], "loans", SCHEMA)[0].collect()
    with pytest.raises(Exception, match="plain name"):
        sqlite_snapshot(spark, [str(tmp_path / "x.db")], "loans; --", SCHEMA)[0].collect()
