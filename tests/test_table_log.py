"""The versioned table against a simulation: random versions, replays, compaction and vacuum."""

import datetime
import random

import pytest

from ledgerloom.streaming.table_log import TableLog

DAY = lambda n: datetime.date(2024, 1, n)
SCHEMA = "id long, as_of_date date"


def rows(spark, pairs):
    return spark.createDataFrame([(i, DAY(d)) for i, d in pairs], SCHEMA)


@pytest.mark.parametrize("every", [1, 3, 100])
def test_against_a_simulation(spark, tmp_path, every):
    rng = random.Random(every)
    log = TableLog(spark, f"{tmp_path}/t", SCHEMA, every=every)
    present, fixed = [], []
    for version in range(9):
        mode = "full" if version == 0 else rng.choice(["full", "delta", "delta", "backfill", "correction"])
        first = rng.randrange(1, 6)
        last = rng.randrange(first, 8)
        new = [(100 * version + i, rng.randrange(first, last + 1)) for i in range(rng.randrange(0, 6))]
        old = rng.randrange(version) if mode in ("backfill", "correction") else None
        assert log.commit(version, rows(spark, new), mode, (DAY(first), DAY(last)), old)
        if mode in ("full", "backfill"):
            present = [(i, d) for i, d in present if not first <= d <= last]
        if mode == "correction":
            fixed += [(i, d, version, old) for i, d in new]
        else:
            present += new
        if version % 4 == 3:
            assert not log.commit(version, rows(spark, [(9, 1)]), "full", (DAY(1), DAY(31)))
            assert not log.commit(rng.randrange(version), rows(spark, [(9, 1)]), "delta")
            log.vacuum()
        if version in (4, 8):
            assert sorted((r.id, r.as_of_date.day) for r in log.read().collect()) == sorted(present)
            assert sorted((r.id, r.as_of_date.day, r.revision, r.supersedes) for r in log.corrections().collect()) == sorted(fixed)
    assert [r.version for r in log.runs().orderBy("version").collect()] == list(range(9))
    log.compact()
    log.vacuum()
    assert sorted((r.id, r.as_of_date.day) for r in log.read().collect()) == sorted(present)
    assert log._listed("log", "v") == [] and len(log._listed("data", "c")) == 1


def test_reads_open_the_checkpoint_and_what_came_after(spark, tmp_path):
    log = TableLog(spark, f"{tmp_path}/t", SCHEMA, every=5)
    for version in range(13):
        log.commit(version, rows(spark, [(version, 1)]), "delta" if version else "full")
    plan = log.read()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") <= 5 and log.read().count() == 13 and log.checkpoint() == 9


def test_refusals_and_half_written_versions(spark, tmp_path):
    log = TableLog(spark, f"{tmp_path}/t", SCHEMA)
    some = rows(spark, [(1, 3)])
    assert log.read().count() == 0 and log.corrections().count() == 0 and log.vacuum() == 0 and log.compact() == -1
    for bad in (("other", None, None), ("backfill", None, None), ("full", None, 0), ("correction", None, 0), ("full", (DAY(4), DAY(5)), None)):
        with pytest.raises(ValueError):
            log.commit(0, some, *bad)
    assert log.commit(2, some, "full") and log.read().count() == 1
    with pytest.raises(ValueError, match="later"):
        log.commit(1, some, "delta")
    some.write.partitionBy("as_of_date").parquet(f"{tmp_path}/t/data/v=7")  # a job that died before its commit
    assert log.read().count() == 1 and log.vacuum() == 2 and log.commit(7, some, "delta") and log.read().count() == 2


def test_a_stream_writes_versions(spark, tmp_path):
    log = TableLog(spark, f"{tmp_path}/t", SCHEMA, every=2)
    for n in range(3):
        rows(spark, [(n, n + 1)]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        log.sink(stream, f"{tmp_path}/cp", lambda batch: ("delta", None, None)).awaitTermination()
    assert sorted(r.id for r in log.read().collect()) == [0, 1, 2] and log.runs().count() == 3
