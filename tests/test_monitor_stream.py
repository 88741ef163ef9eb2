"""Streamed monitors say on each day what the batch says, for any condition, over many small batches in any order of arrival."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import monitor
from ledgerloom.streaming import monitors, streams

DAY = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(days=n)
HIGH = {"type": "absolute", "op": "gte", "bound": 50.0, "reset": 30.0}
RISE = {"type": "change", "op": "gt", "bound": 10.0, "mode": "percent", "lookback": 2}
MEAN = {"type": "rolling", "op": "gte", "bound": 45.0, "window": 3, "aggregation": "avg", "minimum": 2}
TREES = {"absolute": HIGH, "change": RISE, "rolling": MEAN, "consecutive": {"type": "consecutive", "periods": 2, "condition": MEAN}, "all": {"type": "all", "conditions": [HIGH, MEAN]}, "any": {"type": "any", "conditions": [RISE, HIGH]}}
SCHEMA = "series string, as_of_date date, point_id string, value double"


@pytest.fixture
def rocks(spark):
    spark.conf.set(*monitors.PROVIDER)
    yield
    spark.conf.unset(monitors.PROVIDER[0])


@pytest.mark.parametrize("name", TREES)
def test_judgements_equal_the_columns(spark, name):
    rng = random.Random(name)
    rows = [(s, DAY(d), f"p{d:02}", rng.choice([None, *range(10, 90, 7)])) for s in "abc" for d in range(25)]
    rows = [(s, d, p, None if v is None else float(v)) for s, d, p, v in rows]
    found = monitor.condition(TREES[name], ["series"], ["as_of_date", "point_id"])
    df = spark.createDataFrame(rows, SCHEMA).select("*", found.known.alias("k"), found.hit.alias("h"), found.calm.alias("c"))
    past = {}
    for r in sorted(df.collect(), key=lambda r: (r.series, r.as_of_date)):
        values = past.setdefault(r.series, [])
        values.append(r.value)
        assert monitors.judge(TREES[name], values[-monitors.history(TREES[name]) :]) == (r.k, r.h, r.c), (values, r)


@pytest.mark.parametrize("name", ["any", "consecutive"])
def test_a_stream_equals_the_batch_on_each_day(spark, rocks, tmp_path, name):
    rng, tree = random.Random(7), TREES[name]
    days = {s: sorted(rng.sample(range(14), 8)) for s in "abc"}
    points = [(s, DAY(d), f"p{d:02}{k}", rng.choice([None, 20.0, 40.0, 46.0, 60.0, 80.0])) for s, own in days.items() for d in own for k in range(rng.choice([1, 1, 2]))]
    waves = [[p for p in points if p[1] < DAY(6)], [p for p in points if DAY(6) <= p[1] < DAY(10)], [p for p in points if p[1] >= DAY(10)], [("end", DAY(60), "z", 0.0)]]
    for i, wave in enumerate(waves):
        rng.shuffle(wave)
        extra = [("never", DAY(0), None, None)] if i == 0 else []
        spark.createDataFrame(wave + extra, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = monitors.monitor_stream(streams.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame([], SCHEMA).schema), tree, ["series"], 5, cooldown_days=3)
        got = streams.run_to_table(out, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.series, r.as_of): (r.outcome, r.reason, r.point_id) for r in got.collect()}
    assert got[("never", DAY(6))] == ("missing", "missing_observation", None)
    all_points = spark.createDataFrame(points, SCHEMA)
    state = {s: (False, None) for s in "abc"}
    for d in sorted({p[1] for p in points}):
        scopes = spark.createDataFrame([(s, *state[s]) for s in "abc"], "series string, case_open boolean, last_triggered date")
        for r in monitor.evaluate_v2(scopes, all_points, tree, ["series"], F.lit(d), 5, cooldown_days=3).where(F.col("as_of_date") == F.lit(d)).collect():
            assert got[(r.series, d)] == (r.outcome, r.reason, r.point_id), (r, d)
            opened = {"triggered": (True, d), "reset": (False, state[r.series][1])}.get(r.outcome, state[r.series])
            state[r.series] = opened
    for s, own in days.items():
        stale = [b for a, b in zip(own, [*own[1:], 999]) if b - a > 5]
        assert sum(1 for (k, _), v in got.items() if k == s and v[1] == "stale_observation") == len(stale)
