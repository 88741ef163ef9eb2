"""What the work of a query may grow with: tables found once, timers a series, sorts a loan, Python workers a task."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import history, staged, vintage
from ledgerloom.plans import governance, monitoring
from ledgerloom.sources import ranges
from ledgerloom.streaming import monitors


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_status_that_the_first_task_has_not_leaves_no_empty_file(spark, tmp_path):
    kinds = "o_orderkey long, o_orderstatus string, o_totalprice double"
    at = str(tmp_path / "orders.parquet")
    spark.createDataFrame([(i, "O", 1.5) for i in range(5000)], kinds).coalesce(1).write.parquet(at)
    spark.createDataFrame([(-1, "F", 2.5), (-2, "P", 3.5), (-3, "P", None), (-4, None, 1.0), (-5, "a+b /%", 1.0)], kinds).coalesce(1).write.mode("append").parquet(at)
    got = {r.part: (r["rows"], r.problems) for r in governance.s5_footer_scan(spark, str(tmp_path)).collect()}
    price = "missing o_totalprice decimal(20,2) optional,unexpected o_totalprice decimal(18,2) optional"
    assert got == {"O": (5000, ""), "F": (1, "unexpected note string required"), "P": (2, price), None: (1, ""), "a+b /%": (1, "")}


class _Handle:
    def __init__(self):
        self.timers, self.held = [], None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, held):
        self.held = held

    def registerTimer(self, ms):
        self.timers.append(ms // monitors.DAY_MS)


class _At:
    def __init__(self, day):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: day * monitors.DAY_MS


def test_a_series_of_many_days_has_one_timer():
    import pandas as pd

    monitor, handle = monitors.Monitor(["s"], {"type": "absolute", "op": "gte", "bound": 5.0}, 1000, "alert", 0, 1), _Handle()
    monitor.init(handle)
    rows = pd.DataFrame({"as_of": pd.to_datetime([f"1970-02-{d:02}" for d in range(20, 0, -1)]), "point_id": [str(d) for d in range(20)], "value": [float(d) for d in range(20)]})
    list(monitor.handleInputRows((1,), iter([rows]), None))
    assert handle.timers == [32]
    out = pd.concat(list(monitor.handleExpiredTimer((1,), _At(41), _At(32))))
    assert len(out) == 10 and out["as_of"].max() == datetime.date(1970, 2, 10)
    assert handle.timers == [32, 42]  # the first day that is still open


def test_stages_read_what_was_delivered(spark, sf, monkeypatch):
    runs = []
    monkeypatch.setattr(staged, "run_stages", lambda spark, at, stages: runs.append(stages) or spark.createDataFrame([("x", "done", 1)], "stage string, status string, rows long"))
    monitoring.m10_staged_run(spark, sf)
    assert len(runs) == 2 and all("lineitem" not in plan(stages[0].run({})) for stages in runs)


def test_a_task_cuts_and_checks_records_in_one_worker(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n"1\n2",x\n3,y\n')
    rows = ranges.csv_records(spark, str(tmp_path), ["a", "b"])
    assert sorted(r[0] for r in rows.collect()) == ['"1\n2",x', "3,y"]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3  # whole records, pieces, pieces put together


@pytest.mark.parametrize("same", [(), ("kind",)])
def test_rows_with_rates_are_found_twice(spark, same):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    day = datetime.date(2024, 1, 1)
    rows = spark.createDataFrame([("EUR", day + datetime.timedelta(i % 7), day + datetime.timedelta(i % 9 + 3), "x") for i in range(60)], "currency string, as_of_date date, known_at date, kind string").mapInArrow(count, "currency string, as_of_date date, known_at date, kind string")
    rates = spark.createDataFrame([("EUR", day + datetime.timedelta(i), day + datetime.timedelta(i + 2), float(i), str(i), "x") for i in range(8)], "base string, effective_on date, received_at date, rate double, rate_hash string, kind string")
    assert history.rates_as_of(rows, rates, same=same).where("rate is not null").count() > 0
    assert seen.value == 120  # what is asked, and the rows themselves


def test_disclosure_reads_one_table_of_members(spark, sf):
    assert "lineitem" not in plan(governance.j18_m11_disclosure(spark, sf))


def test_strict_curves_take_one_sort_a_branch_and_equal_the_others(spark):
    rng, rows = random.Random(3), []
    for k in range(40):
        start = datetime.date(2023, rng.randint(1, 12), rng.randint(1, 28))
        for d in sorted(rng.sample(range(0, 400), 9)):
            at = datetime.date(2023, 1, 1) + datetime.timedelta(d)
            rows.append((f"l{k}", at, None if rng.random() < 0.2 else start, 100, rng.choice([None, 10, 20]), rng.choice([None, 0, 5]), 0, rng.choice([None, 0, 40])))
    kinds = "loan_id string, as_of_date date, origination_date date, original_balance decimal(20,2), outstanding_balance decimal(20,2), charge_off_amount decimal(20,2), recovery_amount decimal(20,2), days_past_due int"
    df = spark.createDataFrame([(*r[:3], *(None if x is None else __import__("decimal").Decimal(x) for x in r[3:7]), r[7]) for r in rows], kinds)
    last = F.lit("2024-02-28").cast("date")
    strict, plain = (vintage.vintage(df.union(df.limit(20)) if s else df, ["loan_id"], last, "quarter", 12, 30, strict=s) for s in (True, False))
    assert sorted(map(str, strict.collect())) == sorted(map(str, plain.collect()))
    assert plan(vintage.refused(df, ["loan_id"])).count("Sort [") == 1
