"""Running values, as-of rates and allocation where one key holds most rows, against brute force."""

import datetime
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import borrowing, disclosure, history
from ledgerloom.operators.running import running


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_running_sum_and_maximum(spark, many_ranges):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), i, rng.choice([None, Decimal(rng.randrange(-50, 50))]), rng.randrange(99)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, at int, v decimal(12,2), x int").repartition(5)
    got = {r.at: (r.total, r.top) for r in running(df, ["k"], [("at", False)], {"total": ("sum", F.col("v")), "top": ("max", F.col("x"))}).collect()}
    assert len(got) == 900
    for k in ("hot", "a", None):
        total, top, any_yet = Decimal(0), -1, False
        for _, at, v, x in sorted((r for r in rows if r[0] == k), key=lambda r: -r[1]):
            any_yet, total, top = any_yet or v is not None, total + (v or 0), max(top, x)
            assert got[at] == (total if any_yet else None, top)


def test_a_hot_key_is_spread_over_ranges(spark, many_ranges):
    df = spark.range(5000).select(F.lit("one").alias("k"), "id")
    out = running(df, ["k"], [("id", True)], {"n": ("sum", F.lit(1))})
    assert out.where("n <> id + 1").isEmpty()
    spread = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 2 and max(r["count"] for r in spread) < 3000


def brute_rate(quotes, cur, kind, at, known):
    fit = [q for q in quotes if q[0] == cur and q[1] == kind and q[2] <= at and q[3] <= known]
    return max(fit, key=lambda q: (q[2], q[3], q[5]))[4] if fit else None


def test_every_row_has_its_own_cutoff(spark, many_ranges):
    rng = random.Random(11)
    day = lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)
    quotes = [(rng.choice(["EUR", "EUR", "EUR", "GBP"]), rng.choice(["spot", "close"]), day(e := rng.randrange(200)), day(e + rng.randrange(90)), Decimal(i) / 100, f"h{i % 50:03}") for i in range(250)]
    quotes += [("EUR", "spot", None, day(1), Decimal(9), "n"), (None, "spot", day(1), day(1), Decimal(9), "n")]
    rows = [(i, rng.choice(["EUR", "GBP", "CHF", None]), rng.choice(["spot", "close"]), day(rng.randrange(-5, 320)), day(i % 330)) for i in range(600)]
    q = spark.createDataFrame(quotes, "base string, kind string, effective_on date, received_at date, rate decimal(12,2), rate_hash string")
    r = spark.createDataFrame(rows, "id int, currency string, kind string, as_of_date date, known_at date")
    got = {x.id: x.rate for x in history.rates_as_of(r, q, same=("kind",)).collect()}
    known = [x for x in quotes if x[0] and x[2]]
    ties = {(x[0], x[1], x[2], x[3], x[5]) for x in known}
    assert len(ties) == len(known)
    assert got == {i: brute_rate(known, cur, kind, at, cut) for i, cur, kind, at, cut in rows}
    assert history.rates_as_of(r, q.limit(0), same=("kind",)).where("rate is not null").isEmpty()


def test_one_debtor_with_all_invoices(spark, many_ranges):
    rng = random.Random(2)
    rows = [("f", "big", f"r{i:04}", Decimal(rng.randrange(1, 900)), rng.randrange(80)) for i in range(800)] + [("f", None, "x1", Decimal(50), 0), ("f", "old", "x2", Decimal(70), 120), ("f", "old", "x3", Decimal(30), 0)]
    df = spark.createDataFrame(rows, "facility_id string, debtor_id string, receivable_id string, outstanding_amount decimal(20,2), days_past_due int")
    for allocation, order in (("invoice", lambda r: r[2]), ("largest", lambda r: (-r[3], r[2])), ("oldest", lambda r: (-r[4], r[2]))):
        never = ("none", 1, {"op": "days_past_due_at_least", "days": 100000})
        policy = borrowing.ArPolicy([never], "0.8", "1000000", "0", "1000000", cross_age_ratio="0.5", concentration="0.25", allocation=allocation)
        got = {r.receivable_id: (r.cross_aged, r.concentration, r.eligible) for r in borrowing.ar_receivables(df, policy, ["facility_id"]).collect()}
        assert got["x1"] == (0, 0, 50) and got["x2"] == (70, 0, 0) and got["x3"] == (30, 0, 0)
        big = sum(r[3] for r in rows if r[1] == "big")
        left = excess = big - (big + 50) * Decimal("0.25")
        for r in sorted((r for r in rows if r[1] == "big"), key=order):
            taken = min(r[3], left)
            left -= taken
            assert got[r[2]][1:] == (taken, r[3] - taken), r
        assert excess > 0 == left


def test_pages_by_key_are_pages_by_offset(spark):
    df = spark.createDataFrame([(i % 7, f"k{i:03}") for i in range(200)], "a int, b string")
    keys, last, seen = [("a", False), ("b", True)], None, []
    while rows := disclosure.page_after(df, keys, last, 33).collect():
        seen += [tuple(r) for r in rows]
        last = rows[-1].asDict()
    assert seen == sorted(((i % 7, f"k{i:03}") for i in range(200)), key=lambda r: (-r[0], r[1]))
