"""Small fixtures with known results, and the traps of each metric."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import filters, mapping
from ledgerloom.functions import scalars as s
from ledgerloom.operators import borrowing as b
from ledgerloom.operators import disclosure, finalize, history, monitor, quality, stratification, surveillance, vintage
from ledgerloom.sources import tapes
from ledgerloom.streaming import streams


def day(text):
    return dt.date.fromisoformat(text)


def test_stratification_hides_the_small_cell_and_one_more(spark):
    rows = [("A", "0.1", "5.1"), ("A", "0.2", "5.2"), ("B", "0.3", "6"), ("C", "1.1", "7"), ("C", "2.2", "7.5"), ("C", "3.3", "8")]
    df = spark.createDataFrame([(day("2025-01-31"), r, D(x), D(y)) for r, x, y in rows], "as_of_date date, risk_rating string, outstanding_balance decimal(20,2), interest_rate decimal(12,8)")
    got = {r.bucket: r for r in stratification.stratify(df, s.category("risk_rating"), averages=("interest_rate",), least=2).collect()}
    assert got["A"].suppressed and got["B"].suppressed and got["A"].balance is None
    assert got["C"].loans == 3 and got["C"].balance == D("6.60") and abs(got["C"].wa_interest_rate - 23 / 3) < 1e-9


def test_stratification_does_not_depend_on_order(spark, sf):
    from ledgerloom.plans.tape import tape

    rows = tape(spark, sf).cache()
    run = lambda df: sorted(map(str, stratification.stratify(df, s.category("risk_rating"), averages=("interest_rate",)).collect()))
    assert run(rows) == run(rows.orderBy(F.desc("loan_id")).repartition(7))


def test_vintage_latest_row_and_unseasoned_points(spark):
    rows = [
        ("L1", "2024-01-15", "2024-01-31", 100, 100, 0, 0, 0), ("L1", "2024-01-15", "2024-02-10", 100, 95, 0, 0, 0), ("L1", "2024-01-15", "2024-02-28", 100, 90, 10, 2, 35),
        ("L2", "2024-01-20", "2024-01-31", 50, 50, 0, 0, 0), ("L2", "2024-01-20", "2024-03-31", 50, 40, 0, 0, 0), ("L3", "2024-02-01", "2024-02-29", 70, 70, 0, 0, 0),
    ]
    df = spark.createDataFrame([(a, day(o), day(d), *map(D, (w, x, y, z)), n) for a, o, d, w, x, y, z, n in rows], "loan_id string, origination_date date, as_of_date date, original_balance decimal(20,2), outstanding_balance decimal(20,2), charge_off_amount decimal(20,2), recovery_amount decimal(20,2), days_past_due int")
    assert vintage.conflicts(df, ["loan_id"]).count() == 0
    got = {(str(r.cohort), r.mob): r for r in vintage.vintage(df, ["loan_id"], F.lit("2024-03-31").cast("date"), "month", 3, 30).collect()}
    assert len(got) == 8
    one = got["2024-01-01", 1]
    assert (one.loans, one.observed, one.original, one.current, one.net_loss, one.delinquent) == (2, 1, D(150), D(90), D(8), D(90))
    assert one.factor == 0.6 and abs(one.loss_rate - 8 / 150) < 1e-12 and one.delinquency_rate == 1
    assert got["2024-01-01", 3].seasoned is False and got["2024-01-01", 3].current is None
    late = got["2024-02-01", 1]
    assert late.seasoned and late.observed is None and late.current is None


BOOK = {
    "L1": ("F1", [(100, 0, "A", False, 0, 0, None), (90, 35, "B", False, 5, 0, 5), (80, 0, "A", False, 0, 0, 10)]),
    "L2": ("F1", [(200, 35, "B", False, 0, 0, None), (180, 65, "C", True, 10, 2, 10), (0, 90, "D", True, 0, 5, None)]),
    "L3": ("F1", [(300, 65, "C", True, 0, 0, None), (280, 30, "C", True, 0, 0, 20), (250, 0, "B", True, 0, 3, 10)]),
    "L4": ("F2", [(400, 0, "A", False, 0, 0, None), (420, 0, "A", False, 0, 0, None), (400, 10, "B", False, 0, 0, 10)]),
    "L5": ("F2", [None, None, (50, 0, "A", False, 0, 0, None)]),
}
ORIGINAL = {"L1": 100, "L2": 200, "L3": 300, "L4": 400, "L5": 50}
LIMIT = {"L1": 120, "L2": 250, "L3": 350, "L4": 500, "L5": 75}
MATURITY = {"L1": "2024-03-15", "L2": "2024-12-31", "L3": "2026-01-31", "L4": "2023-12-31", "L5": "2025-01-31"}
BORROWER = {"L1": "raw-e1", "L2": "raw-e2", "L3": "raw-e3", "L4": "raw-e1-alias", "L5": "raw-e2"}
DATES = ["2024-01-31", "2024-02-29", "2024-03-31"]
BINS = [s.Bin("Current", 0, 30), s.Bin("30-59", 30, 60), s.Bin("60+", 60)]


@pytest.fixture(scope="module")
def book(spark):
    d = lambda x: None if x is None else D(x)
    rows = [
        (i, day(DATES[i]), "core", f, k, BORROWER[k], day("2020-01-01"), D(x[0]), D(ORIGINAL[k]), D(LIMIT[k]), x[1], x[3], D(x[4]), D(x[5]), d(x[6]), day("2023-12-31"), x[2], day(MATURITY[k]))
        for k, (f, periods) in BOOK.items() for i, x in enumerate(periods) if x
    ]
    m = "decimal(20,2)"
    schema = f"period_idx int, as_of_date date, source_system string, facility_id string, loan_id string, borrower_id string, origination_date date, outstanding_balance {m}, original_balance {m}, commitment_amount {m}, days_past_due int, default_flag boolean, charge_off_amount {m}, recovery_amount {m}, scheduled_principal_amount {m}, default_date date, risk_rating string, maturity_date date"
    return spark.createDataFrame(rows, schema).cache()


def at(rows, date, **keys):
    name = "to_date" if "to_date" in rows[0].asDict() else "as_of_date"
    hit = [r for r in rows if str(r[name]) == date and all(r[k] == v for k, v in keys.items())]
    assert len(hit) == 1, hit
    return hit[0]


def test_surveillance_pack(book):
    feb = DATES[1]
    assert abs(at(surveillance.default_incidence(book).collect(), feb).value - 1 / 3) < 1e-12
    assert at(surveillance.ever_dpd(book, [30, 60]).collect(), DATES[0], threshold=30).value == 0.5
    pay = at(surveillance.paydown_prepayment(book).collect(), feb)
    assert abs(pay.paydown_rate - 0.05) < 1e-12 and abs(pay.prepayment_rate - 0.015) < 1e-12
    loss = at(surveillance.loss_recovery(book).collect(), feb)
    assert abs(loss.gross_loss_rate - 15 / 970) < 1e-12 and loss.recovery_lag_days == 60
    opening = at(surveillance.loss_recovery(book, exposure="original_balance").collect(), feb)
    assert abs(opening.gross_loss_rate - 0.015) < 1e-12 and abs(opening.net_loss_rate - 0.013) < 1e-12
    use = at(surveillance.balance_utilisation(book).collect(), DATES[2], metric="utilisation")
    assert use.numerator == D(780) and use.denominator == D(1295)
    wall = at(surveillance.maturity_wall(book, [("0-12", 12), ("13-36", 36)]).collect(), DATES[0], window="Matured")
    assert wall.share == 0.4
    roll = at(surveillance.roll_cure(book, BINS).collect(), feb, from_label="Current", to_label="30-59")
    assert roll.value == 0.2 and roll.movement == "roll" and (roll.eligible, roll.observed) == (2, 2)
    assert at(surveillance.rating_migration(book).collect(), feb, from_label="A", to_label="B").value == 0.2


def test_period_change_adds_up(book):
    rows = [r for r in surveillance.period_change(book, "facility_id").collect() if str(r.to_date) == DATES[1]]
    assert sum(r.amount for r in rows) == D(-30)
    moved = surveillance.period_change(book.withColumn("facility_id", F.when((F.col("loan_id") == "L1") & (F.col("period_idx") == 1), "F9").otherwise(F.col("facility_id"))), "facility_id").collect()
    assert at(moved, DATES[1], segment="F9", driver="new_exposure").loans == 1 and at(moved, DATES[1], segment="F1", driver="exit").amount == D(-100)


def test_concentration_by_entity(spark, book):
    entities = spark.createDataFrame([("core", "raw-e1", "entity-1"), ("core", "raw-e1-alias", "entity-1"), ("core", "raw-e2", "entity-2"), ("core", "raw-e3", "entity-3")], "source_system string, source_id string, entity_id string")
    rows = surveillance.concentration(surveillance.resolve_entities(book, entities), F.col("entity"), 1).collect()
    top = at(rows, DATES[0], category="entity-1")
    assert top.share == 0.5 and abs(top.hhi - 0.38) < 1e-12  # over all groups, though the others are shown as one
    assert at(rows, DATES[0], category="Other").share == 0.5


def test_missing_end_rows(book):
    gone = book.where("not (loan_id = 'L4' and period_idx = 1)")
    assert at(surveillance.paydown_prepayment(gone).collect(), DATES[1]).paydown == D(10 + 20 + 20 + 400)  # paid to zero
    roll = at(surveillance.roll_cure(gone, BINS).collect(), DATES[1], from_label="Current", to_label="Current")
    assert (roll.eligible, roll.observed) == (2, 1)  # not seen, not an event


def test_null_policy_fills_amounts_only():
    with pytest.raises(ValueError):
        s.with_null_policy("x", "other")


def test_scalars(spark):
    d = lambda x: F.lit(x).cast("date")
    row = spark.range(1).select(
        s.months_between_calendar(d("2024-01-31"), d("2024-03-01")).alias("mob"), s.months_until(d("2024-01-31"), d("2024-01-15")).alias("same"), s.months_until(d("2024-01-15"), d("2024-01-31")).alias("later"),
        s.ratio(F.lit(1), F.lit(0)).alias("zero"), s.numeric_bin(F.lit(30), BINS).alias("edge"), s.numeric_bin(F.lit(None).cast("int"), BINS).alias("none"), s.numeric_bin(F.lit(-1), BINS).alias("out"), s.category(F.lit("  ")).alias("blank"),
        s.value_kind(F.lit("1e5")).alias("text"), s.value_kind(F.lit("2026-02-30")).alias("day"), F.bround(F.lit(D("2.5")), 0).alias("even"), s.evidence_refs(F.array(F.lit("b"), F.lit("a"), F.lit("b"))).alias("refs"),
    ).first()
    assert (row.mob, row.same, row.later, row.zero, row.edge) == (2, 0, 1, None, "30-59")
    assert (row.none, row.out, row.blank, row.text, row.day, row.even, row.refs) == (s.UNKNOWN, s.OTHER, s.UNKNOWN, "text", "text", 2, ["a", "b"])
    with pytest.raises(ValueError):
        s.check_bins([s.Bin("a", 0, 10), s.Bin("b", 5, 20)])
    assert s.definition_hash({"b": 1, "a": 2}) == s.definition_hash({"a": 2, "b": 1})


def test_filters_are_two_valued(spark):
    df = spark.createDataFrame([("1", "10", "abc"), ("2", None, "9"), ("3", "x", None)], "id string, n string, t string")
    ids = lambda c: [r.id for r in df.where(c).orderBy("id").collect()]
    f = lambda op, field, value=None, **k: {"op": op, "field": field, **({"value": value} if value is not None else {}), **k}
    assert ids(filters.population_filter(f("neq", "n", "10"))) == ["2", "3"]
    assert ids(filters.population_filter(f("gt", "n", 5))) == ["1"]
    assert ids(~filters.population_filter(f("gt", "n", 5))) == ["2", "3"]
    assert ids(filters.investigation_filter(f("lt", "t", "10"))) == ["2", "3"]  # 9 < 10 as numbers; absent comes first
    assert ids(filters.investigation_filter(f("gt", "t", "aa"))) == ["1"]
    with pytest.raises(ValueError):
        filters.check_filter({"op": "and", "args": [{"op": "or", "args": [{"op": "and", "args": [{"op": "or", "args": [f("eq", "n", 1)]}]}]}]})


def test_effective_ends(spark):
    on = lambda inclusive: spark.range(1).select(filters.effective(F.lit("2026-06-30").cast("date"), F.lit("2026-01-01").cast("date"), F.lit("2026-06-30").cast("date"), inclusive)).first()[0]
    assert on(True) and not on(False)


AR = b.ArPolicy([("past-due", 10, {"op": "days_past_due_at_least", "days": 90}), ("disputed", 20, {"op": "has_flag", "flag": "disputed"})], "0.8", "500", "50", "425", 90, "0.2", "0.5")


def test_ar_base_waterfall(spark):
    rows = [("A-current", "D1", 300, 0, []), ("A-old", "D1", 100, 100, []), ("B-current", "D2", 500, 0, []), ("C-current", "D3", 300, 0, []), ("C-disputed", "D3", 100, 0, ["disputed"])]
    rec = spark.createDataFrame([("F", i, d, D(a), p, f) for i, d, a, p, f in rows], "facility_id string, receivable_id string, debtor_id string, outstanding_amount decimal(20,2), days_past_due int, flags array<string>")
    usage = spark.createDataFrame([("F", D(400)), ("F", D(50))], "facility_id string, amount decimal(20,2)")
    base = b.ar_base(rec, usage, AR, ["facility_id"]).first()
    assert [base[c] for c in ("gross", "ineligible", "cross_aged", "concentration", "eligible", "advanced", "after_sublimit", "after_reserves", "base", "availability", "overadvance")] == [1300, 200, 300, 100, 700, 560, 500, 450, 425, -25, 25]
    after = [r.after for r in b.waterfall(b.ar_base(rec, usage, AR, ["facility_id"]), ["facility_id"]).orderBy("sequence").collect()]
    assert after == [1100, 800, 700, 560, 500, 450, 425, -25]


def collateral_fixture(spark):
    rows = [("r1", "AR", 110, True, 100, "a"), ("r2", "AR", 110, True, 100, "a"), ("r3", "AR", 110, True, 100, "b"), ("i", "inventory", 500, True, 300, None), ("e", "equipment", 250, True, 200, None), ("c", "cash", 50, True, 50, None)]
    col = spark.createDataFrame([("F", *r[:2], D(r[2]), r[3], D(r[4]), r[5]) for r in rows], "facility_id string, record_id string, collateral_class string, gross_value decimal(20,2), eligible boolean, basis_value decimal(20,2), concentration_group string")
    pct = lambda rate, basis="contribution": {"kind": "percentage", "basis": basis, "rate": rate}
    policy = b.Policy(
        [b.Component("AR", "0.85", None, [("150", "0.5"), (None, "0.4")]), b.Component("inventory", "0.5", "140"), b.Component("equipment", "0.4"), b.Component("cash", "1")],
        [("fixed", {"kind": "fixed", "amount": "10"}), ("pct", pct("0.02")), ("above", {"kind": "amount_above", "basis": "AR_eligible", "threshold": "200", "rate": "0.1"})],
        "500",
        [("low", "excess", "50", "20"), ("dominion", "utilisation", "0.75", "0")],
    )
    return col, spark.createDataFrame([("F", D(400))], "facility_id string, amount decimal(20,2)"), policy


def test_multi_component_base(spark):
    col, usage, policy = collateral_fixture(spark)
    parts = b.component_base(col, policy, ["facility_id"])
    assert {r.collateral_class: r.contribution for r in parts.collect()} == {"AR": 187, "inventory": 140, "equipment": 80, "cash": 50}
    state = b.facility_state(parts, usage, policy, ["facility_id"]).first()
    assert (state.contribution, state.reserves, state.blocks, state.capacity, state.excess) == (457, D("21.14"), 20, D("415.86"), D("15.86"))
    assert state.triggers == "low,dominion"
    assert b.collateral_violations(col, ["AR", "inventory", "equipment", "cash"]).count() == 0


def test_scenarios_in_one_job(spark):
    col, usage, policy = collateral_fixture(spark)
    sc = spark.createDataFrame([("base", "AR", "1"), ("down", "AR", "0.5")], "scenario_id string, collateral_class string, value_multiplier string")
    scope = ["scenario_id", "facility_id"]
    out = b.component_base(b.scenario_collateral(col, sc), policy, scope).where("collateral_class = 'AR'").collect()
    assert {r.scenario_id: r.contribution for r in out} == {"base": 187, "down": D("106.25")}  # 100 <= 150, so the first tier holds


def test_covenants_ticklers_cash(spark):
    t = spark.createDataFrame([("gte", D("1.2"), D("1.1")), ("lte", D("4.25"), D("4"))], "comparator string, actual decimal(10,2), threshold decimal(10,2)")
    assert [(r.headroom, r.status) for r in b.covenants(t).collect()] == [(D("0.10"), "pass"), (D("-0.25"), "breach")]
    items = spark.createDataFrame([(day("2026-07-10"), None, False), (day("2026-06-01"), None, False), (day("2026-06-01"), None, True), (day("2027-01-01"), None, False)], "due_date date, completed_on date, waived boolean")
    assert [r.status for r in b.ticklers(items, F.lit("2026-06-30").cast("date")).collect()] == ["due_soon", "overdue", "waived", "current"]
    cash = lambda *kinds: spark.createDataFrame([("F", k, D(a)) for k, a in kinds], "facility_id string, kind string, amount decimal(20,2)")
    good = b.reconcile_cash(cash(("opening", 500), ("receipt", 100), ("application", 100), ("paydown", 100), ("reported", 400)), ["facility_id"]).first()
    bad = b.reconcile_cash(cash(("opening", 500), ("receipt", 100), ("application", 100), ("reported", 410)), ["facility_id"]).first()
    assert good.passed and bad.breaks.count(",") == 1


def test_mapping_executes_rules(spark):
    raw = spark.createDataFrame([(1, "L-1", "12345", "01/31/2026", "1"), (2, "L-2", "5", "02/30/2026", "1")], "row int, loan_no string, balance_cents string, report_date string, grade string")
    src = lambda c: {"op": "source", "column": c}
    rules = [
        mapping.Rule("loan", "loan_id", src("loan_no")),
        mapping.Rule("balance", "balance", {"op": "scale_decimal", "input": src("balance_cents"), "factor": "0.01", "places": 2}),
        mapping.Rule("as-of", "as_of_date", {"op": "parse_date", "input": src("report_date"), "formats": ["YYYY-MM-DD", "MM/DD/YYYY"]}),
        mapping.Rule("grade", "rating", {"op": "code_map", "input": src("grade"), "values": {"1": "A"}}),
        mapping.Rule("label", "label", {"op": "combine", "inputs": [src("loan_no"), src("grade")], "separator": " / "}),
    ]
    records, rejected = mapping.execute_mapping(raw, rules, "row")
    r = records.first()
    assert (r.loan_id, r.balance, r.as_of_date, r.rating, r.label) == ("L-1", D("123.45"), day("2026-01-31"), "A", "L-1 / 1")
    assert [tuple(x) for x in rejected.collect()] == [(2, "as-of")]
    with pytest.raises(Exception, match="rule grade failed"):
        mapping.execute_mapping(raw.withColumn("grade", F.lit("9")), [mapping.Rule("grade", "g", rules[3].expression, "fail_application")], "row")[0].collect()


def test_hmac_equals_the_standard_one(spark):
    import hashlib
    import hmac

    for key in (b"k", b"long" * 40):
        got = spark.range(1).select(mapping.hmac_sha256(key, F.lit("message é"))).first()[0]
        assert got == hmac.new(key, "message é".encode(), hashlib.sha256).hexdigest()


def test_quality_v2_and_segments(spark):
    df = spark.createDataFrame([("L1", D(100), D(80), D(20), "current"), ("L1", D(500), D(400), D(50), "unknown")], "loan_id string, current_balance decimal(20,2), principal decimal(20,2), interest decimal(20,2), status string")
    rules = [quality.Rule("unique", "unique", "loan_id", blocks=True), quality.Rule("status", "allowed_values", "status", values=["current"]), quality.Rule("sum", "equals_sum", "current_balance", parts=["principal", "interest"])]
    got = {r.rule_id: r for r in quality.run_quality_v2(df, rules, "current_balance", "250").collect()}
    assert got["unique"].affected_balance == 600 and got["unique"].affected_share == 1 and got["unique"].material and got["unique"].outcome == "block"
    assert got["sum"].affected_rows == 1 and got["status"].outcome == "warn"
    seg = "facility_id string, currency string, balance decimal(20,3)"
    a = spark.createDataFrame([("F1", "USD", D("300.03")), ("F2", "CAD", D("49.99"))], seg)
    e = spark.createDataFrame([("F1", "USD", D("300.03")), ("F2", "CAD", D("50"))], seg)
    assert {r.facility_id: r.passed for r in quality.reconcile_segments(a, e, ["facility_id"]).collect()} == {"F1": True, "F2": False}


def test_empty_snapshot_and_duplicates(spark):
    p = quality.Profile(keys=["loan_id"], as_of="2026-01-31", null_rates={"loan_id": 0.5})
    empty = spark.createDataFrame([], "loan_id string, as_of_date string, outstanding_balance string, currency string")
    assert {r.code for r in quality.run_quality(empty, p).collect()} == {"empty_snapshot", "null_rate_exceeded"}
    twice = spark.createDataFrame([("a", "2026-01-31", "5", "USD")] * 3 + [("b", "2026-01-31", "5", "USD")], empty.schema)
    found = {r.code: r for r in quality.run_quality(twice, p).collect()}
    assert found["duplicate_grain_key"].affected_rows == 3 and found["duplicate_grain_key"].affected_balance == 0


def test_monitor_change_uses_the_size_of_the_prior(spark):
    df = spark.createDataFrame([(1, "s", D(-10)), (2, "s", D(-5)), (3, "s", D(0)), (4, "s", D(7))], "t int, k string, v decimal(10,2)")
    got = [r.c for r in df.select("t", monitor.change(F.col("v"), ["k"], ["t"], 1, True).alias("c")).orderBy("t").collect()]
    assert got[0] is None and got[1] == D("0.5") and got[2] == 1 and got[3] is None


def test_monitor_v1_outcomes(spark):
    m = spark.createDataFrame(
        [("availability", "decimal", "lt", D(0), None), ("overadvance", "boolean", "eq", None, True), ("utilisation", "decimal", "gt", D("0.9"), None), ("dso", "decimal", "gt", D(1), None)],
        "metric_id string, type string, op string, bound decimal(10,2), bound_flag boolean",
    ).selectExpr("metric_id as monitor_id", "*", "'s' as snapshot_id", "date'2026-01-31' as as_of_date", "'u' as unit")
    o = spark.createDataFrame([("availability", "decimal", D(-25), None), ("overadvance", "boolean", None, True), ("utilisation", "decimal", D("0.85"), None)], "metric_id string, type string, value decimal(10,2), flag boolean").selectExpr("*", "'s' as snapshot_id", "date'2026-01-31' as as_of_date", "'u' as unit")
    got = {r.metric_id: r.outcome for r in monitor.evaluate_v1(m, o).collect()}
    assert got == {"availability": "alert", "overadvance": "alert", "utilisation": "clear", "dso": "missing_observation"}
    assert {r.outcome for r in monitor.evaluate_v1(m, o, "block").collect()} == {"gate_block"}


def test_case_stream_equals_batch(spark, tmp_path):
    rows = [(k, day(f"2026-01-{d:02d}"), d, float((d * k) % 9)) for k in (1, 2, 5) for d in range(1, 28)]
    df = spark.createDataFrame(rows, "series int, as_of_date date, point_id int, value double")
    batch = sorted(map(tuple, monitor.fold_cases(df, ["series"], 7, 3, 2).collect()))
    df.where("point_id <= 13").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    df.where("point_id > 13").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    import os

    os.utime(next((tmp_path / "in/a").glob("*.parquet")), (1, 1))
    stream = streams.stateful_cases(spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), ["series"], 7, 3, 2)
    got = sorted(map(tuple, streams.run_to_table(stream, f"{tmp_path}/out", f"{tmp_path}/cp").collect()))
    assert got == batch and {r[-1] for r in batch} >= {"triggered", "open", "reset", "clear"}


def test_fx_half_even_and_inverse(spark):
    c = lambda a, r, inv=False: spark.range(1).select(history.convert(F.lit(D(a)), F.lit(D(r)), 2, inv)).first()[0]
    assert c("10.005", "1.234567") == D("12.35") and c("2", "4", True) == D("0.50")


def test_correction_chain(spark):
    schema = "d string, manifest_id string, content_hash string, sequence int, corrects_id string, corrects_hash string, known_at date"
    good = [("d", "m0", "h0", 0, None, None, day("2026-01-01")), ("d", "m1", "h1", 1, "m0", "h0", day("2026-01-05")), ("d", "m2", "h2", 2, "m1", "h1", day("2026-02-01"))]
    df = spark.createDataFrame(good, schema)
    at_ = lambda d: [r.manifest_id for r in history.terminal_revisions(df, F.lit(d).cast("date"), ["d"]).collect()]
    assert at_("2026-01-03") == ["m0"] and at_("2026-01-31") == ["m1"] and at_("2026-03-01") == ["m2"]
    assert history.chain_violations(df, ["d"]).count() == 0
    fork = spark.createDataFrame([*good, ("d", "mx", "hx", 1, "m0", "h0", day("2026-01-06"))], schema)
    assert {r.problem for r in history.chain_violations(fork, ["d"]).collect()} == {"fork", "gap"}


def test_disclosure(spark):
    rel = spark.createDataFrame([("c", "r1", 1, f"L{i}") for i in range(1, 6)], "cell string, release_id string, released_at int, token string")
    ask = lambda *t: disclosure.differencing(spark.createDataFrame([("c", x) for x in t], "cell string, token string"), rel, ["cell"], 3).first().decision
    assert ask("L1", "L2", "L3", "L4", "L5") == "permit" and ask("L1", "L2") == "deny_small_cell"
    assert ask("L1", "L2", "L3", "L4") == "deny_differencing_risk" and ask("L6", "L7", "L8", "L9", "L10") == "permit"


def test_grouped_suppression_needs_exactly_one(spark):
    cell = lambda k, d, n, c: ("g", k, d, n, c)
    cols = "grp string, key string, denominator_population long, numerator_population long, complement_population long"
    run = lambda *rows: {r.key: r.suppressed for r in finalize.suppress_grouped(spark.createDataFrame(list(rows), cols), ["grp"], ["key"], 3).collect()}
    assert run(cell("a", 2, 1, 1), cell("b", 9, 5, 4), cell("c", 9, 4, 5)) == {"a": True, "b": False, "c": True}
    assert run(cell("a", 2, 1, 1), cell("d", 2, 1, 1), cell("c", 9, 4, 5)) == {"a": True, "d": True, "c": False}


def test_sources_fail_closed(spark, tmp_path):
    (tmp_path / "ok.csv").write_text('a,b\n"x, ""y""",1.10\n,2\n')
    assert [tuple(r) for r in tapes.read_csv(spark, str(tmp_path / "ok.csv"), ["a", "b"]).collect()] == [('x, "y"', "1.10"), (None, "2")]
    (tmp_path / "short.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        tapes.read_csv(spark, str(tmp_path / "short.csv"), ["a", "b"]).collect()
    (tmp_path / "a.json").write_text('[{"a": "1.10", "b": 2}, {"a": null, "b": true}]')
    assert [tuple(r) for r in tapes.read_json_array(spark, str(tmp_path / "a.json"), ["a", "b"]).collect()] == [("1.10", "2"), (None, "true")]
    (tmp_path / "bad.json").write_text('[{"a": 1.10}]')
    with pytest.raises(Exception, match="only text"):
        tapes.read_json_array(spark, str(tmp_path / "bad.json"), ["a"]).collect()
    (tmp_path / "x.ndjson").write_text('{"a": "1"}\n\n{"b": "2"}\n')
    assert tapes.read_ndjson(spark, str(tmp_path / "x.ndjson"), ["a", "b"]).count() == 2
    assert [r.column for r in tapes.ragged_columns(spark, str(tmp_path / "x.ndjson")).collect()] == ["a", "b"]
    with pytest.raises(ValueError):
        tapes.snapshot_query("t; drop", ["a"], [], ("a", "1"), [("a", "asc", "last")], 5)


def test_worksheet_rules(spark):
    cells = [("f", "S", 1, 1, "text", "id"), ("f", "S", 1, 2, "text", "v"), ("f", "S", 2, 1, "text", "1"), ("f", "S", 2, 2, "number", "5"), ("f", "S", 3, 1, "text", " ")]
    schema = "file string, sheet string, row int, col int, kind string, value string"
    run = lambda c: [tuple(r) for r in tapes.worksheet_rows(spark.createDataFrame(c, schema), "S", 1, ["id", "v"]).collect()]
    assert run(cells) == [("f", 2, "1", "5")]
    for bad, message in (([*cells, ("f", "S", 4, 1, "text", "2")], "blank row"), ([*cells, ("f", "S", 2, 1, "formula", "=A1")], "formulas"), ([("f", "S", 1, 1, "text", "other"), *cells[1:]], "header")):
        with pytest.raises(Exception, match=message):
            run(bad)


def test_snapshot_sink_checks_the_hash(spark, tmp_path):
    df = spark.createDataFrame([(1, "2026-01-31"), (2, "2026-02-28")], "id int, as_of_date string")
    stamp = tapes.content_hash(df).first().content_hash
    assert stamp == tapes.content_hash(df.repartition(3).orderBy(F.desc("id"))).first().content_hash
    with pytest.raises(ValueError):
        tapes.write_snapshot(df, f"{tmp_path}/s", "d", "0" * 64)
    assert tapes.write_snapshot(df, f"{tmp_path}/s", "d", stamp).first().rows == 2
