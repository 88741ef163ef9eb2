"""What the survey's sources say of monitors, levers, rates, names and sinks, on tiny tables."""

import datetime as dt
import itertools
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import mapping
from ledgerloom.functions.scalars import infer_temporal, infer_unit
from ledgerloom.operators import borrowing as b
from ledgerloom.operators import history, matching, monitor, quality, staged, surveillance
from ledgerloom.sources import tapes
from ledgerloom.streaming import streams


def day(text):
    return dt.date.fromisoformat(text)


def series(spark, rows):
    return spark.createDataFrame([(k, day(d), i, v) for i, (k, d, v) in enumerate(rows)], "series string, as_of_date date, point_id int, value double")


def on():
    return F.lit("2026-03-31").cast("date")


LIMIT = {"type": "absolute", "op": "gte", "bound": 10, "reset": 6}


def outcomes(spark, points, tree=LIMIT, scopes=None, **more):
    names = sorted({p[0] for p in points})
    scopes = scopes or [(n, False, None) for n in names]
    df = spark.createDataFrame([(n, o, day(t) if t else None) for n, o, t in scopes], "series string, case_open boolean, last_triggered date")
    return {r.series: (r.outcome, r.reason) for r in monitor.evaluate_v2(df, series(spark, points), tree, ["series"], on(), 40, **more).collect()}


def test_monitor_missing_stale_and_short_history_follow_the_policy(spark):
    points = [("stale", "2026-01-01", 50.0), ("null", "2026-03-31", None), ("late", "2026-04-30", 50.0), ("hit", "2026-03-31", 10.0)]
    for policy, want in (("alert", "missing"), ("block", "blocked"), ("clear", "clear")):
        got = outcomes(spark, points, missing=policy, scopes=[(n, False, None) for n in ("stale", "null", "late", "hit", "none")])
        assert got == {"stale": (want, "stale_observation"), "null": (want, "insufficient_history"), "late": (want, "missing_observation"), "none": (want, "missing_observation"), "hit": ("triggered", "condition_triggered")}


def test_monitor_cooldown_hysteresis_and_effective_days(spark):
    points = [("a", "2026-03-31", 12.0), ("b", "2026-03-31", 12.0), ("c", "2026-03-31", 7.0), ("d", "2026-03-31", 5.0), ("e", "2026-03-31", 7.0)]
    scopes = [("a", True, "2026-03-30"), ("b", True, "2026-03-01"), ("c", True, "2026-03-01"), ("d", True, None), ("e", False, None)]
    got = outcomes(spark, points, scopes=scopes, cooldown_days=5)
    assert got == {"a": ("cooldown", "cooldown_active"), "b": ("triggered", "condition_triggered"), "c": ("clear", "hysteresis_not_reset"), "d": ("reset", "condition_clear"), "e": ("clear", "condition_clear")}
    assert set(outcomes(spark, points, effective=("2026-04-01", None)).values()) == {("refused", "not_effective")}
    assert set(outcomes(spark, points, effective=("2026-01-01", "2026-03-31"))) == set("abcde")


def test_compound_and_consecutive_conditions(spark):
    points = [("a", "2026-02-28", 8.0), ("a", "2026-03-31", 12.0), ("b", "2026-03-31", 12.0)]
    rise = {"type": "change", "op": "gte", "bound": 50, "mode": "percent"}
    assert outcomes(spark, points, {"type": "all", "conditions": [LIMIT, rise]}) == {"a": ("triggered", "condition_triggered"), "b": ("missing", "insufficient_history")}
    assert outcomes(spark, points, {"type": "any", "conditions": [LIMIT, rise]})["b"] == ("missing", "insufficient_history")
    twice = {"type": "consecutive", "periods": 2, "condition": LIMIT}
    assert outcomes(spark, points, twice) == {"a": ("clear", "condition_clear"), "b": ("missing", "insufficient_history")}


def test_cooldown_counts_from_the_last_trigger_in_open_cases_too(spark):
    values = [12, 13, 14, 8, 5, 12, 12]
    rows = series(spark, [("a", f"2026-01-{i + 1:02d}", float(v)) for i, v in enumerate(values)])
    got = [r.transition for r in monitor.fold_cases(rows, ["series"], 10, 6, 2).orderBy("as_of_date").collect()]
    assert got == ["triggered", "cooldown", "triggered", "open", "reset", "triggered", "cooldown"]


def test_case_log_against_a_plain_fold(spark):
    names = ["open", "acknowledged", "escalated", "resolved", "suppressed"]
    logs = {i: list(p) for i, p in enumerate(itertools.product([*names, None], repeat=3))}
    rows = [(k, n, "manual" if s else "occurrence", s or "open") for k, p in logs.items() for n, s in enumerate([None, *p])]
    rows.append((-1, 0, "manual", "acknowledged"))
    want = {-1: (None, 1, 0, 1)}
    for k, p in logs.items():
        status, bad, again = "open", 0, 0
        for s in p:
            if s is None:
                again += status == "resolved"
                status = "open" if status == "resolved" else status
            elif status in monitor.ALLOWED[s]:
                status = s
            else:
                bad += 1
        want[k] = (status, bad, again, 4)
    log = spark.createDataFrame(rows, "case_id int, seq int, kind string, status string")
    assert {r.case_id: (r.status, r.invalid, r.reopened, r.events) for r in monitor.case_status(log).collect()} == want


def lever_fixture(spark):
    col = spark.createDataFrame([("F", "r1", "AR", D(100), True, D(100), None), ("F", "r2", "inv", D(80), True, D(60), None)], "facility_id string, record_id string, collateral_class string, gross_value decimal(20,2), eligible boolean, basis_value decimal(20,2), concentration_group string")
    policy = b.Policy([b.Component("AR", "0.8"), b.Component("inv", "0.5", "20")], [("r", {"kind": "fixed", "amount": "10"})], "500", [("over", "overadvance", "5", "cash_dominion"), ("low", "excess", "1", "3")])
    return col, spark.createDataFrame([("F", D(100))], "facility_id string, amount decimal(20,2)"), policy


def test_adjustments_and_triggers(spark):
    col, usage, policy = lever_fixture(spark)
    plain = b.facility_state(b.component_base(col, policy, ["facility_id"]), usage, policy, ["facility_id"]).first()
    assert (plain.contribution, plain.capacity_before_blocks, plain.triggers, plain.cash_dominion, plain.blocks, plain.capacity) == (100, 90, "over,low", True, 3, 87)
    rows = [("advance_rate_override", "AR", "0.9", "2026-01-01", None), ("component_sublimit_waiver", "inv", None, "2026-01-01", "2026-03-31"), ("reserve_override", "r", "4", "2026-01-01", None), ("availability_block", None, "1", "2026-01-01", None), ("availability_block", None, "2", "2026-01-01", None), ("reserve_waiver", "r", None, "2026-04-01", None)]
    made = lambda rows: spark.createDataFrame([("F", k, t, v, day(a), day(z) if z else None) for k, t, v, a, z in rows], "facility_id string, kind string, target string, value string, effective_from date, effective_to date")
    classes, scopes = b.adjustment_levers(made(rows), on(), policy, ["facility_id"])
    state = b.facility_state(b.component_base(col, policy, ["facility_id"], classes), usage, policy, ["facility_id"], scopes).first()
    assert (state.contribution, state.reserves, state.capacity_before_blocks, state.blocks, state.capacity, state.cash_dominion) == (120, 4, 116, 3, 113, False)
    twice = made([*rows, ("reserve_waiver", "r", None, "2026-01-01", None)])
    assert b.active_conflicts(twice, on(), ["facility_id"]).count() == 1
    with pytest.raises(Exception, match="several active adjustments"):
        b.adjustment_levers(twice, on(), policy, ["facility_id"])[1].collect()


def test_scenario_levers_beside_the_baseline(spark):
    col, usage, policy = lever_fixture(spark)
    scenarios = spark.createDataFrame([("same", "0", None), ("all", "5", "70")], "scenario_id string, reserve_delta string, commitment_override string")
    assumed = spark.createDataFrame([("all", "AR", "0.5", "1.25"), ("all", "inv", None, "0.5")], "scenario_id string, collateral_class string, value_multiplier string, rate_multiplier string")
    got = {r.scenario_id: r for r in b.run_scenarios(col, usage, policy, ["facility_id"], scenarios, assumed).collect()}
    assert got["same"].capacity == 87 and got["same"].capacity_change == 0
    assert (got["all"].AR_gross, got["all"].contribution, got["all"].reserves, got["all"].capacity, got["all"].contribution_change) == (100, 65, 15, 47, -35)
    with pytest.raises(Exception, match="exceeds 1"):
        b.run_scenarios(col, usage, policy, ["facility_id"], scenarios, assumed.withColumn("rate_multiplier", F.lit("3"))).collect()


def test_submitted_certificates(spark):
    rows = [(1, 100, 10, 5, 65, 60, 5), (2, 100, 10, 5, 66, 60, 6), (3, 100, 10, 5, 65, 70, -4), (4, 10, 50, 5, 0, 3, -3)]
    df = spark.createDataFrame([(i, *map(D, x)) for i, *x in rows], "id int, contribution decimal(20,2), reserves decimal(20,2), blocks decimal(20,2), capacity decimal(20,2), usage decimal(20,2), excess decimal(20,2)")
    got = {r.id: (r.capacity_ties, r.excess_ties, r.overadvance) for r in b.submitted_states(df, "70").collect()}
    assert got == {1: (True, True, 0), 2: (False, True, 0), 3: (True, False, 4), 4: (True, True, 3)}


def test_rates_as_of_against_brute_force(spark):
    import random

    rng = random.Random(1)
    days = [day("2026-01-01") + dt.timedelta(i) for i in range(40)]
    quotes = [(rng.choice("AB"), rng.choice(days), rng.choice(days), rng.randrange(9), f"h{i:03d}") for i in range(60)]
    rows = [(i, rng.choice(["A", "B", "C", None]), rng.choice(days), rng.choice(days)) for i in range(200)]
    got = history.rates_as_of(spark.createDataFrame(rows, "id int, currency string, as_of_date date, known_at date"), spark.createDataFrame(quotes, "base string, effective_on date, received_at date, rate int, rate_hash string")).collect()
    for r in got:
        seen = [(e, k, h, v) for c, e, k, v, h in quotes if c == r.currency and e <= r.as_of_date and k <= r.known_at]
        assert (r.effective_on, r.rate) == ((max(seen)[0], max(seen)[3]) if seen else (None, None))
    assert len(got) == 200


def test_names_and_types(spark):
    rows = [("d", "CurrentBalance", "decimal(18,2)"), ("d", "% advance", "int"), ("d", "Loan No.", "varchar"), ("d", "acct amt", "date"), ("d", "zzz", "int"), ("d", "As-of Date", "timestamp"), ("d", "spread", "blob")]
    got = {r.column_name: r for r in matching.suggest(spark.createDataFrame(rows, "dataset string, column_name string, native_type string"), profile="base").where("rank = 1").collect()}
    assert (got["CurrentBalance"].target, got["CurrentBalance"].score) == ("outstanding_balance", 0.98)
    assert (got["As-of Date"].target, got["As-of Date"].type_fit, got["As-of Date"].score) == ("as_of_date", "compatible", 0.98)
    assert got["Loan No."].target == "loan_id" and got["spread"].score == 0.86 and "zzz" not in got
    assert got["% advance"].target == "advance_rate" and got["% advance"].type_fit == "compatible"
    field = lambda n: spark.range(1).select(infer_unit(F.lit(n)), infer_temporal(F.lit(n))).first()
    assert [tuple(field(n)) for n in ("RATE_AMOUNT", "default_date", "lifetime_loss", "x_no", "payment_date")] == [("currency", "unknown"), ("date", "event"), ("unknown", "lifetime_to_date"), ("identifier", "unknown"), ("date", "flow")]


def test_repeated_dimension_keys_end_the_mapping(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row int, code string")
    rule = [mapping.Rule("r", "grade", {"op": "dimension_lookup", "definition": "g", "input": {"op": "source", "column": "code"}, "missing": "null"}, "reject_row")]
    good = spark.createDataFrame([("a", "A")], "key string, value string")
    records, _ = mapping.execute_mapping(rows, rule, "row", {"g": good})
    assert {r.row: r.grade for r in records.collect()} == {1: "A", 2: None}
    with pytest.raises(Exception, match="repeats key"):
        mapping.execute_mapping(rows, rule, "row", {"g": good.union(good)})[0].collect()


def test_jdbc_snapshot_from_an_embedded_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(20).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("v"), "id").alias("V")).write.format("jdbc").option("url", url).option("dbtable", "LOANS").options(**driver).save()
    whole = tapes.read_jdbc(spark, url, 'SELECT "ID", "V" FROM LOANS WHERE "ID" <= 9', options=driver)
    assert sorted(r.ID for r in whole.collect()) == list(range(10))
    parts = tapes.read_jdbc(spark, url, 'SELECT "ID", "V" FROM LOANS', split=("ID", 0, 20, 4), options=driver)
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 20
    sql = tapes.attestation_query("loans", ["id", "v"], ("seen_at", "2026-01-01'"))
    assert "octet_length(CAST(to_json(ROW(id, v)) AS TEXT))" in sql and sql.endswith("WHERE seen_at <= '2026-01-01'''")
    with pytest.raises(ValueError):
        tapes.attestation_query("loans; drop", ["id"], ("a", "1"))


def test_parquet_with_declared_rows(spark, tmp_path):
    spark.range(7).write.parquet(f"{tmp_path}/p")
    assert tapes.read_parquet(spark, f"{tmp_path}/p", declared_rows=7).count() == 7
    with pytest.raises(ValueError, match="8 rows declared"):
        tapes.read_parquet(spark, f"{tmp_path}/p", declared_rows=8)


def test_content_hash_sees_every_cell(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", "c")], "i int, x string, y string")
    stamp = lambda d: tuple(tapes.content_hash(d).first())
    assert stamp(df) == stamp(df.orderBy(F.desc("i")))
    assert len({stamp(df), stamp(df.withColumn("y", F.lit("c"))), stamp(df.union(df)), stamp(df.fillna("")), stamp(df.withColumnRenamed("y", "z")), stamp(df.withColumn("i", F.col("i").cast("long")))}) == 6


def test_fingerprint_does_not_depend_on_order(spark):
    df = spark.createDataFrame([("a", "2026-01-31", "5"), ("b", "2026-01-31", "x")], "loan_id string, as_of_date string, outstanding_balance string")
    p = quality.Profile(keys=["loan_id"], decimals=["outstanding_balance"], as_of="2026-01-31")
    of = lambda d, name="p1": quality.fingerprint(d, quality.run_quality(d, p), name).first()[0]
    assert of(df) == of(df.orderBy(F.desc("loan_id")).repartition(3)) != of(df.limit(1)) and of(df) != of(df, "p2")


def test_staged_run_stops_at_its_gate_and_goes_on_where_it_broke_off(spark, tmp_path):
    ran = []

    def stage(name, df, gate=None):
        return staged.Stage(name, lambda t: ran.append(name) or df, gate)

    one = spark.range(3)
    stages = [stage("profile", one), stage("certify", one, "id < 2"), stage("report", one)]
    assert [tuple(r) for r in staged.run_stages(spark, f"{tmp_path}/a", stages).collect()] == [("profile", "done", 3), ("certify", "blocked", 3), ("report", "skipped", None)]

    def breaks(_):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        staged.run_stages(spark, f"{tmp_path}/b", [stages[0], staged.Stage("map", breaks), stages[2]])
    ran.clear()
    assert {r.status for r in staged.run_stages(spark, f"{tmp_path}/b", [stages[0], stage("map", one), stages[2]]).collect()} == {"done"}
    assert ran == ["map", "report"]


def test_a_repeated_batch_of_deliveries_changes_nothing(spark, tmp_path):
    schema = "id int, as_of_date string, mode string"
    batches = [[(1, "d1", "full"), (2, "d2", "full")], [(3, "d1", "delta"), (4, "d1", "correction")], [(5, "d2", "backfill")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        streams.delivery_sink(streams.file_stream(spark, f"{tmp_path}/in", spark.createDataFrame(rows, schema).schema), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    now = lambda: sorted((r.id, r.as_of_date) for r in streams.read_deliveries(spark, f"{tmp_path}/out").collect())
    assert now() == [(1, "d1"), (3, "d1"), (5, "d2")]
    spark.createDataFrame(batches[1], schema).write.mode("overwrite").partitionBy("mode", "as_of_date").parquet(f"{tmp_path}/out/batch=1")
    assert now() == [(1, "d1"), (3, "d1"), (5, "d2")] and [r.id for r in streams.read_corrections(spark, f"{tmp_path}/out").collect()] == [4]


def test_metric_pack_definitions(spark, sf):
    from ledgerloom.plans.portfolio import NOT_EURO, PACK
    from ledgerloom.plans.tape import tape

    rows = tape(spark, sf).cache()
    cells = surveillance.run_pack(rows, PACK[:2]).collect()
    want = surveillance.default_incidence(surveillance.with_index(rows.where("currency <> 'EUR' and as_of_date > '1999-09-30'"))).collect()
    assert sorted(r.value for r in cells if r.metric == "default_incidence") == pytest.approx(sorted(r.value for r in want))
    with pytest.raises(Exception, match="more than 1 cells"):
        surveillance.run_pack(rows, [{"id": "x", "metric": "default_incidence", "filter": NOT_EURO, "most_cells": 1}]).collect()
    rows.unpersist()


def test_strict_analyses_refuse_what_conflicts_list(spark):
    import datetime
    from decimal import Decimal

    from ledgerloom.operators.stratification import balance_conflicts, stratify
    from ledgerloom.operators.vintage import conflicts, refused

    day, old = datetime.date(2024, 1, 31), datetime.date(2023, 1, 1)
    row = lambda key, at=day, b=5, o=9, start=old: (key, at, None if b is None else Decimal(b), Decimal(o), start)
    df = lambda *rows: spark.createDataFrame(list(rows), "loan_id string, as_of_date date, outstanding_balance decimal(20,2), original_balance decimal(20,2), origination_date date")
    good = df(row("a"), row("a"), row("b"), row("a", datetime.date(2024, 2, 29), 4))
    assert refused(good, ["loan_id"]).count() == 4 and conflicts(good, ["loan_id"]).isEmpty()
    assert stratify(good, F.col("loan_id"), strict=True).count() == 3
    for bad in (df(row("a"), row("a", b=6)), df(row("a"), row("a", datetime.date(2024, 2, 29), o=8)), df(row("a"), row("a", datetime.date(2024, 2, 29), start=day))):
        assert conflicts(bad, ["loan_id"]).count() == 1
        with pytest.raises(Exception, match="a loan"):
            refused(bad, ["loan_id"]).collect()
    empty = df(row("a", b=None))
    assert balance_conflicts(empty).count() == 1
    with pytest.raises(Exception, match="is required"):
        stratify(empty, F.col("loan_id"), strict=True).collect()
