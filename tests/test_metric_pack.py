"""The metric pack on small tapes: every reason, hidden cells, hashes, refusals and one scan."""

import datetime
from decimal import Decimal

import pytest

from ledgerloom.functions.scalars import Bin
from ledgerloom.operators.metric_pack import Definition, contributions, run_pack

D1, D2, D3 = (datetime.date(2024, m, 28) for m in (1, 2, 3))
FIELDS = "as_of_date date, source_system string, facility_id string, loan_id string, borrower_id string, outstanding_balance decimal(20,2), original_balance decimal(20,2), commitment_amount decimal(20,2), days_past_due int, default_flag boolean, charge_off_amount decimal(20,2), recovery_amount decimal(20,2), scheduled_principal_amount decimal(20,2), risk_rating string, industry_code string, maturity_date date, default_date date, origination_date date, entity string"


def loan(day, key, balance=100, dpd=0, default=False, loss=0, rec=0, plan=0, rating="A", industry="X", maturity=datetime.date(2025, 1, 1), defaulted=None, borrower="b", source="s", entity=None):
    amount = lambda x: None if x is None else Decimal(x)
    return (day, source, None, key, borrower, amount(balance), Decimal(200), Decimal(400), dpd, default, amount(loss), amount(rec), amount(plan), rating, industry, maturity, defaulted, datetime.date(2020, 5, 5), entity)


@pytest.fixture(scope="module")
def tape(spark):
    rows = [loan(D1, f"l{i}", rating="AB"[i % 2], industry="XYZ"[i % 3]) for i in range(12)]
    rows += [loan(D2, f"l{i}", balance=90, dpd=45 if i < 3 else 0, default=i == 0, rating="AB"[i < 2], industry="XYZ"[i % 3], loss=10 if i == 0 else 0, rec=4 if i == 1 else 0, defaulted=D1 if i == 1 else None, plan=7) for i in range(10)]
    rows += [loan(D3, f"l{i}", balance=None if i == 5 else 80, dpd=None if i == 6 else 0, industry="XYZ"[(i + 1) % 3] if i == 9 else "XYZ"[i % 3]) for i in range(9, -1, -1)]
    return spark.createDataFrame(rows, FIELDS).repartition(3)


def cells(tape, *definitions):
    return {(r.definition_id, r.metric, r.dimensions): r for r in run_pack(tape, list(definitions)).collect()}


def one(found, metric, *words):
    hits = [r for (_, m, d), r in found.items() if m == metric and all(w in d for w in words)]
    assert len(hits) == 1, [d for _, m, d in found if m == metric]
    return hits[0]


def test_figures_and_reasons(tape):
    found = cells(
        tape,
        Definition("d", "default_ever", {"thresholds": [30]}, least_cell=1),
        Definition("l", "loss_recovery", {}, least_cell=1),
        Definition("p", "paydown_prepayment", {}, least_cell=1),
        Definition("c", "period_comparison", {"field": "industry_code"}, least_cell=1),
        Definition("r", "rating_migration", {}, least_cell=1),
        Definition("one", "roll_cure", {"bins": [Bin("ok", 0, 30), Bin("late", 30, None)]}, latest=1),
        Definition("b", "concentration", {"field": "borrower_id"}),
    )
    assert one(found, "default_incidence", '{"current_as_of_date":"2024-01-28"}').availability == "no_prior_period"
    first = one(found, "default_incidence", "2024-02-28", "previous_as_of_date\":\"2024-01")
    assert (first.numerator, first.denominator, first.eligible_count, first.observed_count, first.availability) == (1, 10, 12, 10, "available")
    third = one(found, "ever_dpd_incidence", "2024-03-28")
    assert (third.numerator, third.denominator, third.eligible_count) == (3, 8, 10)  # an unknown balance or day leaves a loan out
    assert one(found, "recovery_lag_days", "2024-01").availability == "no_records"
    assert one(found, "recovery_lag_days", "2024-02").value == 31
    assert one(found, "gross_loss_rate", "2024-02").value == pytest.approx(10 / 900)
    paid = one(found, "paydown_rate", "2024-02-28", "2024-01-28")
    assert (paid.numerator, paid.denominator) == (10 * 10 + 2 * 100, 1200)
    assert one(found, "prepayment_rate", "2024-02-28", "2024-01-28").availability == "missing_required_field"
    new = one(found, "period_driver_amount", "new_exposure", "2024-03-28", '"X"')
    assert new.value == 0 and one(found, "period_driver_amount", "new_exposure", "2024-03-28", '"Y"').value == 80
    assert one(found, "portfolio_change_amount", "2024-03-28", '"Y"').availability == "available"
    assert one(found, "transition_share").availability == "no_prior_period"
    assert one(found, "concentration_share").availability == "entity_resolution_unapproved"
    move = one(found, "rating_transition_share", '"current_as_of_date":"2024-02-28', '"from_rating":"A"', '"to_rating":"B"')
    assert (move.numerator, move.denominator) == (100, 500)
    assert one(found, "rating_transition_share", '"current_as_of_date":"2024-02-28', '"from_rating":"B"', '"to_rating":"B"').numerator == 100


def test_one_hidden_cell_takes_another_with_it(tape):
    wall = Definition("m", "maturity_wall", {"windows": [("12", 12)], "matured": True}, least_cell=3)
    shares = Definition("i", "concentration", {"field": "industry_code", "top": 2}, least_cell=4)
    found = cells(tape, wall, shares)
    march = {r.dimensions.split('"')[7]: r for (_, m, d), r in found.items() if m == "concentration_share" and "2024-03" in d}
    hidden = {k for k, r in march.items() if r.suppressed}
    assert hidden and len(hidden) >= 2 and all(march[k].value is None and march[k].observed_count is None and march[k].availability == "suppressed" for k in hidden)
    alone = {r.dimensions: r.suppressed for r in run_pack(tape, [Definition("i", "concentration", {"field": "industry_code", "top": 2}, least_cell=4, complementary=False)]).collect() if r.metric == "concentration_share" and "2024-03" in r.dimensions}
    assert sum(alone.values()) <= len(hidden)


def test_resolved_ids_are_tokens_and_coverage_bounds_hold(tape):
    rows = tape.withColumn("entity", tape["industry_code"])
    found = cells(rows, Definition("b", "concentration", {"field": "borrower_id", "resolved": "entity", "tenant": "t"}, least_cell=1), Definition("few", "balance_utilization", {}, least_records=11, least_cell=1))
    assert all('"category":"Entity-' in d for (_, m, d) in found if m == "concentration_share")
    assert one(found, "concentration_hhi", "2024-01").value == pytest.approx(3 * (4 / 12) ** 2)
    assert one(found, "utilization", "2024-01").availability == "available"
    assert one(found, "utilization", "2024-02").availability == "insufficient_coverage"


def test_hashes_don_t_depend_on_partitions(tape):
    d = Definition("r", "rating_migration", {})
    a, b = cells(tape, d), cells(tape.repartition(7), d)
    assert {k: (r.numerator_hash, r.denominator_hash, r.cell_id) for k, r in a.items()} == {k: (r.numerator_hash, r.denominator_hash, r.cell_id) for k, r in b.items()}


def test_refusals(spark, tape):
    with pytest.raises(ValueError, match="identifier"):
        run_pack(tape, [Definition("x", "period_comparison", {"field": "borrower_id"})])
    with pytest.raises(ValueError, match="one version"):
        run_pack(tape, [Definition("x", "maturity_wall", {"windows": []}), Definition("x", "rating_migration")])
    with pytest.raises(ValueError, match="no snapshot"):
        run_pack(tape.where("false"), [Definition("x", "rating_migration")])
    with pytest.raises(ValueError, match="snapshots"):
        run_pack(tape, [Definition("x", "rating_migration")], most_dates=2)
    with pytest.raises(Exception, match="two rows"):
        run_pack(tape.union(tape.where("loan_id = 'l1'")), [Definition("x", "rating_migration")]).collect()
    with pytest.raises(Exception, match="loan_id is required"):
        run_pack(tape.union(spark.createDataFrame([loan(D1, None)], FIELDS)), [Definition("x", "rating_migration")]).collect()
    with pytest.raises(Exception, match="more cells"):
        run_pack(tape, [Definition("x", "rating_migration", most_cells=2)]).collect()


def test_all_families_are_one_scan_and_two_shuffles(spark, tape, tmp_path):
    tape.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    pack = [Definition("a", "rating_migration"), Definition("b", "default_ever", {"thresholds": [30]}), Definition("c", "loss_recovery"), Definition("d", "period_comparison")]
    plan = contributions(rows, pack, [D1, D2, D3])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_rows_are_not_expanded_into_contributions(spark, tape):
    """One method for all contributions of a row is too long to be compiled, and a wide decimal a digest is slow."""
    rows = contributions(tape, [Definition("c", "period_comparison", {"field": "industry_code"}), Definition("l", "loss_recovery")], [D1, D2, D3])
    assert "Generate" not in rows._jdf.queryExecution().executedPlan().toString()
    assert dict(rows.dtypes)["t0"] == "bigint" and rows.count() == tape.count()
