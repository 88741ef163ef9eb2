"""The surveillance pack: all nine families of metrics over the derived tape, finalised, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.scalars import Bin, definition_hash
from ..operators.metric_pack import METRICS, Definition, run_pack
from .registry import query
from .tape import PERIODS, digest_sums_sql, tape, with_tape

BINS = [Bin("Current", 0, 30), Bin("30-59", 30, 60), Bin("60-89", 60, 90), Bin("90+", 90, 120)]
WINDOWS = [("0-12", 12), ("13-36", 36)]
NOT_EURO = {"op": "neq", "field": "currency", "value": "EUR"}
PACK = [
    Definition("roll", "roll_cure", {"bins": BINS}, least_cell=5),
    Definition("default", "default_ever", {"thresholds": [30, 120]}, population=NOT_EURO, latest=3, least_ratio=0.94),
    Definition("default_weighted", "default_ever", {"basis": "balance", "thresholds": [60]}, null_policy="zero", least_cell=1),
    Definition("loss", "loss_recovery", {"flows": "cumulative"}, least_ratio=0.95, least_cell=20),
    Definition("loss_period", "loss_recovery", {}, null_policy="unavailable", least_cell=3),
    Definition("paydown", "paydown_prepayment", {"scheduled": "scheduled_principal_amount"}, least_records=100),
    Definition("rating", "rating_migration", {}, version=2, population={"op": "in", "field": "industry_code", "values": ["BUILDING", "MACHINERY"]}, latest=2, least_cell=12, most_cells=500),
    Definition("balance", "balance_utilization", {"grain": "year"}, least_cell=30),
    Definition("maturity", "maturity_wall", {"windows": WINDOWS, "matured": False}, least_cell=2),
    Definition("industry", "concentration", {"field": "industry_code", "top": 3}, least_cell=3),
    Definition("borrower", "concentration", {"field": "borrower_id"}),
    Definition("change", "period_comparison", {"field": "industry_code"}, least_cell=4, complementary=False),
    Definition("one_date", "period_comparison", {}, latest=1),
]

_W = "CAST({} AS DECIMAL(38,2))"
_AMT = lambda d, c, side: f"COALESCE({side}.{c}, 0)" if d.null_policy == "zero" else f"{side}.{c}"
_DAYS = "(VALUES " + ", ".join(f"({i}, DATE '{d}')" for i, d in enumerate(PERIODS)) + ")"
_N = len(PERIODS)


def _band(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN 'Unknown' " + " ".join(f"WHEN {c} >= {b.lower} AND {c} < {b.upper} THEN '{b.label}'" for b in BINS) + " ELSE 'Outside' END"


def _rows(k: int, d: Definition) -> list[str]:
    """SQL of the contributions of a definition: (d, m, i, g, s, el, ob, dn, nm, num, den, aux, token)."""
    start, where = max(0, _N - d.latest), "TRUE"
    if d.population:
        where = "currency <> 'EUR'" if d.population is NOT_EURO else "industry_code IN ('BUILDING', 'MACHINERY')"
    mine = f"(SELECT * FROM t WHERE {where} AND period_idx >= {start})"
    key = "a.source_system = b.source_system AND a.facility_id = b.facility_id AND a.loan_id = b.loan_id"
    pairs = f"{mine} a LEFT JOIN {mine} b ON {key} AND b.period_idx = a.period_idx + 1"
    nxt, going = "a.period_idx + 1", f"a.period_idx < {_N - 1}"
    bal, bal_b = _AMT(d, "outstanding_balance", "a"), _AMT(d, "outstanding_balance", "b")

    def row(m: str, i: str, g: str, s: str, el: str, ob: str, dn: str, nm: str, num: str, den: str, frm: str, cond: str, aux: str = "0") -> str:
        flag = lambda c: f"COALESCE({c}, FALSE)"
        return f"SELECT {k} AS d, '{m}' AS m, {i} AS i, {g} AS g, {s} AS s, {flag(el)} AS el, {flag(ob)} AS ob, {flag(dn)} AS dn, {flag(nm)} AS nm, {_W.format(f'COALESCE({num}, 0)')} AS num, {_W.format(f'COALESCE({den}, 0)')} AS den, {_W.format(f'COALESCE({aux}, 0)')} AS aux, a.token FROM {frm} WHERE {cond}"

    nothing = lambda m: row(m, "-1", "''", "''", "TRUE", "FALSE", "TRUE", "FALSE", "0", "0", f"{mine} a", "TRUE")
    if d.family == "roll_cure":
        seen = f"(b.loan_id IS NOT NULL AND a.days_past_due IS NOT NULL AND {bal} IS NOT NULL AND b.days_past_due IS NOT NULL)"
        return [row("transition_share", nxt, _band("a.days_past_due"), f"CASE WHEN {seen} THEN {_band('b.days_past_due')} END", "TRUE", seen, "TRUE", seen, f"CASE WHEN {seen} THEN {bal} END", f"CASE WHEN {seen} THEN {bal} END", pairs, going)]
    if d.family == "default_ever":
        w = "1" if d.get("basis", "count") == "count" else bal
        seen = f"(a.default_flag IS NOT NULL AND {bal} IS NOT NULL AND b.default_flag IS NOT NULL)"
        out = [
            row("default_incidence", str(start), "''", "''", "TRUE", "FALSE", "TRUE", "FALSE", "0", "0", f"{mine} a", f"a.period_idx = {start}"),
            row("default_incidence", nxt, "''", "''", "TRUE", seen, seen, f"{seen} AND b.default_flag", f"CASE WHEN {seen} AND b.default_flag THEN {w} END", f"CASE WHEN {seen} THEN {w} END", pairs, f"{going} AND a.default_flag IS DISTINCT FROM TRUE"),
        ]
        past = f"(SELECT a.*, h.worst, h.gap FROM {mine} a JOIN (SELECT a.period_idx AS p, a.token AS tk, MAX(b.days_past_due) AS worst, BOOL_OR(b.days_past_due IS NULL) AS gap FROM {mine} a JOIN {mine} b ON {key} AND b.period_idx <= a.period_idx GROUP BY 1, 2) h ON h.p = a.period_idx AND h.tk = a.token) a"
        known = f"({bal} IS NOT NULL AND NOT a.gap)"
        return out + [row("ever_dpd_incidence", "a.period_idx", f"'{x}'", "''", "TRUE", known, known, f"{known} AND a.worst >= {x}", f"CASE WHEN {known} AND a.worst >= {x} THEN {w} END", f"CASE WHEN {known} THEN {w} END", past, "TRUE") for x in d.get("thresholds")]
    if d.family == "loss_recovery":
        loss, rec, exposure = "a.loss", "a.rec", _AMT(d, "outstanding_balance", "a")
        flow = lambda c: f"{_AMT(d, c, 'a')} - CASE WHEN b.loan_id IS NULL THEN 0 ELSE {_AMT(d, c, 'b')} END" if d.get("flows") == "cumulative" else _AMT(d, c, "a")
        frm = f"(SELECT a.*, {flow('charge_off_amount')} AS loss, {flow('recovery_amount')} AS rec FROM {mine} a LEFT JOIN {mine} b ON {key} AND b.period_idx = a.period_idx - 1) a"
        gross, net, dated = f"({loss} IS NOT NULL AND {exposure} IS NOT NULL)", f"({loss} IS NOT NULL AND {rec} IS NOT NULL AND {exposure} IS NOT NULL)", f"({rec} > 0 AND a.default_date IS NOT NULL)"
        here = lambda m, el, seen, nm, num, den, aux="0": row(m, "a.period_idx", "''", "''", el, seen, seen, nm, num, den, frm, "TRUE", aux)
        return [
            here("gross_loss_rate", "TRUE", gross, f"{gross} AND {loss} <> 0", loss, f"CASE WHEN {gross} THEN {exposure} END"),
            here("net_loss_rate", "TRUE", net, f"{net} AND {loss} <> {rec}", f"COALESCE({loss}, 0) - COALESCE({rec}, 0)", f"CASE WHEN {net} THEN {exposure} END"),
            here("recovery_amount", "TRUE", f"{rec} IS NOT NULL", f"{rec} <> 0", rec, "0"),
            here("recovery_lag_days", f"{rec} > 0", dated, dated, f"CASE WHEN {dated} THEN {rec} * (a.as_of_date - a.default_date) END", f"CASE WHEN {dated} THEN {rec} END", rec),
        ]
    if d.family == "paydown_prepayment":
        after = f"CASE WHEN b.loan_id IS NULL THEN 0 ELSE {bal_b} END"
        seen, fall = f"({bal} IS NOT NULL AND ({after}) IS NOT NULL)", f"GREATEST({bal} - {after}, 0)"
        known = f"({seen} AND b.scheduled_principal_amount IS NOT NULL)"
        over = f"GREATEST({fall} - b.scheduled_principal_amount, 0)"
        return [
            row("paydown_rate", nxt, "''", "''", "TRUE", seen, seen, f"{seen} AND {fall} > 0", f"CASE WHEN {seen} THEN {fall} END", f"CASE WHEN {seen} THEN {bal} END", pairs, going),
            row("prepayment_rate", nxt, "''", "''", "TRUE", known, known, f"{known} AND {over} > 0", f"CASE WHEN {known} THEN {over} END", f"CASE WHEN {seen} THEN {bal} END", pairs, going),
        ]
    if d.family == "rating_migration":
        seen = f"(b.risk_rating IS NOT NULL AND {bal} IS NOT NULL)"
        return [row("rating_transition_share", nxt, "a.risk_rating", "b.risk_rating", "TRUE", seen, seen, seen, f"CASE WHEN {seen} THEN {bal} END", f"CASE WHEN {seen} THEN {bal} END", pairs, f"{going} AND a.risk_rating IS NOT NULL")]
    if d.family == "balance_utilization":
        seen = "(a.outstanding_balance IS NOT NULL AND a.original_balance IS NOT NULL AND a.commitment_amount IS NOT NULL)"
        return [
            row(m, "a.period_idx", "CAST(CAST(date_trunc('year', a.origination_date) AS DATE) AS VARCHAR)", "''", "TRUE", seen, seen, seen, f"CASE WHEN {seen} THEN a.outstanding_balance END", f"CASE WHEN {seen} THEN {den} END", f"{mine} a", "a.origination_date IS NOT NULL")
            for m, den in (("outstanding_balance", "0"), ("remaining_balance_factor", "a.original_balance"), ("utilization", "a.commitment_amount"))
        ]
    if d.family == "maturity_wall":
        months = "((year(a.maturity_date) - year(a.as_of_date)) * 12 + month(a.maturity_date) - month(a.as_of_date) + CASE WHEN day(a.maturity_date) > day(a.as_of_date) THEN 1 ELSE 0 END)"
        seen = f"(a.maturity_date IS NOT NULL AND {bal} IS NOT NULL AND {months} >= 0)"
        label = "CASE " + " ".join(f"WHEN {months} <= {e} THEN '{w}'" for w, e in WINDOWS) + " ELSE 'Beyond' END"
        return [row("maturity_balance_share", "a.period_idx", "''", f"CASE WHEN {seen} THEN {label} END", "TRUE", seen, seen, seen, f"CASE WHEN {seen} THEN {bal} END", f"CASE WHEN {seen} THEN {bal} END", f"{mine} a", "TRUE")]
    if d.family == "concentration":
        if d.params["field"] == "borrower_id":
            return [row("concentration_share", "-2", "''", "''", "TRUE", "FALSE", "TRUE", "FALSE", "0", "0", f"{mine} a", "TRUE")]
        seen = f"({bal} IS NOT NULL AND a.industry_code IS NOT NULL)"
        return [row("concentration_share", "a.period_idx", "''", f"CASE WHEN {seen} THEN a.industry_code END", "TRUE", seen, seen, seen, f"CASE WHEN {seen} THEN {bal} END", f"CASE WHEN {seen} THEN {bal} END", f"{mine} a", "TRUE")]
    if d.latest == 1:
        return [nothing("portfolio_change_amount")]
    groups = f"(SELECT * FROM {mine} WHERE industry_code IS NOT NULL AND outstanding_balance IS NOT NULL)"
    on = f"{key} AND a.industry_code = b.industry_code"
    out = []
    for m, split, share in (("portfolio_change_amount", False, False), ("portfolio_change_rate", False, True), ("period_driver_amount", True, False), ("period_driver_share", True, True)):
        change = "(COALESCE(b.outstanding_balance, 0) - a.outstanding_balance)"
        driver = f"CASE WHEN b.loan_id IS NULL THEN 'exit' WHEN {change} > 0 THEN 'balance_increase' WHEN {change} < 0 THEN 'balance_decrease' END"
        out.append(row(m, nxt, "a.industry_code", driver if split else "''", "TRUE", "TRUE", "TRUE", f"({driver}) IS NOT NULL", change, "a.outstanding_balance" if share else "0", f"{groups} a LEFT JOIN {groups} b ON {on} AND b.period_idx = a.period_idx + 1", going, "CASE WHEN b.loan_id IS NOT NULL THEN 1 END"))
        out.append(row(m, "a.period_idx", "a.industry_code", "'new_exposure'" if split else "''", "FALSE", "TRUE", "FALSE" if share else "TRUE", "TRUE", "a.outstanding_balance", "0", f"{groups} a LEFT JOIN {groups} b ON {on} AND b.period_idx = a.period_idx - 1", "a.period_idx > 0 AND b.loan_id IS NULL", "1"))
    return out


def _spine() -> str:
    rows = []
    for k, d in enumerate(PACK):
        start = max(0, _N - d.latest)
        if d.family == "roll_cure":
            labels = [b.label for b in BINS] + ["Unknown", "Outside"]
            rows += [(k, "transition_share", i, a, b) for i in range(1, _N) for a in labels for b in labels]
        elif d.family == "maturity_wall":
            rows += [(k, "maturity_balance_share", i, "", w) for i in range(_N) for w in [w for w, _ in WINDOWS] + ["Beyond"]]
    return ", ".join(f"({k}, '{m}', {i}, '{g}', '{s}')" for k, m, i, g, s in rows)


def _case(value, otherwise: str = "NULL") -> str:
    return "CASE d " + " ".join(f"WHEN {k} THEN {value(d)}" for k, d in enumerate(PACK)) + f" ELSE {otherwise} END"


def _json(**names: str) -> str:
    return "'{' || " + " || ',' || ".join(f"""'"{k}":"' || {v} || '"'""" for k, v in names.items()) + " || '}'"


_NOW, _BEFORE = (f"(SELECT CAST(z.dt AS VARCHAR) FROM {_DAYS} z(p, dt) WHERE z.p = i - {back})" for back in (0, 1))
_PLACE = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{x}' THEN {n}" for n, x in enumerate([b.label for b in BINS] + ["Unknown", "Outside"])) + " END"
_FIRST = f"(m = 'default_incidence' AND i = {_case(lambda d: max(0, _N - d.latest))})"
_DIMS = f"""CASE WHEN i = -1 THEN '{{}}' WHEN i = -2 THEN '{{"dimension":"borrower_id"}}'
    WHEN m = 'transition_share' THEN {_json(current_as_of_date=_NOW, from_band="g", movement=f"CASE WHEN {_PLACE('s')} > {_PLACE('g')} THEN 'roll' WHEN {_PLACE('s')} < {_PLACE('g')} THEN 'cure' ELSE 'stable' END", previous_as_of_date=_BEFORE, to_band="s")}
    WHEN {_FIRST} THEN {_json(current_as_of_date=_NOW)}
    WHEN m = 'default_incidence' THEN {_json(basis=_case(lambda d: f"'{d.get('basis', 'count')}'"), current_as_of_date=_NOW, previous_as_of_date=_BEFORE)}
    WHEN m = 'ever_dpd_incidence' THEN {_json(as_of_date=_NOW, basis=_case(lambda d: f"'{d.get('basis', 'count')}'"), threshold_days="g")}
    WHEN m IN ('gross_loss_rate', 'net_loss_rate', 'recovery_amount', 'recovery_lag_days') THEN {_json(as_of_date=_NOW, flow_semantics=_case(lambda d: f"'{d.get('flows', 'period')}'"))}
    WHEN m IN ('paydown_rate', 'prepayment_rate') THEN {_json(current_as_of_date=_NOW, previous_as_of_date=_BEFORE)}
    WHEN m = 'rating_transition_share' THEN {_json(current_as_of_date=_NOW, from_rating="g", previous_as_of_date=_BEFORE, to_rating="s")}
    WHEN m IN ('outstanding_balance', 'remaining_balance_factor', 'utilization') THEN {_json(as_of_date=_NOW, cohort="g")}
    WHEN m = 'maturity_balance_share' THEN {_json(as_of_date=_NOW, maturity_window="s")}
    WHEN m = 'concentration_share' THEN {_json(as_of_date=_NOW, category="s", dimension="'industry_code'")}
    WHEN m = 'concentration_hhi' THEN {_json(as_of_date=_NOW, dimension="'industry_code'")}
    WHEN m LIKE 'portfolio_change%' THEN {_json(current_as_of_date=_NOW, previous_as_of_date=_BEFORE, segment="g")}
    ELSE {_json(current_as_of_date=_NOW, driver="s", previous_as_of_date=_BEFORE, segment="g")} END"""
_HASH = "sha256(COUNT({0}) || ':' || " + digest_sums_sql("{0}") + ")"
_TAG = "CASE m " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in METRICS.items()) + " END"
_UNIT = "CASE m " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in METRICS.items()) + " END"
_OWN = "m IN (" + ", ".join(f"'{k}'" for k, v in METRICS.items() if v[2]) + ")"
_NEEDS = "m IN (" + ", ".join(f"'{k}'" for k, v in METRICS.items() if v[3]) + ")"
_AMOUNT = "m IN (" + ", ".join(f"'{k}'" for k, v in METRICS.items() if v[0] == "currency") + ")"
_DN, _NM = "CASE WHEN dn THEN token END", "CASE WHEN nm THEN token END"

_PACK_SQL = f"""
    , t AS (SELECT *, sha256(to_json([source_system, facility_id, loan_id])) AS token FROM tape),
    x0 AS ({" UNION ALL ".join(q for k, d in enumerate(PACK) for q in _rows(k, d))}),
    top AS (SELECT d, i, s, ROW_NUMBER() OVER (PARTITION BY d, i ORDER BY SUM(num) DESC, s) AS rk FROM x0 WHERE m = 'concentration_share' AND i >= 0 AND s IS NOT NULL GROUP BY 1, 2, 3),
    x AS (SELECT x0.* EXCLUDE (s), CASE WHEN m = 'concentration_share' AND rk > 3 THEN 'Other' ELSE x0.s END AS s FROM x0 LEFT JOIN top ON m = 'concentration_share' AND top.d = x0.d AND top.i = x0.i AND top.s = x0.s),
    grp AS (SELECT d, m, i, g, SUM(el::INT) AS el, SUM(ob::INT) AS ob, SUM(dn::INT) AS dn, SUM(den) AS den, SUM(aux) AS aux, {_HASH.format(_DN)} AS dh FROM x GROUP BY ALL),
    cell AS (SELECT d, m, i, g, s, SUM(num) AS num, SUM(nm::INT) AS nm, SUM((nm AND dn)::INT) AS hit, {_HASH.format(_NM)} AS nh FROM x WHERE s IS NOT NULL GROUP BY ALL),
    rn AS (SELECT DISTINCT d, i, unnest([g, s]) AS x FROM x WHERE m = 'rating_transition_share'),
    spine AS (
        SELECT * FROM (VALUES {_spine()}) v(d, m, i, g, s) UNION SELECT d, m, i, g, s FROM cell
        UNION SELECT a.d, 'rating_transition_share', a.i, a.x, b.x FROM rn a JOIN rn b ON a.d = b.d AND a.i = b.i WHERE a.x IS NOT NULL AND b.x IS NOT NULL
        UNION SELECT d, m, i, g, unnest(['new_exposure', 'exit', 'balance_increase', 'balance_decrease']) FROM grp WHERE m LIKE 'period_driver%'),
    none AS (SELECT {_HASH.format("NULL::VARCHAR")} AS h),
    hhi AS (SELECT d, i, SUM(pow(CAST(n AS DOUBLE) / CAST(w AS DOUBLE), 2)) AS hhi FROM (SELECT d, i, s, SUM(num) AS n, SUM(SUM(num)) OVER (PARTITION BY d, i) AS w FROM x0 WHERE m = 'concentration_share' AND i >= 0 AND s IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
    raw AS (
        SELECT spine.*, COALESCE(num, 0) AS num, COALESCE(nm, 0) AS nm, COALESCE(hit, 0) AS hit, COALESCE(nh, none.h) AS nh, COALESCE(el, 0) AS el, COALESCE(ob, 0) AS ob, COALESCE(dn, 0) AS dn,
            COALESCE(den, 0) AS den, COALESCE(aux, 0) AS aux, COALESCE(dh, none.h) AS dh, NULL::DOUBLE AS hhi FROM spine CROSS JOIN none LEFT JOIN cell USING (d, m, i, g, s) LEFT JOIN grp USING (d, m, i, g)
        UNION ALL SELECT d, 'concentration_hhi', i, '', '', 0, dn, dn, dh, el, ob, dn, den, aux, dh, hhi FROM grp JOIN hhi USING (d, i) WHERE m = 'concentration_share'),
    r1 AS (
        SELECT *, CASE WHEN i <> -1 AND (m LIKE 'portfolio_change%' OR m LIKE 'period_driver%') THEN greatest(el, CAST(aux AS BIGINT)) ELSE el END AS eligible, dn - hit AS comp, {_DIMS} AS dims,
            CASE WHEN i < 0 OR {_FIRST} THEN m || ':' || i ELSE i || ':' || {_TAG} || CASE WHEN {_OWN} THEN ':' || g ELSE '' END END AS sg, {_case(lambda d: d.least_cell)} AS least FROM raw),
    r2 AS (
        SELECT *, CASE WHEN i = -1 OR {_FIRST} THEN 'no_prior_period' WHEN i = -2 THEN 'entity_resolution_unapproved'
            WHEN m = 'recovery_lag_days' THEN CASE WHEN den <> 0 THEN 'available' WHEN aux > 0 THEN 'missing_required_field' ELSE 'no_records' END
            WHEN eligible = 0 THEN 'no_records' WHEN ob = 0 OR ({_case(lambda d: "TRUE" if d.null_policy == "unavailable" else "FALSE")} AND ob < eligible) THEN 'missing_required_field'
            WHEN {_NEEDS} AND den = 0 THEN 'division_by_zero' ELSE 'available' END AS why,
            (dn > 0 AND dn < least) OR (nm > 0 AND nm < least) OR (comp > 0 AND comp < least) AS prim FROM r1),
    r3 AS (SELECT *, SUM(prim::INT) OVER (PARTITION BY d, sg) AS k, NOT prim AND nm > 0 AS cand FROM r2),
    r4 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY d, sg, cand ORDER BY nm, m, dims) AS rk FROM r3),
    r5 AS (SELECT *, prim OR ({_case(lambda d: "TRUE" if d.complementary else "FALSE")} AND k = 1 AND cand AND rk = 1) AS sup, CASE WHEN eligible > 0 THEN ob::DOUBLE / eligible END AS cov FROM r4),
    r6 AS (
        SELECT *, CASE WHEN sup THEN 'suppressed' WHEN why = 'available' AND (cov IS NULL OR cov < {_case(lambda d: d.least_ratio)} OR ob < {_case(lambda d: d.least_records)}) THEN 'insufficient_coverage' ELSE why END AS reason,
            CASE WHEN hhi IS NOT NULL THEN hhi WHEN {_AMOUNT} THEN CAST(num AS DOUBLE) WHEN den <> 0 THEN CAST(num AS DOUBLE) / CAST(den AS DOUBLE) END AS v FROM r5)
    SELECT {_case(lambda d: f"'{d.id}'")} AS definition_id, CAST({_case(lambda d: d.version)} AS INTEGER) AS definition_version, m AS metric, {_UNIT} AS unit, dims AS dimensions,
        CASE WHEN reason = 'available' THEN COALESCE(hhi, CAST(num AS DOUBLE)) END AS numerator,
        CASE WHEN reason = 'available' THEN CASE WHEN hhi IS NOT NULL THEN 1.0::DOUBLE WHEN NOT {_AMOUNT} THEN CAST(den AS DOUBLE) END END AS denominator,
        CASE WHEN reason = 'available' THEN v END AS value, CAST(CASE WHEN NOT sup THEN ob END AS BIGINT) AS observed_count, CAST(CASE WHEN NOT sup THEN eligible END AS BIGINT) AS eligible_count,
        CASE WHEN NOT sup THEN cov END AS coverage, reason AS availability, sup AS suppressed, nh AS numerator_hash, dh AS denominator_hash,
        sha256({_case(lambda d: f"'{d.id}'")} || chr(31) || {_case(lambda d: d.version)} || chr(31) || m || chr(31) || dims) AS cell_id,
        {_case(lambda d: f"'{definition_hash([d.id, d.version, d.family, d.params, d.population, d.latest, d.null_policy])}'")} AS definition_hash FROM r6"""


@query(with_tape(_PACK_SQL))
def a16_a22_surveillance_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirteen definitions of all nine families with their populations, dates, null policies and bounds, as published."""
    return run_pack(tape(spark, sf_dir), PACK)
