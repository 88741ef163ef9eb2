"""Portfolio analytics over the derived tape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.scalars import Bin, category, cohort, entity_token, numeric_bin, ratio, row_token
from ..operators import finalize, surveillance, vintage
from ..operators.stratification import balance_conflicts, stratify, stratify_live, suppress_flat
from .registry import ORACLE_SQL, query
from .tape import KEY, PERIODS, TAPE_SQL, digest_sums_sql, periods, tape, with_tape, written

BINS = [Bin("Current", 0, 30), Bin("30-59", 30, 60), Bin("60-89", 60, 90), Bin("90+", 90, 120)]
_BAND = "CASE WHEN {0} IS NULL THEN 'Unknown' WHEN {0} >= 0 AND {0} < 30 THEN 'Current' WHEN {0} >= 30 AND {0} < 60 THEN '30-59' WHEN {0} >= 60 AND {0} < 90 THEN '60-89' WHEN {0} >= 90 AND {0} < 120 THEN '90+' ELSE 'Outside' END"
_D = "CAST({} AS DOUBLE)"
_RATIO = "CASE WHEN {1} <> 0 THEN CAST({0} AS DOUBLE) / CAST({1} AS DOUBLE) END"
_KEYS = "a.source_system = b.source_system AND a.facility_id = b.facility_id AND a.loan_id = b.loan_id AND b.period_idx = a.period_idx + 1"
_PAIRS = f"""
pairs AS (
    SELECT a.*, n.as_of_date AS to_date, b.loan_id IS NOT NULL AS found, b.outstanding_balance AS balance_next, b.days_past_due AS dpd_next,
        b.default_flag AS default_next, b.risk_rating AS rating_next, b.scheduled_principal_amount AS scheduled_next
    FROM tape a JOIN (SELECT DISTINCT period_idx, as_of_date FROM tape) n ON n.period_idx = a.period_idx + 1
    LEFT JOIN tape b ON {_KEYS})"""


@query(
    with_tape(f"""
    , g AS (SELECT as_of_date, COALESCE(NULLIF(TRIM(risk_rating), ''), 'Unknown/Unmapped') AS bucket, COUNT(*) AS loans, SUM(outstanding_balance) AS balance,
        SUM(interest_rate * outstanding_balance) AS n, SUM(CASE WHEN interest_rate IS NOT NULL THEN outstanding_balance END) AS d FROM tape GROUP BY ALL),
    s AS (SELECT *, SUM(balance) OVER (PARTITION BY as_of_date) AS whole, loans < 300 AS small FROM g),
    m AS (SELECT *, SUM(small::INT) OVER (PARTITION BY as_of_date) AS k, ROW_NUMBER() OVER (PARTITION BY as_of_date, small ORDER BY loans, bucket) AS r FROM s),
    h AS (SELECT *, small OR (k = 1 AND NOT small AND r = 1) AS suppressed FROM m)
    SELECT as_of_date, bucket, CASE WHEN NOT suppressed THEN loans END AS loans, CAST(CASE WHEN NOT suppressed THEN balance END AS DECIMAL(38,2)) AS balance,
        CASE WHEN NOT suppressed THEN {_RATIO.format("balance", "whole")} END AS share, CASE WHEN NOT suppressed THEN {_RATIO.format("n", "d")} END AS wa_interest_rate, suppressed FROM h""")
)
def a1_snapshot_stratification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratify(tape(spark, sf_dir), category("risk_rating"), averages=("interest_rate",), least=300)


@query(
    with_tape(f"""
    , g AS (SELECT {_BAND.format("days_past_due").replace("'Unknown'", "'Unknown/Unmapped'").replace("'Outside'", "'Other/Out of range'")} AS bucket, COUNT(*) AS loans, SUM(COALESCE(outstanding_balance, 0)) AS balance
        FROM tape WHERE as_of_date = DATE '{PERIODS[-1]}' GROUP BY 1)
    SELECT bucket, CASE WHEN loans >= 50 THEN loans END AS loans, CAST(CASE WHEN loans >= 50 THEN balance END AS DECIMAL(38,2)) AS balance, loans < 50 AS suppressed FROM g""")
)
def a2_live_stratification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.as_of_rows(tape(spark, sf_dir), "snapshot", F.lit(PERIODS[-1]).cast("date"))
    return stratify_live(rows, numeric_bin("days_past_due", BINS), least=50, most=100)


_MOB = "((year(as_of_date) * 12 + month(as_of_date)) - (year(origination_date) * 12 + month(origination_date)))"


@query(
    with_tape(f"""
    , r AS (SELECT *, CAST(date_trunc('quarter', origination_date) AS DATE) AS cohort, {_MOB} AS mob FROM tape),
    o AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_system, facility_id, loan_id, mob ORDER BY as_of_date DESC) AS rn FROM r WHERE mob BETWEEN 0 AND 12) WHERE rn = 1),
    p AS (SELECT cohort, mob, COUNT(*) AS observed, SUM(outstanding_balance) AS current, SUM(COALESCE(charge_off_amount, 0) - COALESCE(recovery_amount, 0)) AS net_loss,
        SUM(CASE WHEN days_past_due >= 30 THEN outstanding_balance ELSE 0 END) AS delinquent FROM o GROUP BY 1, 2),
    l AS (SELECT source_system, facility_id, loan_id, MIN(origination_date) AS od, MAX(original_balance) AS ob FROM tape GROUP BY 1, 2, 3),
    c AS (SELECT CAST(date_trunc('quarter', od) AS DATE) AS cohort, COUNT(*) AS loans, CAST(SUM(ob) AS DECIMAL(38,2)) AS original FROM l GROUP BY 1),
    g AS (SELECT c.*, t.mob, t.mob <= (1999 * 12 + 12) - (year(c.cohort) * 12 + month(c.cohort)) AS seasoned FROM c, (SELECT unnest(range(0, 13)) AS mob) t)
    SELECT cohort, CAST(g.mob AS INT) AS mob, loans, original, seasoned, CASE WHEN seasoned THEN observed END AS observed, CAST(CASE WHEN seasoned THEN current END AS DECIMAL(38,2)) AS current,
        CASE WHEN seasoned THEN {_RATIO.format("current", "original")} END AS factor, CAST(CASE WHEN seasoned THEN net_loss END AS DECIMAL(38,2)) AS net_loss,
        CASE WHEN seasoned THEN {_RATIO.format("net_loss", "original")} END AS loss_rate, CAST(CASE WHEN seasoned THEN delinquent END AS DECIMAL(38,2)) AS delinquent,
        CASE WHEN seasoned THEN {_RATIO.format("delinquent", "current")} END AS delinquency_rate
    FROM g LEFT JOIN p USING (cohort, mob)""")
)
def a3_snapshot_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vintage.vintage(tape(spark, sf_dir), KEY, F.lit(PERIODS[-1]).cast("date"), "quarter", 12, 30)


@query(
    with_tape(f"""
    , r AS (SELECT *, CAST(date_trunc('year', origination_date) AS DATE) AS cohort, {_MOB} AS mob FROM tape),
    o AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY loan_id, mob ORDER BY as_of_date DESC) AS rn FROM r WHERE mob BETWEEN 0 AND 36) WHERE rn = 1),
    p AS (SELECT cohort, mob, COUNT(*) AS observed, SUM(COALESCE(outstanding_balance, 0)) AS current FROM o GROUP BY 1, 2),
    l AS (SELECT loan_id, MAX(original_balance) AS b, MIN(cohort) AS cohort FROM r GROUP BY 1),
    c AS (SELECT cohort, COUNT(*) AS loans, SUM(b) AS original FROM l GROUP BY 1)
    SELECT cohort, mob, CASE WHEN loans >= 20 THEN observed END AS observed, CASE WHEN loans >= 20 THEN {_RATIO.format("current", "original")} END AS factor, loans < 20 AS suppressed FROM p JOIN c USING (cohort)""")
)
def a4_live_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vintage.vintage_live(tape(spark, sf_dir), "year", 36, 20)


def _matrix_sql(before: str, after: str, spine: str, more: str = "", select: str = "") -> str:
    return with_tape(f"""
    , {_PAIRS},
    rows AS (SELECT to_date, {before} AS from_label, CASE WHEN found THEN {after} END AS to_label, outstanding_balance AS b, found FROM pairs2),
    cells AS (SELECT to_date, from_label, to_label, SUM(b) AS moved, COUNT(*) AS loans FROM rows WHERE found GROUP BY 1, 2, 3),
    whole AS (SELECT to_date, from_label, SUM(CASE WHEN found THEN b END) AS denominator, COUNT(*) AS eligible, SUM(found::INT) AS observed FROM rows GROUP BY 1, 2),
    {spine}
    SELECT s.to_date, s.from_label, s.to_label, CAST(COALESCE(moved, 0) AS DECIMAL(38,2)) AS numerator, CAST(COALESCE(denominator, 0) AS DECIMAL(38,2)) AS denominator,
        {_RATIO.format("COALESCE(moved, 0)", "denominator")} AS value, CAST(COALESCE(loans, 0) AS BIGINT) AS loans, CAST(COALESCE(eligible, 0) AS BIGINT) AS eligible, CAST(COALESCE(observed, 0) AS BIGINT) AS observed{select}
    FROM spine s LEFT JOIN whole w ON w.to_date = s.to_date AND w.from_label = s.from_label
    LEFT JOIN cells c ON c.to_date = s.to_date AND c.from_label = s.from_label AND c.to_label = s.to_label""").replace("pairs AS (\n    SELECT a.*", "pairs2 AS (SELECT * FROM (\n    SELECT a.*").replace("LEFT JOIN tape b ON " + _KEYS + ")", "LEFT JOIN tape b ON " + _KEYS.replace("a.period_idx + 1", "a.period_idx + 1 AND b.outstanding_balance IS NOT NULL") + ") WHERE outstanding_balance IS NOT NULL)")


_LABELS = "('Current', 0), ('30-59', 1), ('60-89', 2), ('90+', 3), ('Unknown', 4), ('Outside', 5)"


@query(
    _matrix_sql(
        _BAND.format("days_past_due"),
        _BAND.format("dpd_next"),
        f"labels AS (SELECT * FROM (VALUES {_LABELS}) AS t(label, o)), spine AS (SELECT d.to_date, a.label AS from_label, b.label AS to_label, a.o AS fo, b.o AS t_o FROM (SELECT DISTINCT to_date FROM whole) d, labels a, labels b)",
        select=", CASE WHEN fo = t_o THEN 'stay' WHEN greatest(fo, t_o) >= 4 THEN 'other' WHEN t_o > fo THEN 'roll' ELSE 'cure' END AS movement",
    )
)
def a5_roll_cure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.roll_cure(tape(spark, sf_dir), BINS, periods=periods(spark))


@query(
    _matrix_sql(
        "COALESCE(risk_rating, 'Unrated')",
        "COALESCE(rating_next, 'Unrated')",
        "names AS (SELECT DISTINCT to_date, label FROM (SELECT to_date, from_label AS label FROM whole UNION ALL SELECT to_date, to_label FROM cells)), spine AS (SELECT a.to_date, a.label AS from_label, b.label AS to_label FROM names a JOIN names b ON a.to_date = b.to_date)",
    )
)
def a10_rating_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.rating_migration(tape(spark, sf_dir), periods=periods(spark))


def _default_sql(weight: str) -> str:
    return with_tape(f"""
    , {_PAIRS},
    e AS (SELECT *, found AND default_flag IS NOT NULL AND default_next IS NOT NULL AS obs FROM pairs WHERE NOT COALESCE(default_flag, FALSE)),
    s AS (SELECT to_date, SUM(CASE WHEN obs AND default_next THEN {weight} ELSE 0 END) AS n, SUM(CASE WHEN obs THEN {weight} ELSE 0 END) AS d, COUNT(*) AS eligible, CAST(SUM(obs::INT) AS BIGINT) AS observed FROM e GROUP BY 1)
    SELECT to_date, CAST(n AS DECIMAL(38,2)) AS numerator, CAST(d AS DECIMAL(38,2)) AS denominator, eligible, observed, {_RATIO.format("n", "d")} AS value FROM s""")


@query(_default_sql("1"))
def a6_default_incidence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.default_incidence(tape(spark, sf_dir), "count", periods=periods(spark))


@query(_default_sql("outstanding_balance"))
def a6_default_incidence_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.default_incidence(tape(spark, sf_dir), "balance", periods=periods(spark))


@query(
    with_tape(f"""
    , h AS (SELECT as_of_date, MAX(days_past_due) OVER w AS worst, MAX((days_past_due IS NULL)::INT) OVER w AS gap FROM tape
        WINDOW w AS (PARTITION BY source_system, facility_id, loan_id ORDER BY as_of_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    s AS (SELECT as_of_date, threshold, CAST(SUM((gap = 0 AND worst >= threshold)::INT) AS BIGINT) AS numerator, CAST(SUM((gap = 0)::INT) AS BIGINT) AS observed, COUNT(*) AS eligible
        FROM h, (SELECT unnest([30, 60, 90]) AS threshold) GROUP BY 1, 2)
    SELECT *, {_RATIO.format("numerator", "observed")} AS value FROM s""")
)
def a7_ever_dpd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.ever_dpd(tape(spark, sf_dir), [30, 60, 90])


def _loss_sql(rows: str) -> str:
    return with_tape(f"""
    , r AS ({rows}),
    s AS (SELECT as_of_date, SUM(loss) AS gl, SUM(CASE WHEN loss IS NOT NULL THEN exposure END) AS ge, SUM(rec) AS rc, SUM(CASE WHEN loss IS NOT NULL AND rec IS NOT NULL THEN exposure END) AS ne,
        SUM(CASE WHEN rec > 0 AND default_date IS NOT NULL THEN rec * date_diff('day', default_date, as_of_date) END) AS ls, SUM(CASE WHEN rec > 0 AND default_date IS NOT NULL THEN rec END) AS lw FROM r GROUP BY 1)
    SELECT as_of_date, CAST(gl AS DECIMAL(38,2)) AS gross_loss, CAST(rc AS DECIMAL(38,2)) AS recovery, {_RATIO.format("gl", "ge")} AS gross_loss_rate,
        {_RATIO.format("(COALESCE(gl, 0) - COALESCE(rc, 0))", "ne")} AS net_loss_rate, {_RATIO.format("ls", "lw")} AS recovery_lag_days FROM s""")


@query(_loss_sql("SELECT as_of_date, charge_off_amount AS loss, recovery_amount AS rec, outstanding_balance AS exposure, default_date FROM tape"))
def a8_loss_recovery_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.loss_recovery(tape(spark, sf_dir), "period")


@query(
    _loss_sql(f"""SELECT b.as_of_date, b.charge_off_amount - CASE WHEN a.loan_id IS NULL THEN 0 ELSE a.charge_off_amount END AS loss,
        b.recovery_amount - CASE WHEN a.loan_id IS NULL THEN 0 ELSE a.recovery_amount END AS rec, b.outstanding_balance AS exposure, b.default_date FROM tape b LEFT JOIN tape a ON {_KEYS}""")
)
def a8_loss_recovery_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.loss_recovery(tape(spark, sf_dir), "cumulative")


@query(
    with_tape(f"""
    , {_PAIRS},
    e AS (SELECT *, greatest(outstanding_balance - COALESCE(balance_next, 0), 0) AS dec FROM pairs WHERE outstanding_balance IS NOT NULL AND (NOT found OR balance_next IS NOT NULL)),
    s AS (SELECT to_date, SUM(dec) AS pd, SUM(CASE WHEN found AND scheduled_next IS NOT NULL THEN greatest(dec - scheduled_next, 0) END) AS pp, SUM(outstanding_balance) AS den, COUNT(*) AS loans FROM e GROUP BY 1)
    SELECT to_date, CAST(pd AS DECIMAL(38,2)) AS paydown, CAST(pp AS DECIMAL(38,2)) AS prepayment, CAST(den AS DECIMAL(38,2)) AS denominator, loans, {_RATIO.format("pd", "den")} AS paydown_rate, {_RATIO.format("pp", "den")} AS prepayment_rate FROM s""")
)
def a9_paydown_prepayment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.paydown_prepayment(tape(spark, sf_dir), periods=periods(spark))


@query(
    with_tape(f"""
    , g AS (SELECT as_of_date, CAST(CAST(date_trunc('year', origination_date) AS DATE) AS VARCHAR) AS cohort, CAST(SUM(outstanding_balance) AS DECIMAL(38,2)) AS b, CAST(SUM(original_balance) AS DECIMAL(38,2)) AS o, CAST(SUM(commitment_amount) AS DECIMAL(38,2)) AS c
        FROM tape WHERE outstanding_balance IS NOT NULL GROUP BY 1, 2)
    SELECT as_of_date, cohort, 'balance' AS metric, b AS numerator, CAST(NULL AS DECIMAL(38,2)) AS denominator, {_D.format("b")} AS value FROM g
    UNION ALL SELECT as_of_date, cohort, 'remaining_factor', b, o, {_RATIO.format("b", "o")} FROM g UNION ALL SELECT as_of_date, cohort, 'utilisation', b, c, {_RATIO.format("b", "c")} FROM g""")
)
def a11_balance_utilisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.balance_utilisation(tape(spark, sf_dir), cohort("origination_date", "year"))


_UNTIL = "((year(maturity_date) * 12 + month(maturity_date)) - (year(as_of_date) * 12 + month(as_of_date)) + CASE WHEN day(maturity_date) > day(as_of_date) THEN 1 ELSE 0 END)"


@query(
    with_tape(f"""
    , l AS (SELECT as_of_date, outstanding_balance AS b, CASE WHEN maturity_date IS NULL THEN 'Unknown' WHEN {_UNTIL} < 0 THEN 'Matured' WHEN {_UNTIL} <= 6 THEN '0-6' WHEN {_UNTIL} <= 24 THEN '7-24' ELSE 'Beyond' END AS w FROM tape WHERE outstanding_balance IS NOT NULL),
    g AS (SELECT as_of_date, w, SUM(b) AS n, COUNT(*) AS loans FROM l GROUP BY 1, 2),
    s AS (SELECT d.as_of_date, t.w, COALESCE(n, 0) AS n, COALESCE(loans, 0) AS loans FROM (SELECT DISTINCT as_of_date FROM g) d CROSS JOIN (SELECT unnest(['0-6', '7-24', 'Matured', 'Beyond', 'Unknown']) AS w) t LEFT JOIN g ON g.as_of_date = d.as_of_date AND g.w = t.w),
    z AS (SELECT *, SUM(n) OVER (PARTITION BY as_of_date) AS whole FROM s)
    SELECT as_of_date, w AS "window", CAST(n AS DECIMAL(38,2)) AS numerator, loans, {_RATIO.format("n", "whole")} AS share FROM z""")
)
def a12_maturity_wall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.maturity_wall(tape(spark, sf_dir), [("0-6", 6), ("7-24", 24)])


@query(
    with_tape(f"""
    , t2 AS (SELECT t.*, COALESCE(CASE WHEN CAST(borrower_id AS BIGINT) % 3 <> 0 THEN CONCAT('E', CAST(CAST(borrower_id AS BIGINT) % 50 AS VARCHAR)) END, borrower_id) AS entity FROM tape t),
    g AS (SELECT as_of_date, entity AS category, SUM(outstanding_balance) AS amount, COUNT(*) AS loans FROM t2 WHERE outstanding_balance IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of_date ORDER BY amount DESC, category) AS rk, SUM(amount) OVER (PARTITION BY as_of_date) AS whole FROM g),
    o AS (SELECT as_of_date, CASE WHEN rk <= 10 THEN category ELSE 'Other' END AS category, SUM(amount) AS amount, SUM(loans) AS loans, MAX(whole) AS whole FROM r GROUP BY 1, 2)
    SELECT as_of_date, category, CAST(amount AS DECIMAL(38,2)) AS amount, CAST(loans AS BIGINT) AS loans, {_RATIO.format("amount", "whole")} AS share FROM o""")
)
def a13_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Borrowers go through an entity map (J7) made of two thirds of the customers."""
    rows = tape(spark, sf_dir)
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 <> 0")
    ids = known.select(F.explode(F.array(F.lit("core"), F.lit("alt"))).alias("source_system"), F.col("c_custkey").cast("string").alias("source_id"), F.concat(F.lit("E"), (F.col("c_custkey") % 50).cast("string")).alias("entity_id"))
    return surveillance.concentration(surveillance.resolve_entities(rows, ids), F.col("entity"), 10).drop("hhi")


@query(
    with_tape("""
    , g AS (SELECT as_of_date, industry_code AS category, SUM(outstanding_balance) AS amount FROM tape WHERE outstanding_balance IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT *, SUM(amount) OVER (PARTITION BY as_of_date) AS whole FROM g)
    SELECT as_of_date, ROUND(SUM(POW(CAST(amount AS DOUBLE) / CAST(whole AS DOUBLE), 2)), 9) AS hhi FROM r GROUP BY 1""")
)
def a14_herfindahl(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = surveillance.concentration(tape(spark, sf_dir), F.col("industry_code"), 3)
    return cells.groupBy("as_of_date").agg(F.round(F.max("hhi"), 9).alias("hhi"))


@query(
    with_tape(f"""
    , k AS (SELECT period_idx, as_of_date, source_system, facility_id, loan_id, industry_code AS segment, outstanding_balance AS b FROM tape WHERE outstanding_balance IS NOT NULL),
    d AS (SELECT DISTINCT period_idx, as_of_date FROM tape),
    x AS (SELECT period_idx + 1 AS pair, source_system, facility_id, loan_id, segment, b AS b0, NULL::DECIMAL(20,2) AS b1, 1 AS was, 0 AS is_ FROM k WHERE period_idx < 3
        UNION ALL SELECT period_idx, source_system, facility_id, loan_id, segment, NULL, b, 0, 1 FROM k WHERE period_idx > 0),
    y AS (SELECT pair, source_system, facility_id, loan_id, segment, COALESCE(MAX(b0), 0) AS b0, COALESCE(MAX(b1), 0) AS b1, MAX(was) AS was, MAX(is_) AS is_ FROM x GROUP BY 1, 2, 3, 4, 5),
    z AS (SELECT d.as_of_date AS to_date, segment, b0, b1 - b0 AS ch, CASE WHEN was = 0 THEN 'new_exposure' WHEN is_ = 0 THEN 'exit' WHEN b1 > b0 THEN 'increase' WHEN b1 < b0 THEN 'decrease' ELSE 'unchanged' END AS driver FROM y JOIN d ON d.period_idx = y.pair),
    s AS (SELECT to_date, segment, SUM(b0) AS sb, SUM(ch) AS change FROM z GROUP BY 1, 2),
    g AS (SELECT to_date, segment, driver, SUM(ch) AS amount, COUNT(*) AS loans FROM z GROUP BY 1, 2, 3)
    SELECT s.to_date, s.segment, n.driver, CAST(COALESCE(amount, 0) AS DECIMAL(38,2)) AS amount, COALESCE(loans, 0) AS loans, CAST(change AS DECIMAL(38,2)) AS change,
        {_RATIO.format("change", "sb")} AS change_rate, {_RATIO.format("COALESCE(amount, 0)", "change")} AS driver_share
    FROM s CROSS JOIN (SELECT unnest(['new_exposure', 'exit', 'increase', 'decrease', 'unchanged']) AS driver) n LEFT JOIN g ON g.to_date = s.to_date AND g.segment = s.segment AND g.driver = n.driver""")
)
def a15_period_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surveillance.period_change(tape(spark, sf_dir), "industry_code", periods=periods(spark))


NOT_EURO = {"op": "neq", "field": "currency", "value": "EUR"}
PACK = [
    {"id": "default_incidence", "metric": "default_incidence", "filter": NOT_EURO, "latest": 3, "most_cells": 10},
    {"id": "ever_dpd", "metric": "ever_dpd", "params": {"thresholds": [30, 90]}, "filter": NOT_EURO, "latest": 3},
    {"id": "roll_cure_all", "metric": "roll_cure", "params": {"bins": BINS}, "most_cells": 1000},
    {"id": "rating_migration", "metric": "rating_migration", "filter": {"op": "in", "field": "industry_code", "values": ["BUILDING", "MACHINERY"]}, "latest": 2},
]


def _packed(name: str, query_name: str, where: str, dims: list[str], numerator: str = "numerator", denominator: str = "denominator", more: str = "") -> str:
    """The SQL of a metric over a part of the tape, as cells of a pack."""
    part = TAPE_SQL.replace("\ntape AS (", "\ntape0 AS (") + f", tape AS (SELECT * FROM tape0 WHERE {where})"
    names = " || ',' || ".join(f"""'"{d}":"' || CAST({d} AS VARCHAR) || '"'""" for d in dims)
    return f"SELECT '{name}' AS metric, '{{' || {names} || '}}' AS dimensions, CAST({numerator} AS DOUBLE) AS numerator, CAST({denominator} AS DOUBLE) AS denominator, value FROM ({ORACLE_SQL[query_name].replace(TAPE_SQL, part)}) {more}"


@query(
    " UNION ALL ".join(
        [
            _packed("default_incidence", "a6_default_incidence_count", "currency <> 'EUR' AND period_idx >= 1", ["to_date"]),
            _packed("ever_dpd", "a7_ever_dpd", "currency <> 'EUR' AND period_idx >= 1", ["as_of_date", "threshold"], denominator="NULL", more="WHERE threshold <> 60"),
            _packed("roll_cure_all", "a5_roll_cure", "TRUE", ["from_label", "to_label", "to_date", "movement"]),
            _packed("rating_migration", "a10_rating_migration", "industry_code IN ('BUILDING', 'MACHINERY') AND period_idx >= 2", ["to_date", "from_label", "to_label"]),
            _packed("balance", "a11_balance_utilisation", "currency <> 'EUR'", ["as_of_date", "cohort", "metric"]),
        ]
    )
)
def a16_metric_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five definitions, each with its population and periods; the tape is written once and read by all."""
    balance = {"id": "balance", "metric": "balance_utilisation", "params": {"by": cohort("origination_date", "year")}, "filter": NOT_EURO}
    cells = surveillance.run_pack(written(tape(spark, sf_dir), "tape"), [*PACK, balance])
    return cells.select("metric", F.to_json("dimensions").alias("dimensions"), "numerator", "denominator", "value")


_CELL_SQL = """
    , r AS (SELECT as_of_date, industry_code AS segment, sha256(to_json([source_system, facility_id, loan_id])) AS token, COALESCE(days_past_due >= 90, FALSE) AS n, outstanding_balance IS NOT NULL AND days_past_due IS NOT NULL AS d, outstanding_balance AS b,
        facility_id FROM tape),
    c AS (SELECT as_of_date, segment, facility_id, SUM(CASE WHEN n AND d THEN b ELSE 0 END) AS num, SUM(CASE WHEN d THEN b ELSE 0 END) AS den, COUNT(DISTINCT CASE WHEN d THEN token END) AS dp, COUNT(DISTINCT CASE WHEN n AND d THEN token END) AS np,
        COUNT(DISTINCT CASE WHEN d AND NOT n THEN token END) AS cp, COUNT(*) AS eligible, SUM(d::INT) AS observed FROM r GROUP BY 1, 2, 3),
    p AS (SELECT *, dp < 8 OR (np > 0 AND np < 3) OR (cp > 0 AND cp < 3) AS prim FROM c),
    q AS (SELECT *, SUM(prim::INT) OVER (PARTITION BY as_of_date, facility_id) AS k, NOT prim AND np > 0 AS cand FROM p),
    z AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY as_of_date, facility_id, cand ORDER BY np, segment) AS rk FROM q),
    f AS (SELECT *, prim OR (k = 1 AND cand AND rk = 1) AS suppressed FROM z)
    """


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir).withColumn("token", row_token(*KEY)).withColumnRenamed("industry_code", "segment")
    d = F.col("outstanding_balance").isNotNull() & F.col("days_past_due").isNotNull()
    n = F.coalesce(F.col("days_past_due") >= 90, F.lit(False)) & d
    zero = F.lit(0).cast("decimal(20,2)")
    return finalize.cells_of(rows, ["as_of_date", "facility_id", "segment"], "token", n, d, F.when(n, F.col("outstanding_balance")).otherwise(zero), F.when(d, F.col("outstanding_balance")).otherwise(zero))


@query(
    with_tape(
        _CELL_SQL
        + f"""SELECT as_of_date, facility_id, segment, suppressed, CASE WHEN suppressed THEN 'suppressed' WHEN dp = 0 THEN 'no_records' WHEN den = 0 THEN 'division_by_zero' ELSE 'available' END AS availability,
        CASE WHEN NOT suppressed THEN dp END AS denominator_population, CAST(CASE WHEN NOT suppressed THEN num END AS DECIMAL(38,2)) AS numerator, CASE WHEN NOT suppressed THEN {_RATIO.format("num", "den")} END AS value FROM f"""
    )
)
def a17_a20_finalised_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Availability, primary and complementary suppression of a share of delinquent balance by segment within facilities."""
    cells = finalize.suppress_grouped(_cells(spark, sf_dir), ["as_of_date", "facility_id"], ["segment"], 3, 8)
    cells = cells.withColumn("availability", finalize.availability(F.col("denominator_population"), F.lit(False), F.col("denominator"))).withColumn("value", ratio("numerator", "denominator"))
    out = finalize.publish(cells, ["denominator_population", "numerator", "value"])
    return out.select("as_of_date", "facility_id", "segment", "suppressed", "availability", "denominator_population", "numerator", "value")


_HASH = "sha256(COUNT({0}) || ':' || " + digest_sums_sql("{0}") + ")"


@query(
    with_tape(
        f"""{_CELL_SQL}, t AS (SELECT as_of_date, facility_id, segment, token, MAX(n AND d) AS n, MAX(d) AS d FROM r GROUP BY ALL)
    SELECT as_of_date, facility_id, segment, {_HASH.format("CASE WHEN n THEN token END")} AS numerator_hash, {_HASH.format("CASE WHEN d THEN token END")} AS denominator_hash,
        sha256('delinquent_share' || chr(31) || CAST(as_of_date AS VARCHAR) || chr(31) || facility_id || chr(31) || segment) AS cell_id FROM t GROUP BY 1, 2, 3"""
    )
)
def a22_population_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir).select("as_of_date", "facility_id", "segment", "numerator_hash", "denominator_hash", finalize.cell_id(F.lit("delinquent_share"), "as_of_date", "facility_id", "segment").alias("cell_id"))


@query(
    with_tape("""
    , g AS (SELECT facility_id AS bucket, COUNT(*) AS loans FROM tape WHERE period_idx = 0 GROUP BY 1),
    m AS (SELECT *, loans < 40 AS small, SUM((loans < 40)::INT) OVER () AS k, ROW_NUMBER() OVER (PARTITION BY loans < 40 ORDER BY loans, bucket) AS r FROM g)
    SELECT bucket, loans, small OR (k = 1 AND NOT small AND r = 1) AS suppressed FROM m""")
)
def a21_flat_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = tape(spark, sf_dir).where("period_idx = 0").groupBy(F.col("facility_id").alias("bucket")).agg(F.count("*").alias("loans"))
    return suppress_flat(groups, "bucket", "loans", 40)


@query(
    with_tape(f"""
    , g AS (SELECT as_of_date, CAST(SUM(outstanding_balance) AS DECIMAL(38,2)) AS b, CAST(SUM(original_balance) AS DECIMAL(38,2)) AS o FROM tape WHERE outstanding_balance IS NOT NULL GROUP BY 1)
    SELECT 'remaining_factor' AS metric_id, as_of_date, {_RATIO.format("b", "o")} AS value FROM g""")
)
def a24_metric_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = surveillance.pack({"remaining_factor": surveillance.balance_utilisation(tape(spark, sf_dir))}).withColumn("availability", F.lit("available")).withColumn("suppressed", F.lit(False))
    return finalize.project_metric(cells, "remaining_factor", {"cohort": "All", "metric": "remaining_factor"})


@query(
    with_tape("""
    SELECT as_of_date, CONCAT(CASE WHEN CAST(borrower_id AS BIGINT) % 3 <> 0 THEN 'Entity-' ELSE 'Unresolved-' END, substr(sha256(CONCAT('["demo","borrower_id","', borrower_id, '"]')), 1, 16)) AS entity, COUNT(*) AS loans
    FROM tape GROUP BY 1, 2""")
)
def h9_entity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.col("borrower_id").cast("long") % 3 != 0
    return tape(spark, sf_dir).groupBy("as_of_date", entity_token("demo", "borrower_id", F.col("borrower_id"), known).alias("entity")).agg(F.count("*").alias("loans"))


@query(
    with_tape("""
    SELECT as_of_date, COUNT(*) AS loans, CAST(SUM(outstanding_balance) AS DECIMAL(38,2)) AS balance FROM tape
    WHERE (risk_rating IS NULL OR risk_rating <> '1-URGENT') AND (days_past_due >= 30 OR maturity_date IS NULL) AND industry_code IN ('BUILDING', 'MACHINERY') GROUP BY 1""")
)
def f1_population_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {
        "op": "and",
        "args": [
            {"op": "neq", "field": "risk_rating", "value": "1-URGENT"},
            {"op": "or", "args": [{"op": "gte", "field": "days_past_due", "value": 30}, {"op": "is_null", "field": "maturity_date"}]},
            {"op": "in", "field": "industry_code", "values": ["BUILDING", "MACHINERY"]},
        ],
    }
    return tape(spark, sf_dir).where(filters.population_filter(tree)).groupBy("as_of_date").agg(F.count("*").alias("loans"), F.sum("outstanding_balance").cast("decimal(38,2)").alias("balance"))


@query(with_tape(f"SELECT as_of_date, COUNT(*) AS loans FROM tape WHERE as_of_date > DATE '{PERIODS[1]}' GROUP BY 1"))
def f8_latest_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.latest_periods(tape(spark, sf_dir), 2).groupBy("as_of_date").agg(F.count("*").alias("loans"))


@query(
    with_tape("""
    , bad AS (SELECT source_system, facility_id, loan_id, as_of_date, outstanding_balance, origination_date, original_balance + CASE WHEN CAST(loan_id AS BIGINT) % 53 = 0 AND period_idx = 2 THEN 1 ELSE 0 END AS original_balance FROM tape
        UNION ALL SELECT source_system, facility_id, loan_id, as_of_date, outstanding_balance + 1, origination_date, original_balance FROM tape WHERE CAST(loan_id AS BIGINT) % 59 = 0 AND period_idx = 1 AND outstanding_balance IS NOT NULL),
    moved AS (SELECT source_system, facility_id, loan_id FROM bad GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT original_balance) > 1),
    twice AS (SELECT source_system, facility_id, loan_id FROM bad GROUP BY 1, 2, 3, as_of_date HAVING COUNT(*) > 1)
    SELECT 'stratification' AS analysis, COUNT(*) AS refused FROM bad WHERE outstanding_balance IS NULL UNION ALL SELECT 'vintage', COUNT(*) FROM (SELECT * FROM moved UNION SELECT * FROM twice)""")
)
def a1_a3_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the strict analyses refuse of a tape with missing balances, original balances that change and loans twice on a date."""
    k, fields = F.col("loan_id").cast("long"), [*KEY, "as_of_date", "outstanding_balance", "origination_date", "original_balance", "period_idx"]
    rows = tape(spark, sf_dir).select(*fields)
    moved = rows.withColumn("original_balance", (F.col("original_balance") + F.when((k % 53 == 0) & (F.col("period_idx") == 2), 1).otherwise(0)).cast("decimal(20,2)"))
    again = rows.where((k % 59 == 0) & (F.col("period_idx") == 1) & F.col("outstanding_balance").isNotNull()).withColumn("outstanding_balance", (F.col("outstanding_balance") + 1).cast("decimal(20,2)"))
    bad = moved.unionByName(again)
    counted = lambda name, df: df.agg(F.count("*").alias("refused")).select(F.lit(name).alias("analysis"), "refused")
    return counted("stratification", balance_conflicts(bad)).union(counted("vintage", vintage.conflicts(bad, KEY)))


@query(ORACLE_SQL["a3_snapshot_vintage"])
def a3_strict_vintage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same figures where every row has passed the refusals."""
    return vintage.vintage(tape(spark, sf_dir), KEY, F.lit(PERIODS[-1]).cast("date"), "quarter", 12, 30, strict=True)
