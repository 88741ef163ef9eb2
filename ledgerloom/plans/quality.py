"""Data quality, profiles and reconciliation over the derived tape, as raw text where raw text is what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as q
from .registry import query
from .tape import KEY, PERIODS, digest_sums_sql, tape, with_tape

LAST = PERIODS[-1]
_RAW = f"""
    , raw AS (SELECT *, CAST(CASE WHEN CAST(loan_id AS BIGINT) % 201 = 0 THEN '1e5' ELSE CAST(outstanding_balance AS VARCHAR) END AS VARCHAR) AS bal,
        CASE WHEN CAST(loan_id AS BIGINT) % 301 = 0 THEN '1999-02-30' ELSE CAST(as_of_date AS VARCHAR) END AS as_of_text, CASE WHEN CAST(loan_id AS BIGINT) % 401 = 0 THEN '' ELSE loan_id END AS id FROM tape WHERE period_idx = 3)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot as delivered text, with some bad cells."""
    rows = tape(spark, sf_dir).where("period_idx = 3")
    n = F.col("loan_id").cast("long")
    cells = {c: F.col(c).cast("string") for c in rows.columns}
    cells["outstanding_balance"] = F.when(n % 201 == 0, "1e5").otherwise(F.col("outstanding_balance").cast("string"))
    cells["as_of_date"] = F.when(n % 301 == 0, "1999-02-30").otherwise(F.col("as_of_date").cast("string"))
    cells["loan_id"] = F.when(n % 401 == 0, "").otherwise(F.col("loan_id"))
    return rows.select(*[e.alias(c) for c, e in cells.items()])


PROFILE = q.Profile(
    keys=KEY,
    required=["outstanding_balance", "risk_rating"],
    decimals=["outstanding_balance"],
    not_negative=["outstanding_balance", "original_balance"],
    dates=["as_of_date", "origination_date"],
    date_orders=[("origination_date", "maturity_date")],
    codes={"risk_rating": ["1-urgent", "2-high", "3-medium"]},
    null_rates={"interest_rate": 0.01, "recovery_amount": 0.9},
    as_of=LAST,
    currency="USD",
    max_age_days=45,
    status_dpd=30,
)
_NUM = r"regexp_matches(bal, '^-?(0|[1-9][0-9]*)(\.[0-9]+)?$')"
_B = f"COALESCE(CASE WHEN {_NUM} THEN TRY_CAST(bal AS DECIMAL(38,6)) END, 0)"


def _finding(code: str, name: str, cond: str, severity: str) -> str:
    return f"SELECT '{code}' AS code, '{name}' AS field, COUNT(*) AS affected_rows, CAST(COALESCE(SUM({_B}), 0) AS DECIMAL(38,2)) AS affected_balance, '{severity}' AS severity FROM raw WHERE {cond} HAVING COUNT(*) > 0"


_FINDINGS = " UNION ALL ".join(
    [
        _finding("required_value_missing", "outstanding_balance", "bal IS NULL", "critical"),
        _finding("required_value_missing", "risk_rating", "risk_rating IS NULL", "critical"),
        _finding("grain_key_missing", "loan_id", "id = ''", "critical"),
        _finding("exact_decimal_invalid", "outstanding_balance", f"bal IS NOT NULL AND NOT {_NUM}", "critical"),
        _finding("date_value_invalid", "as_of_date", "as_of_text = '1999-02-30'", "critical"),
        _finding("date_order_invalid", "maturity_date", "origination_date > maturity_date", "error"),
        _finding("code_value_unknown", "risk_rating", "risk_rating IS NOT NULL AND lower(risk_rating) NOT IN ('1-urgent', '2-high', '3-medium')", "warning"),
        _finding("status_delinquency_inconsistent", "loan_status", "(loan_status = 'current' AND days_past_due >= 30) OR (loan_status = 'delinquent' AND days_past_due = 0)", "error"),
        "SELECT 'null_rate_exceeded', 'interest_rate', SUM((interest_rate IS NULL)::INT), CAST(0 AS DECIMAL(38,2)), 'error' FROM raw HAVING AVG((interest_rate IS NULL)::INT) > 0.01",
        "SELECT 'mixed_currency_population', 'currency', COUNT(*), CAST(0 AS DECIMAL(38,2)), 'error' FROM raw HAVING COUNT(DISTINCT currency) > 1",
        "SELECT 'duplicate_grain_key', '', SUM(n), CAST(0 AS DECIMAL(38,2)), 'critical' FROM (SELECT COUNT(*) AS n FROM raw GROUP BY source_system, facility_id, id HAVING COUNT(*) > 1) HAVING SUM(n) > 0",
    ]
)


@query(with_tape(f"{_RAW} SELECT code, field, CAST(affected_rows AS BIGINT) AS affected_rows, affected_balance, severity FROM ({_FINDINGS})"))
def q1_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.run_quality(raw(spark, sf_dir), PROFILE)


@query(with_tape(f"{_RAW} SELECT CASE WHEN SUM((severity <> 'warning')::INT) > 0 THEN 'block' ELSE 'publish' END AS decision, COUNT(*) AS findings FROM ({_FINDINGS})"))
def q1_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.decision(q.run_quality(raw(spark, sf_dir), PROFILE))


_RAW_TEXT = sorted(["period_idx", "as_of_date", "source_system", "facility_id", "loan_id", "borrower_id", "loan_status", "origination_date", "original_balance", "outstanding_balance", "commitment_amount", "days_past_due", "default_flag", "charge_off_amount", "recovery_amount", "scheduled_principal_amount", "risk_rating", "industry_code", "interest_rate", "maturity_date", "default_date", "currency"])
_TEXT_OF = {"outstanding_balance": "bal", "as_of_date": "as_of_text", "loan_id": "id"}


@query(
    with_tape(
        f"""{_RAW}, f AS (SELECT code, field, CAST(affected_rows AS BIGINT) AS affected_rows, affected_balance, severity FROM ({_FINDINGS})),
    a AS (SELECT COUNT(*) || ':' || {digest_sums_sql("d")} AS rows FROM (SELECT sha256(to_json([{", ".join(f"CAST({_TEXT_OF.get(c, c)} AS VARCHAR)" for c in _RAW_TEXT)}])) AS d FROM raw)),
    b AS (SELECT COUNT(*) || ':' || {digest_sums_sql("d")} AS findings FROM (SELECT sha256(to_json([{", ".join(f"CAST({c} AS VARCHAR)" for c in ("affected_balance", "affected_rows", "code", "field", "severity"))}])) AS d FROM f))
    SELECT sha256('loan-tape-1|' || rows || '|' || findings) AS fingerprint FROM a, b"""
    )
)
def q2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir)
    return q.fingerprint(rows, q.run_quality(rows, PROFILE), "loan-tape-1")


RULES = [
    q.Rule("rating-known", "required", "risk_rating", blocks=True),
    q.Rule("rating-allowed", "allowed_values", "risk_rating", values=["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]),
    q.Rule("rate-range", "decimal_range", "interest_rate", low="1", high="11"),
    q.Rule("sum", "equals_sum", "commitment_amount", parts=["original_balance", "fee"], tolerance="0.5"),
    q.Rule("borrower-once", "unique", "borrower_id"),
]
_V2 = [
    ("rating-known", "risk_rating IS NULL", "block"),
    ("rating-allowed", "risk_rating IS NULL OR risk_rating NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')", "warn"),
    ("rate-range", "COALESCE(interest_rate < 1 OR interest_rate > 11, FALSE)", "warn"),
    ("sum", "COALESCE(ABS(commitment_amount - (original_balance + fee)) > 0.5, TRUE)", "warn"),
    ("borrower-once", "COUNT(borrower_id) OVER (PARTITION BY borrower_id) > 1", "warn"),
]


@query(
    with_tape(
        ", t3 AS (SELECT *, CAST(CASE WHEN CAST(loan_id AS BIGINT) % 5 = 0 THEN NULL WHEN CAST(loan_id AS BIGINT) % 7 = 0 THEN 999 ELSE 1000 END AS DECIMAL(20,2)) AS fee FROM tape WHERE period_idx = 3), w AS (SELECT SUM(COALESCE(outstanding_balance, 0)) AS whole FROM t3) "
        + " UNION ALL ".join(
            f"SELECT '{n}' AS rule_id, CAST(COALESCE(SUM(v::INT), 0) AS BIGINT) AS affected_rows, CAST(COALESCE(SUM(CASE WHEN v THEN b ELSE 0 END), 0) AS DECIMAL(38,2)) AS affected_balance, CAST(COALESCE(SUM(CASE WHEN v THEN b ELSE 0 END), 0) AS DOUBLE) / CAST(MAX(whole) AS DOUBLE) AS affected_share, "
            f"COALESCE(SUM(CASE WHEN v THEN b ELSE 0 END), 0) >= 1000000 AS material, CASE WHEN COALESCE(SUM(v::INT), 0) = 0 THEN 'pass' ELSE '{o}' END AS outcome FROM (SELECT {c} AS v, COALESCE(outstanding_balance, 0) AS b FROM t3), w"
            for n, c, o in _V2
        )
    )
)
def q3_rules_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("loan_id").cast("long")
    rows = tape(spark, sf_dir).where("period_idx = 3").withColumn("fee", F.when(n % 5 == 0, None).when(n % 7 == 0, 999).otherwise(1000).cast("decimal(20,2)"))
    return q.run_quality_v2(rows, RULES, "outstanding_balance", "1000000")


COLUMNS = ["risk_rating", "interest_rate", "days_past_due", "loan_status", "maturity_date"]
_CELLS = " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value FROM tape WHERE period_idx = {{0}}" for c in COLUMNS)
_PROFILE = r"""
    {1} AS (SELECT field, COUNT(*) AS rows, SUM((value IS NULL)::INT) AS nulls, COUNT(DISTINCT value) AS dis,
        array_to_string(list_sort(list(DISTINCT CASE WHEN regexp_matches(value, '^-?(0|[1-9][0-9]*)$') THEN 'integer' WHEN regexp_matches(value, '^-?(0|[1-9][0-9]*)(\.[0-9]+)?$') THEN 'decimal' WHEN regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN 'date' ELSE 'text' END) FILTER (value IS NOT NULL)), ',') AS kinds
        FROM ({0}) GROUP BY field)"""


@query(
    with_tape(
        f""", {_PROFILE.format(_CELLS.format(3), "p")}
    SELECT field, rows, CAST(nulls AS BIGINT) AS nulls, CAST(nulls AS DOUBLE) / rows AS null_share, dis AS "distinct", CASE WHEN rows > nulls THEN CAST(dis AS DOUBLE) / CAST(rows - nulls AS DOUBLE) END AS uniqueness, kinds,
        CASE field WHEN 'interest_rate' THEN 'percentage' WHEN 'days_past_due' THEN 'days' WHEN 'maturity_date' THEN 'date' ELSE 'unknown' END AS unit, CASE field WHEN 'risk_rating' THEN 'stock' WHEN 'loan_status' THEN 'stock' ELSE 'unknown' END AS temporal FROM p"""
    )
)
def q4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.profile(tape(spark, sf_dir).where("period_idx = 3"), COLUMNS).drop("least", "greatest")


@query(
    with_tape(
        f""", c AS (SELECT field, value, COUNT(*) AS n FROM ({_CELLS.format(3)}) WHERE value IS NOT NULL GROUP BY 1, 2), w AS (SELECT field, SUM(n) AS whole FROM c GROUP BY 1),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c)
    SELECT field, rank, value, n, CAST(n AS DOUBLE) / CAST(whole AS DOUBLE) AS share FROM r JOIN w USING (field) WHERE rank <= 4"""
    )
)
def q4_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.top_values(tape(spark, sf_dir).where("period_idx = 3"), COLUMNS, 4)


_FREQUENT = ["industry_code", "risk_rating", "loan_id", "facility_id"]
_LONG = " UNION ALL ".join(f"SELECT '{c}' AS field, NULLIF(TRIM({c}), '') AS value FROM tape" for c in _FREQUENT)


@query(
    with_tape(
        f""", c AS (SELECT field, value, COUNT(*) AS n FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY 1, 2), w AS (SELECT field, SUM(n) AS whole FROM c GROUP BY 1),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM c)
    SELECT field, rank, value, n, CAST(n AS DOUBLE) / CAST(whole AS DOUBLE) AS share FROM r JOIN w USING (field) WHERE rank <= 5"""
    )
)
def q4_frequent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent values of four fields over all dates by bounded counters; loan ids, of which none is frequent, in full."""
    return q.frequent_values(tape(spark, sf_dir), _FREQUENT, 5, counters=64)


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = tape(spark, sf_dir)
    before = rows.where("period_idx = 0")
    after = rows.where("period_idx = 3").withColumn("days_past_due", F.when(F.col("days_past_due") > 20, F.col("days_past_due")))
    return before, after


_AFTER = _CELLS.format(3).replace("CAST(days_past_due AS VARCHAR)", "CAST(CASE WHEN days_past_due > 20 THEN days_past_due END AS VARCHAR)").replace("SELECT 'maturity_date' AS field", "SELECT 'due_date' AS field")


@query(
    with_tape(
        f""", {_PROFILE.format(_CELLS.format(0), "p0")}, {_PROFILE.format(_AFTER, "p1")},
    j AS (SELECT COALESCE(a.field, b.field) AS field, a.kinds AS k0, b.kinds AS k1, CAST(a.nulls AS DOUBLE) / a.rows AS s0, CAST(b.nulls AS DOUBLE) / b.rows AS s1, a.field IS NULL AS add, b.field IS NULL AS rem FROM p0 a FULL JOIN p1 b ON a.field = b.field)
    SELECT field, 'added' AS change, s0 AS share_before, s1 AS share_after FROM j WHERE add UNION ALL SELECT field, 'removed', s0, s1 FROM j WHERE rem UNION ALL SELECT field, 'type', s0, s1 FROM j WHERE NOT add AND NOT rem AND k0 <> k1
    UNION ALL SELECT field, 'null_share', s0, s1 FROM j WHERE NOT add AND NOT rem AND abs(s1 - s0) > 0.05"""
    )
)
def q5_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = _two(spark, sf_dir)
    renamed = after.withColumnRenamed("maturity_date", "due_date")
    return q.drift(q.profile(before, COLUMNS), q.profile(renamed, [*COLUMNS[:-1], "due_date"]))


@query(
    with_tape("""
    , a AS (SELECT loan_status AS value, COUNT(*) AS n FROM tape WHERE period_idx = 0 GROUP BY 1), b AS (SELECT loan_status AS value, COUNT(*) AS n FROM tape WHERE period_idx = 3 AND industry_code = 'BUILDING' GROUP BY 1),
    s AS (SELECT COALESCE(a.value, b.value) AS value, COALESCE(CAST(a.n AS DOUBLE) / (SELECT SUM(n) FROM a), 0) AS s0, COALESCE(CAST(b.n AS DOUBLE) / (SELECT SUM(n) FROM b), 0) AS s1 FROM a FULL JOIN b ON a.value = b.value)
    SELECT 'loan_status' AS field, value, s0, s1, s1 - s0 AS moved FROM s WHERE abs(s1 - s0) >= 0.0001""")
)
def q5_category_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir)
    return q.category_drift(rows.where("period_idx = 0"), rows.where("period_idx = 3 AND industry_code = 'BUILDING'"), ["loan_status"], 0.0001)


_DECLARED = "SELECT as_of_date, COUNT(*) + CASE WHEN as_of_date = DATE '1999-10-31' THEN 1 ELSE 0 END AS row_count, CAST(SUM(COALESCE(outstanding_balance, 0)) + CASE WHEN as_of_date = DATE '1999-11-30' THEN 5 ELSE 0 END AS DECIMAL(38,2)) AS balance, 'USD' AS declared_currency FROM tape WHERE period_idx < 3 GROUP BY as_of_date"
_CONTROLS = f"""
    , declared AS ({_DECLARED}), act AS (SELECT as_of_date, COUNT(*) AS rows, CAST(SUM(COALESCE(outstanding_balance, 0)) AS DECIMAL(38,2)) AS actual_balance, MIN(currency) AS c0, MAX(currency) AS c1 FROM tape GROUP BY 1),
    j AS (SELECT COALESCE(d.as_of_date, a.as_of_date) AS as_of_date, rows, row_count, actual_balance, balance, CAST(abs(COALESCE(actual_balance, 0) - COALESCE(balance, 0)) AS DECIMAL(38,2)) AS difference, c0, c1, declared_currency FROM declared d FULL JOIN act a ON d.as_of_date = a.as_of_date),
    r AS (SELECT as_of_date, rows, row_count, actual_balance, balance, difference, concat_ws(',', CASE WHEN rows IS NULL THEN 'missing_population' END, CASE WHEN row_count IS NULL THEN 'undeclared_population' END, CASE WHEN rows <> row_count THEN 'row_count_mismatch' END,
        CASE WHEN difference > 0.01 THEN 'balance_mismatch' END, CASE WHEN c0 <> c1 OR c0 <> declared_currency THEN 'currency_mismatch' END) AS reasons FROM j)"""


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir)
    rows.createOrReplaceTempView("tape")
    return q.reconcile(rows, spark.sql(_DECLARED), ["as_of_date"], "0.01")


@query(with_tape(f"{_CONTROLS} SELECT *, reasons = '' AS passed FROM r"))
def q6_control_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controls(spark, sf_dir)


@query(
    with_tape("""
    , a AS (SELECT facility_id, COALESCE(risk_rating, '[NULL]') AS risk_rating, currency, SUM(outstanding_balance) AS v FROM tape WHERE period_idx = 3 GROUP BY ALL),
    e AS (SELECT facility_id, COALESCE(risk_rating, '[NULL]') AS risk_rating, currency, SUM(outstanding_balance + CASE WHEN CAST(loan_id AS BIGINT) % 1000 = 7 THEN 1 ELSE 0 END) AS v FROM tape WHERE period_idx = 3 AND facility_id <> 'F3' GROUP BY ALL)
    SELECT COALESCE(a.facility_id, e.facility_id) AS facility_id, COALESCE(a.risk_rating, e.risk_rating) AS risk_rating, COALESCE(a.currency, e.currency) AS currency, CAST(e.v AS DECIMAL(38,2)) AS expected, CAST(a.v AS DECIMAL(38,2)) AS actual,
        CAST(COALESCE(a.v, 0) - COALESCE(e.v, 0) AS DECIMAL(38,2)) AS difference, CAST(abs(COALESCE(a.v, 0) - COALESCE(e.v, 0)) AS DECIMAL(38,2)) <= 0.005 AS passed
    FROM a FULL JOIN e ON a.facility_id = e.facility_id AND a.risk_rating = e.risk_rating AND a.currency = e.currency""")
)
def q7_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir).where("period_idx = 3").withColumn("balance", F.col("outstanding_balance"))
    shifted = rows.where("facility_id <> 'F3'").withColumn("balance", (F.col("balance") + F.when(F.col("loan_id").cast("long") % 1000 == 7, 1).otherwise(0)).cast("decimal(20,2)"))
    return q.reconcile_segments(rows, shifted, ["facility_id", "risk_rating"], "0.005")


@query(
    with_tape(
        f"""{_RAW}{_CONTROLS}, b AS (SELECT code AS blocker FROM ({_FINDINGS}) WHERE severity <> 'warning' UNION SELECT unnest(string_split(reasons, ',')) FROM r WHERE reasons <> '')
    SELECT CASE WHEN COUNT(*) = 0 THEN 'certified' ELSE 'failed' END AS status, COALESCE(string_agg(DISTINCT blocker, ',' ORDER BY blocker), '') AS blockers FROM b"""
    )
)
def q8_certify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.certify(q.run_quality(raw(spark, sf_dir), PROFILE), _controls(spark, sf_dir))
