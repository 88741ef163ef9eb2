"""Borrowing bases over receivables and collateral derived from the star schema: all facilities and dates in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import borrowing as b
from .registry import query
from .tape import views

SCOPE = ["facility_id"]
# Receivables: line items of an order and supplier, the supplier is the debtor, its nation the facility.
_RECEIVABLES = """
    receivables AS (SELECT CONCAT('F', CAST(s_nationkey AS VARCHAR(10))) AS facility_id, CONCAT(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS receivable_id, CAST(l_suppkey AS VARCHAR(20)) AS debtor_id,
        CAST(SUM(CAST(l_extendedprice AS DECIMAL(20,2))) AS DECIMAL(20,2)) AS outstanding_amount, CAST((l_orderkey * 3 + l_suppkey) % 140 AS INT) AS days_past_due, l_orderkey % 31 = 0 AS disputed
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY s_nationkey, l_orderkey, l_suppkey),
    usage AS (SELECT CONCAT('F', CAST(n_nationkey AS VARCHAR(10))) AS facility_id, CAST(1000000 + n_nationkey * 250000 AS DECIMAL(20,2)) AS amount FROM nation)"""


def receivables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    views(spark, sf_dir, "lineitem", "supplier", "nation")
    rows = spark.sql(f"WITH {_RECEIVABLES} SELECT * FROM receivables")
    flagged = rows.withColumn("flags", F.when(F.col("disputed"), F.array(F.lit("disputed"))).otherwise(F.array().cast("array<string>")))
    return flagged, spark.sql(f"WITH {_RECEIVABLES} SELECT * FROM usage")


AR = b.ArPolicy(
    rules=[("past-due", 10, {"op": "days_past_due_at_least", "days": 90}), ("disputed", 20, {"op": "all", "args": [{"op": "has_flag", "flag": "disputed"}, {"op": "not", "arg": {"op": "debtor_in", "debtors": ["1"]}}]})],
    advance_rate="0.8",
    sublimit="9000000",
    reserve="50000",
    commitment="8000000",
    cross_age_days=90,
    cross_age_ratio="0.37",
    concentration="0.1",
    allocation="largest",
)
_AR_ROWS = f"""{_RECEIVABLES},
    r1 AS (SELECT *, CAST(outstanding_amount AS DECIMAL(24,6)) AS gross, CASE WHEN days_past_due >= 90 THEN 'past-due' WHEN disputed AND debtor_id <> '1' THEN 'disputed' END AS rule_id FROM receivables),
    r2 AS (SELECT *, CASE WHEN rule_id IS NULL THEN gross ELSE 0 END AS left1, SUM(CASE WHEN days_past_due >= 90 THEN gross ELSE 0 END) OVER w AS old, SUM(gross) OVER w AS dg FROM r1 WINDOW w AS (PARTITION BY facility_id, debtor_id)),
    r3 AS (SELECT *, CAST(CASE WHEN dg > 0 AND old >= dg * CAST(0.37 AS DECIMAL(24,6)) THEN left1 ELSE 0 END AS DECIMAL(24,6)) AS cross_aged FROM r2),
    r4 AS (SELECT *, CAST(left1 - cross_aged AS DECIMAL(24,6)) AS left2 FROM r3),
    r5 AS (SELECT *, SUM(left2) OVER (PARTITION BY facility_id) AS whole, SUM(left2) OVER (PARTITION BY facility_id, debtor_id) AS dl,
        COALESCE(SUM(left2) OVER (PARTITION BY facility_id, debtor_id ORDER BY left2 DESC, receivable_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior FROM r4),
    r6 AS (SELECT *, CAST(greatest(least(left2, greatest(dl - CAST(whole AS DECIMAL(28,6)) * CAST(0.1 AS DECIMAL(5,1)), 0) - prior), 0) AS DECIMAL(24,6)) AS concentration FROM r5)"""
_AR_BASE = f"""{_AR_ROWS},
    s AS (SELECT facility_id, SUM(gross) AS gross, SUM(gross - left1) AS ineligible, SUM(cross_aged) AS cross_aged, SUM(concentration) AS concentration, CAST(SUM(left2 - concentration) AS DECIMAL(24,6)) AS eligible FROM r6 GROUP BY 1),
    t AS (SELECT s.*, COALESCE(u.amount, 0) AS usage, CAST(CAST(eligible AS DECIMAL(28,6)) * CAST(0.8 AS DECIMAL(3,1)) AS DECIMAL(24,6)) AS advanced FROM s LEFT JOIN usage u USING (facility_id)),
    v AS (SELECT *, least(advanced, 9000000) AS after_sublimit FROM t), x AS (SELECT *, least(after_sublimit, 50000) AS reserves FROM v), y AS (SELECT *, after_sublimit - reserves AS after_reserves FROM x), z AS (SELECT *, least(after_reserves, 8000000) AS base FROM y)"""
_C = "CAST({0} AS DECIMAL(38,2)) AS {0}"
_AR_COLS = ["gross", "ineligible", "cross_aged", "concentration", "eligible", "usage", "advanced", "after_sublimit", "reserves", "after_reserves", "base"]


def _round(df: DataFrame, columns: list[str]) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, F.round(c, 2).cast("decimal(38,2)"))
    return df


_R = "CAST(ROUND({0}, 2) AS DECIMAL(38,2)) AS {0}"


@query(f"WITH {_AR_ROWS} SELECT facility_id, receivable_id, rule_id, {_R.format('gross')}, {_R.format('cross_aged')}, {_R.format('concentration')}, CAST(ROUND(left2 - concentration, 2) AS DECIMAL(38,2)) AS eligible FROM r6 WHERE concentration > 0 OR cross_aged > 0 OR rule_id IS NOT NULL")
def b2_b4_receivable_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = receivables(spark, sf_dir)
    out = b.ar_receivables(rows, AR, SCOPE).where("concentration > 0 or cross_aged > 0 or rule_id is not null")
    return _round(out.select("facility_id", "receivable_id", "rule_id", "gross", "cross_aged", "concentration", "eligible"), ["gross", "cross_aged", "concentration", "eligible"])


@query(f"WITH {_AR_BASE} SELECT facility_id, {', '.join(_R.format(c) for c in _AR_COLS)}, CAST(ROUND(base - usage, 2) AS DECIMAL(38,2)) AS availability, CAST(ROUND(greatest(usage - base, 0), 2) AS DECIMAL(38,2)) AS overadvance FROM z")
def b1_ar_borrowing_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, usage = receivables(spark, sf_dir)
    return _round(b.ar_base(rows, usage, AR, SCOPE), [*_AR_COLS, "availability", "overadvance"])


@query(
    f"""WITH {_AR_BASE}, l AS (SELECT facility_id, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS sequence, unnest(['ineligible', 'cross_aged', 'concentration', 'advance', 'sublimit', 'reserves', 'commitment', 'usage']) AS step,
        unnest([ineligible, cross_aged, concentration, eligible - advanced, advanced - after_sublimit, reserves, after_reserves - base, usage]) AS a, gross FROM z),
    q AS (SELECT *, gross - SUM(a) OVER (PARTITION BY facility_id ORDER BY sequence) AS after FROM l)
    SELECT facility_id, sequence, step, CAST(ROUND(after + a, 2) AS DECIMAL(38,2)) AS before, CAST(ROUND(-a, 2) AS DECIMAL(38,2)) AS adjustment, {_R.format("after")} FROM q"""
)
def b6_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, usage = receivables(spark, sf_dir)
    return _round(b.waterfall(b.ar_base(rows, usage, AR, SCOPE), SCOPE), ["before", "adjustment", "after"])


# Collateral of four classes: orders by their priority; a customer's market segment is the concentration group.
_COLLATERAL = """
    collateral AS (SELECT CONCAT('F', CAST(c_nationkey AS VARCHAR(10))) AS facility_id, CAST(o_orderkey AS VARCHAR(20)) AS record_id,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'AR' WHEN '2' THEN 'inventory' WHEN '3' THEN 'equipment' WHEN '4' THEN 'cash' ELSE 'AR' END AS collateral_class,
        CAST(o_totalprice AS DECIMAL(20,2)) AS gross_value, o_orderkey % 7 <> 0 AS eligible, CAST(CASE WHEN o_orderkey % 3 = 0 THEN greatest(CAST(o_totalprice AS DECIMAL(20,2)) - CAST(o_orderkey % 1000 AS DECIMAL(20,2)), 0) ELSE CAST(o_totalprice AS DECIMAL(20,2)) END AS DECIMAL(20,2)) AS basis_value,
        CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_mktsegment END AS concentration_group
    FROM orders JOIN customer ON c_custkey = o_custkey),
    usage AS (SELECT CONCAT('F', CAST(n_nationkey AS VARCHAR(10))) AS facility_id, CAST(5000000 + n_nationkey * 4000000 AS DECIMAL(20,2)) AS amount FROM nation)"""

POLICY = b.Policy(
    components=[b.Component("AR", "0.85", None, [("8000000", "0.5"), (None, "0.2")]), b.Component("inventory", "0.5", "7000000"), b.Component("equipment", "0.4"), b.Component("cash", "1")],
    reserves=[("fixed", {"kind": "fixed", "amount": "100000"}), ("nested", {"kind": "sum", "args": [{"kind": "percentage", "basis": "contribution", "rate": "0.02"}, {"kind": "amount_above", "basis": "AR_eligible", "threshold": "2000000", "rate": "0.1"}]})],
    commitment="60000000",
    triggers=[("low-excess", "excess", "2000000", "500000"), ("high-use", "utilisation", "0.75", "0"), ("over", "overadvance", "1000000", "cash_dominion")],
)


def collateral(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    views(spark, sf_dir, "orders", "customer", "nation")
    return spark.sql(f"WITH {_COLLATERAL} SELECT * FROM collateral"), spark.sql(f"WITH {_COLLATERAL} SELECT * FROM usage")


_RATE = "CASE collateral_class WHEN 'AR' THEN 0.85 WHEN 'inventory' THEN 0.50 WHEN 'equipment' THEN 0.40 ELSE 1.00 END"
_LIMIT = "CASE collateral_class WHEN 'inventory' THEN 7000000 END"


def _component_sql(keys: str, source: str = "collateral", rate: str = _RATE, sublimit: str = _LIMIT) -> str:
    k = keys
    return f"""
    g AS (SELECT {k}, collateral_class, COALESCE(concentration_group, 'Ungrouped') AS cg, CAST(SUM(CAST(basis_value AS DECIMAL(24,6))) AS DECIMAL(24,6)) AS g FROM {source} WHERE eligible GROUP BY ALL),
    w AS (SELECT *, SUM(g) OVER (PARTITION BY {k}, collateral_class) AS whole FROM g),
    e AS (SELECT *, CAST(CASE WHEN collateral_class = 'AR' THEN greatest(g - CAST(whole AS DECIMAL(28,6)) * CASE WHEN g <= 8000000 THEN CAST(0.5 AS DECIMAL(3,1)) ELSE CAST(0.2 AS DECIMAL(3,1)) END, 0) ELSE 0 END AS DECIMAL(24,6)) AS excess FROM w),
    el AS (SELECT {k}, collateral_class, SUM(g) AS pre_concentration, SUM(excess) AS concentration_excess FROM e GROUP BY ALL),
    gr AS (SELECT {k}, collateral_class, SUM(CAST(gross_value AS DECIMAL(24,6))) AS gross FROM {source} GROUP BY ALL),
    c1 AS (SELECT gr.*, COALESCE(pre_concentration, 0) AS pre_concentration, COALESCE(concentration_excess, 0) AS concentration_excess FROM gr LEFT JOIN el USING ({k}, collateral_class)),
    c2 AS (SELECT *, CAST(pre_concentration - concentration_excess AS DECIMAL(24,6)) AS eligible FROM c1),
    c3 AS (SELECT *, CAST(CAST(eligible AS DECIMAL(28,6)) * CAST({rate} AS DECIMAL(6,4)) AS DECIMAL(24,6)) AS advanced FROM c2),
    comp AS (SELECT *, least(advanced, COALESCE({sublimit}, advanced)) AS contribution FROM c3)"""


_NESTED = "ROUND(contribution * CAST(0.02 AS DECIMAL(3,2)), 6) + ROUND(greatest(ar - 2000000, 0) * CAST(0.1 AS DECIMAL(2,1)), 6)"


def _state_sql(keys: str, reserves: str = f"100000 + {_NESTED}", commitment: str = "60000000", block: str = "0", levers: str = "") -> str:
    return f"""
    f1 AS (SELECT {keys}, SUM(contribution) AS contribution, SUM(CASE WHEN collateral_class = 'AR' THEN eligible ELSE 0 END) AS ar FROM comp GROUP BY ALL),
    f2 AS (SELECT f1.*, COALESCE(amount, 0) AS usage, {reserves} AS reserves, {commitment} AS commitment, {block} AS extra FROM f1 LEFT JOIN usage USING (facility_id) {levers}),
    f3 AS (SELECT *, least(greatest(contribution - reserves, 0), commitment) AS before FROM f2),
    f4 AS (SELECT *, CASE WHEN before > 0 THEN CAST(usage AS DOUBLE) / CAST(before AS DOUBLE) WHEN usage > 0 THEN 1.0 ELSE 0.0 END AS util FROM f3),
    f5 AS (SELECT *, extra + CASE WHEN before - usage < 2000000 THEN 500000 ELSE 0 END AS blocks, usage - before > 1000000 AS cash_dominion, concat_ws(',', CASE WHEN before - usage < 2000000 THEN 'low-excess' END, CASE WHEN util > 0.75 THEN 'high-use' END, CASE WHEN usage - before > 1000000 THEN 'over' END) AS triggers FROM f4),
    f6 AS (SELECT *, greatest(before - blocks, 0) AS capacity FROM f5)"""


_COMP = ["gross", "pre_concentration", "concentration_excess", "eligible", "advanced", "contribution"]


@query(f"WITH {_COLLATERAL},{_component_sql('facility_id')} SELECT facility_id, collateral_class, {', '.join(_R.format(c) for c in _COMP)} FROM comp")
def b7_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = collateral(spark, sf_dir)
    return _round(b.component_base(rows, POLICY, SCOPE), _COMP)


_STATE = "CAST(ROUND(contribution, 1) AS DECIMAL(38,1)) AS contribution, CAST(ROUND(reserves, 1) AS DECIMAL(38,1)) AS reserves, CAST(ROUND(capacity, 1) AS DECIMAL(38,1)) AS capacity, CAST(ROUND(capacity - usage, 1) AS DECIMAL(38,1)) AS excess, CAST(ROUND(greatest(usage - capacity, 0), 1) AS DECIMAL(38,1)) AS overadvance, CAST(blocks AS DECIMAL(38,1)) AS blocks, triggers, cash_dominion, ROUND(util, 6) AS utilisation"


_STATE_COLUMNS = ["contribution", "reserves", "capacity", "excess", "overadvance", "blocks", "triggers", "cash_dominion", "utilisation"]


def _state_out(df: DataFrame, *keys: str) -> DataFrame:
    tenth = lambda c: F.round(c, 1).cast("decimal(38,1)").alias(c)
    rest = [tenth(c) for c in df.columns if c.endswith("_change")]
    return df.select(*keys, *[tenth(c) for c in _STATE_COLUMNS[:6]], "triggers", "cash_dominion", F.round("utilisation", 6).alias("utilisation"), *rest)


@query(f"WITH {_COLLATERAL},{_component_sql('facility_id')},{_state_sql('facility_id')} SELECT facility_id, {_STATE} FROM f6")
def b9_b12_facility_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, usage = collateral(spark, sf_dir)
    state = b.facility_state(b.component_base(rows, POLICY, SCOPE), usage, POLICY, SCOPE)
    return _state_out(state, "facility_id")


#: scenario, class, value multiplier, rate multiplier; and scenario, reserve delta, commitment.
_ASSUMED = [("ar-down", "AR", "0.7", None), ("all-down", "AR", "0.8", "0.9"), ("all-down", "inventory", "0.5", None), ("all-down", "equipment", None, "1.5")]
_SCENARIOS = [("same", "0", None), ("ar-down", "0", None), ("all-down", "250000", "20000000"), ("more-room", "0", "90000000")]
_SQL = lambda v: "NULL" if v is None else f"'{v}'"
_CHANGES = ", ".join(f"CAST(ROUND(({x}) - ({y}), 1) AS DECIMAL(38,1)) AS {m}_change" for m, x, y in [(m, f"s.{m}", f"b.{m}") for m in ("contribution", "reserves", "capacity")] + [("excess", "s.capacity - s.usage", "b.capacity - b.usage"), ("overadvance", "greatest(s.usage - s.capacity, 0)", "greatest(b.usage - b.capacity, 0)")])


@query(
    f"""WITH {_COLLATERAL}, m AS (SELECT scenario_id, collateral_class, CAST(v AS DECIMAL(4,2)) AS v, CAST(r AS DECIMAL(4,2)) AS r FROM (VALUES {", ".join(f"({', '.join(map(_SQL, x))})" for x in _ASSUMED)}) AS t(scenario_id, collateral_class, v, r)),
    n AS (SELECT scenario_id, CAST(d AS DECIMAL(24,6)) AS delta, CAST(c AS DECIMAL(24,6)) AS promise FROM (VALUES {", ".join(f"({', '.join(map(_SQL, x))})" for x in _SCENARIOS)}) AS t(scenario_id, d, c)),
    base AS (WITH {_component_sql("facility_id")},{_state_sql("facility_id")} SELECT * FROM f6),
    sc AS (SELECT c.* EXCLUDE (basis_value), n.scenario_id, CAST(CAST(basis_value AS DECIMAL(24,6)) * COALESCE(m.v, CAST(1 AS DECIMAL(4,2))) AS DECIMAL(24,6)) AS basis_value FROM collateral c CROSS JOIN n LEFT JOIN m ON m.scenario_id = n.scenario_id AND m.collateral_class = c.collateral_class),
    {_component_sql("scenario_id, facility_id", "sc", f"CAST({_RATE} AS DECIMAL(4,2)) * COALESCE((SELECT r FROM m WHERE m.scenario_id = c2.scenario_id AND m.collateral_class = c2.collateral_class), CAST(1 AS DECIMAL(4,2)))")},
    {_state_sql("scenario_id, facility_id", f"n.delta + 100000 + {_NESTED}", "COALESCE(n.promise, 60000000)", "0", "JOIN n USING (scenario_id)")}
    SELECT s.scenario_id, s.facility_id, {_STATE.replace("ROUND(", "ROUND(s.").replace("ROUND(s.capacity - usage", "ROUND(s.capacity - s.usage").replace("ROUND(s.greatest(usage - capacity", "ROUND(greatest(s.usage - s.capacity").replace("CAST(blocks", "CAST(s.blocks").replace(" triggers, cash_dominion", " s.triggers, s.cash_dominion")}, {_CHANGES} FROM f6 s JOIN base b USING (facility_id)"""
)
def b17_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, usage = collateral(spark, sf_dir)
    assumed = spark.createDataFrame(_ASSUMED, "scenario_id string, collateral_class string, value_multiplier string, rate_multiplier string")
    scenarios = spark.createDataFrame(_SCENARIOS, "scenario_id string, reserve_delta string, commitment_override string")
    return _state_out(b.run_scenarios(rows, usage, POLICY, SCOPE, scenarios, assumed), "scenario_id", "facility_id")


def adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Governed adjustments of every kind, on some facilities each; one has ended before the day and one only begins."""
    n = F.col("n_nationkey")
    made = [("advance_rate_override", "AR", "0.9", n % 2 == 0), ("component_sublimit_override", "inventory", "2000000", n % 3 == 0), ("component_sublimit_waiver", "inventory", None, n % 3 == 1), ("reserve_override", "fixed", "350000", n % 4 == 1), ("reserve_waiver", "nested", None, n % 4 == 2), ("availability_block", None, "125000", n % 5 == 0), ("availability_block", None, "75000", n % 10 == 0)]
    each = F.array_compact(F.array(*[F.when(on, F.struct(F.lit(k).alias("kind"), F.lit(t).cast("string").alias("target"), F.lit(v).cast("string").alias("value"))) for k, t, v, on in made]))
    day = lambda d: F.lit(d).cast("date")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    live = nations.select(F.concat(F.lit("F"), n.cast("string")).alias("facility_id"), F.explode(each).alias("a")).select("facility_id", "a.*", day("1999-01-01").alias("effective_from"), day("1999-12-31").alias("effective_to"))
    off = nations.select(F.concat(F.lit("F"), n.cast("string")).alias("facility_id"), F.lit("advance_rate_override").alias("kind"), F.lit("AR").alias("target"), F.lit("0.1").alias("value"), F.when(n % 2 == 0, day("1998-01-01")).otherwise(day("2000-01-01")).alias("effective_from"), F.when(n % 2 == 0, day("1999-12-30")).alias("effective_to"))
    return live.union(off)


_N = "CAST(substr(facility_id, 2) AS INT)"
_METRICS = ["contribution", "reserves", "blocks", "capacity", "excess", "overadvance"]


@query(
    f"""WITH {_COLLATERAL}, l AS (WITH {_component_sql("facility_id")},{_state_sql("facility_id")} SELECT *, capacity - usage AS excess, greatest(usage - capacity, 0) AS overadvance FROM f6),
    r AS (WITH {_component_sql("facility_id", "collateral", f"CASE WHEN collateral_class = 'AR' AND {_N} % 2 = 0 THEN 0.90 ELSE {_RATE} END", f"CASE WHEN collateral_class = 'inventory' AND {_N} % 3 = 0 THEN 2000000 WHEN collateral_class = 'inventory' AND {_N} % 3 = 2 THEN 7000000 END")},
        {_state_sql("facility_id", f"CASE WHEN {_N} % 4 = 1 THEN 350000 ELSE 100000 END + CASE WHEN {_N} % 4 = 2 THEN 0 ELSE {_NESTED} END", "60000000", f"CASE WHEN {_N} % 5 = 0 THEN 125000 ELSE 0 END + CASE WHEN {_N} % 10 = 0 THEN 75000 ELSE 0 END")} SELECT *, capacity - usage AS excess, greatest(usage - capacity, 0) AS overadvance FROM f6)
    {" UNION ALL ".join(f"SELECT facility_id, '{m}' AS metric, CAST(ROUND(l.{m}, 1) AS DECIMAL(38,1)) AS left_value, CAST(ROUND(r.{m}, 1) AS DECIMAL(38,1)) AS right_value, CAST(ROUND(r.{m} - l.{m}, 1) AS DECIMAL(38,1)) AS variance FROM l JOIN r USING (facility_id)" for m in _METRICS)}"""
)
def b11_b14_adjusted_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state under all governed adjustments against the system's own."""
    rows, usage = collateral(spark, sf_dir)
    system = b.facility_state(b.component_base(rows, POLICY, SCOPE), usage, POLICY, SCOPE)
    classes, facilities = b.adjustment_levers(adjustments(spark, sf_dir), F.lit("1999-12-31").cast("date"), POLICY, SCOPE)
    adjusted = b.facility_state(b.component_base(rows, POLICY, SCOPE, classes), usage, POLICY, SCOPE, facilities)
    tenth = lambda c: F.round(c, 1).cast("decimal(38,1)").alias(c)
    return b.compare_states(system, adjusted, SCOPE, _METRICS).select("facility_id", "metric", *[tenth(c) for c in ("left_value", "right_value", "variance")])


@query(
    f"""WITH {_COLLATERAL},{_component_sql("facility_id")},{_state_sql("facility_id")}, cert AS (SELECT facility_id, CAST(ROUND(contribution, 2) AS DECIMAL(24,6)) AS contribution, CAST(ROUND(reserves, 2) AS DECIMAL(24,6)) AS reserves, CAST(blocks AS DECIMAL(24,6)) AS blocks, CAST(usage AS DECIMAL(24,6)) AS usage,
        CAST(greatest(least(greatest(ROUND(contribution, 2) - ROUND(reserves, 2), 0), 60000000) - blocks, 0) + CASE WHEN {_N} % 4 = 0 THEN 1 ELSE 0 END AS DECIMAL(24,6)) AS capacity FROM f6)
    SELECT facility_id, {_N} % 4 <> 0 AS capacity_ties, {_N} % 3 <> 0 AS excess_ties, CAST(ROUND(greatest(usage - capacity - CASE WHEN {_N} % 3 = 0 THEN 5 ELSE 0 END, 0), 1) AS DECIMAL(38,1)) AS overadvance FROM cert"""
)
def b13_submitted_certificates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What borrowers submit (here: the system's figures in cents, some with a wrong capacity or excess) and whether it ties."""
    rows, usage = collateral(spark, sf_dir)
    state = b.facility_state(b.component_base(rows, POLICY, SCOPE), usage, POLICY, SCOPE)
    n = F.substring("facility_id", 2, 9).cast("int")
    cents = lambda c: F.round(c, 2).cast(b.M).alias(c)
    cert = state.select("facility_id", cents("contribution"), cents("reserves"), F.col("blocks").cast(b.M).alias("blocks"), F.col("usage").cast(b.M).alias("usage"))
    tied = F.greatest(F.least(F.greatest(F.col("contribution") - F.col("reserves"), b.lit(0)), b.lit(POLICY.commitment)) - F.col("blocks"), b.lit(0))
    cert = cert.withColumn("capacity", (tied + F.when(n % 4 == 0, b.lit(1)).otherwise(b.lit(0))).cast(b.M))
    cert = cert.withColumn("excess", (F.col("capacity") - F.col("usage") + F.when(n % 3 == 0, b.lit(5)).otherwise(b.lit(0))).cast(b.M))
    out = b.submitted_states(cert, POLICY.commitment)
    return out.select("facility_id", "capacity_ties", "excess_ties", F.round("overadvance", 1).cast("decimal(38,1)").alias("overadvance"))


@query("SELECT s_suppkey, actual, threshold, comparator, CAST(CASE WHEN comparator = 'gte' THEN actual - threshold ELSE threshold - actual END AS DECIMAL(22,2)) AS headroom, CASE WHEN CASE WHEN comparator = 'gte' THEN actual - threshold ELSE threshold - actual END >= 0 THEN 'pass' ELSE 'breach' END AS status FROM (SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(20,2)) AS actual, CAST(4500 AS DECIMAL(20,2)) AS threshold, CASE WHEN s_suppkey % 2 = 0 THEN 'gte' ELSE 'lte' END AS comparator FROM supplier)")
def b15_covenants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    tests = s.select("s_suppkey", F.col("s_acctbal").cast("decimal(20,2)").alias("actual"), F.lit("4500").cast("decimal(20,2)").alias("threshold"), F.when(F.col("s_suppkey") % 2 == 0, "gte").otherwise("lte").alias("comparator"))
    return b.covenants(tests).withColumn("headroom", F.col("headroom").cast("decimal(22,2)"))


@query(
    """SELECT status, COUNT(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 AND CAST(o_orderdate AS DATE) - 10 <= DATE '1999-06-30' THEN 'completed' WHEN o_orderkey % 11 = 0 THEN 'waived' WHEN CAST(o_orderdate AS DATE) < DATE '1999-06-30' THEN 'overdue' WHEN date_diff('day', DATE '1999-06-30', CAST(o_orderdate AS DATE)) <= 30 THEN 'due_soon' ELSE 'current' END AS status FROM orders) GROUP BY 1"""
)
def b16_ticklers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    due = F.to_date("o_orderdate")
    items = o.select(due.alias("due_date"), F.when(F.col("o_orderkey") % 5 == 0, F.date_sub(due, 10)).alias("completed_on"), (F.col("o_orderkey") % 11 == 0).alias("waived"))
    return b.ticklers(items, F.lit("1999-06-30").cast("date")).groupBy("status").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_COLLATERAL}, d AS (SELECT * FROM collateral UNION ALL SELECT * FROM collateral WHERE CAST(record_id AS BIGINT) % 500 = 0), e AS (SELECT *, CASE WHEN CAST(record_id AS BIGINT) % 600 = 0 THEN 'art' ELSE collateral_class END AS k, CASE WHEN CAST(record_id AS BIGINT) % 700 = 0 THEN gross_value + 1 ELSE basis_value END AS v FROM d)
    SELECT 'unknown_class' AS rule, COUNT(*) AS rows FROM e WHERE k = 'art' HAVING COUNT(*) > 0 UNION ALL SELECT 'basis_over_gross', COUNT(*) FROM e WHERE v > gross_value HAVING COUNT(*) > 0
    UNION ALL SELECT 'record_id_repeated', CAST(SUM(n) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM e GROUP BY record_id HAVING COUNT(*) > 1) HAVING SUM(n) > 0"""
)
def b18_collateral_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = collateral(spark, sf_dir)
    n = F.col("record_id").cast("long")
    bad = rows.union(rows.where(n % 500 == 0)).withColumn("collateral_class", F.when(n % 600 == 0, "art").otherwise(F.col("collateral_class"))).withColumn("basis_value", F.when(n % 700 == 0, F.col("gross_value") + 1).otherwise(F.col("basis_value")))
    return b.collateral_violations(bad, ["AR", "inventory", "equipment", "cash"])


_CASH = """
    cash AS (SELECT user_id AS facility_id, CASE event_id % 5 WHEN 0 THEN 'opening' WHEN 1 THEN 'receipt' WHEN 2 THEN 'application' WHEN 3 THEN 'paydown' ELSE 'reported' END AS kind, CAST(CASE WHEN user_id % 3 = 0 THEN 10 ELSE event_id % 100 END AS DECIMAL(20,2)) AS amount FROM events)"""


@query(
    f"""WITH {_CASH}, t AS (SELECT facility_id, {", ".join(f"COALESCE(SUM(CASE WHEN kind = '{k}' THEN amount END), 0) AS {k}" for k in ("opening", "receipt", "application", "paydown", "reported"))} FROM cash GROUP BY 1),
    r AS (SELECT facility_id, receipt - application AS unapplied, opening - paydown AS expected, concat_ws(',', CASE WHEN abs(receipt - application) > 0 THEN 'unapplied_cash' END, CASE WHEN abs(application - paydown) > 0 THEN 'application_paydown' END, CASE WHEN abs(opening - paydown - reported) > 0 THEN 'ending_balance' END) AS breaks FROM t)
    SELECT facility_id, CAST(unapplied AS DECIMAL(38,2)) AS unapplied, CAST(expected AS DECIMAL(38,2)) AS expected, breaks, breaks = '' AS passed FROM r"""
)
def a27_cash_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "events")
    out = b.reconcile_cash(spark.sql(f"WITH {_CASH} SELECT * FROM cash"), SCOPE)
    return b.as_amounts(out.select("facility_id", "unapplied", "expected", "breaks", "passed"), ["unapplied", "expected"])
