"""Building blocks as queries of their own: effective dates, orders, limits, projections, keys, accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters, mapping
from ..functions import scalars as s
from ..functions.scalars import population_hash, row_token
from ..operators import disclosure, finalize, stratification, surveillance
from .portfolio import BINS
from .registry import query
from .tape import KEY, digest_sums_sql, periods, tape, with_tape

_SPANS = "spans AS (SELECT o_custkey % 50 AS rule_id, o_orderkey AS version, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 YEAR AS DATE) END AS b FROM orders)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = F.to_date("o_orderdate")
    return o.select((F.col("o_custkey") % 50).alias("rule_id"), F.col("o_orderkey").alias("version"), start.alias("a"), F.when(F.col("o_orderkey") % 4 != 0, F.add_months(start, 12)).alias("b"))


@query(f"WITH {_SPANS} SELECT rule_id, COUNT(*) FILTER (a <= DATE '1999-06-30' AND (b IS NULL OR DATE '1999-06-30' < b)) AS exclusive, COUNT(*) FILTER (a <= DATE '1999-06-30' AND (b IS NULL OR DATE '1999-06-30' <= b)) AS inclusive FROM spans GROUP BY 1")
def f4_f5_effective_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = F.lit("1999-06-30").cast("date")
    n = lambda inclusive: F.sum(filters.effective(on, "a", "b", inclusive).cast("long"))
    return _spans(spark, sf_dir).groupBy("rule_id").agg(n(False).alias("exclusive"), n(True).alias("inclusive"))


@query(f"WITH {_SPANS} SELECT rule_id, COUNT(*) AS count FROM spans WHERE a <= DATE '1995-03-31' AND (b IS NULL OR DATE '1995-03-31' < b) GROUP BY 1 HAVING COUNT(*) > 1")
def f4_conflicting_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spans(spark, sf_dir)
    return filters.conflicting_versions(rows.where(filters.effective(F.lit("1995-03-31").cast("date"), "a", "b", False)))


@query(with_tape("SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, loan_id, CAST(outstanding_balance AS VARCHAR) AS outstanding_balance, row_number() OVER (ORDER BY as_of_date DESC, days_past_due ASC NULLS LAST, loan_id) AS place FROM tape WHERE period_idx <= 1"))
def p17_t3_projection_in_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapped columns as text in a total order with a place for nulls; the place is shown by a range sort and a running count."""
    from pyspark.sql import Window

    rows = tape(spark, sf_dir).where("period_idx <= 1").select("as_of_date", "loan_id", "outstanding_balance", "days_past_due")
    order = disclosure.total_order(rows, [("as_of_date", "desc", "last"), ("days_past_due", "asc", "last"), ("loan_id", "asc", "first")])
    # Places per date and days past due are counted from grouped sizes, so that no window spans the table.
    groups = rows.groupBy("as_of_date", "days_past_due").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy(F.desc("as_of_date"), F.asc_nulls_last("days_past_due")).rowsBetween(Window.unboundedPreceding, -1))
    starts = groups.withColumn("before", F.coalesce(before, F.lit(0))).drop("n")
    inner = F.row_number().over(Window.partitionBy("as_of_date", "days_past_due").orderBy("loan_id"))
    placed = order.withColumn("r", inner).alias("x").join(starts.alias("y"), F.col("x.as_of_date").eqNullSafe(F.col("y.as_of_date")) & F.col("x.days_past_due").eqNullSafe(F.col("y.days_past_due")))
    return placed.select(F.col("x.as_of_date").cast("string").alias("as_of_date"), "loan_id", F.col("outstanding_balance").cast("string").alias("outstanding_balance"), (F.col("r") + F.col("before")).alias("place"))


@query(with_tape("SELECT COUNT(*) AS n FROM (SELECT DISTINCT borrower_id FROM tape LIMIT 501) HAVING COUNT(*) > 500"))
def t6_over_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratification.over_limit(tape(spark, sf_dir).select("borrower_id").distinct(), 500)


_MEMBER = "m AS (SELECT facility_id, list(DISTINCT industry_code) FILTER (period_idx = 0 AND days_past_due > 140) AS a, list(DISTINCT industry_code) FILTER (period_idx = 3 AND days_past_due < 10) AS b FROM tape GROUP BY 1)"


@query(with_tape(f", {_MEMBER} SELECT facility_id, len(list_filter(COALESCE(a, []), lambda x: NOT list_contains(COALESCE(b, []), x))) AS only_left, len(list_filter(COALESCE(b, []), lambda x: NOT list_contains(COALESCE(a, []), x))) AS only_right FROM m"))
def u3_set_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda cond: F.collect_set(F.when(cond, F.col("industry_code")))
    m = tape(spark, sf_dir).groupBy("facility_id").agg(some((F.col("period_idx") == 0) & (F.col("days_past_due") > 140)).alias("a"), some((F.col("period_idx") == 3) & (F.col("days_past_due") < 10)).alias("b"))
    return m.select("facility_id", disclosure.members_differ(F.col("a"), F.col("b")).alias("d")).select("facility_id", F.col("d.only_left").cast("long").alias("only_left"), F.col("d.only_right").cast("long").alias("only_right"))


@query("SELECT c_custkey, 'monitor:' || sha256(CAST(c_custkey AS VARCHAR) || chr(31) || c_mktsegment) AS dedupe_key FROM customer")
def h13_dedupe_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", s.dedupe_key("c_custkey", "c_mktsegment").alias("dedupe_key"))


@query("SELECT l_orderkey, string_agg(x, ',' ORDER BY x) AS refs FROM (SELECT DISTINCT l_orderkey, CAST(l_suppkey AS VARCHAR) AS x FROM lineitem) GROUP BY 1")
def h12_evidence_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey").cast("string")).alias("r"))
    return g.select("l_orderkey", F.array_join(s.evidence_refs("r"), ",").alias("refs"))


@query(with_tape("SELECT as_of_date, CAST(SUM(COALESCE(charge_off_amount, 0)) AS DECIMAL(38,2)) AS filled, COUNT(*) FILTER (charge_off_amount IS NULL) AS missing, MAX(date_diff('day', origination_date, as_of_date)) AS oldest_days FROM tape GROUP BY 1"))
def h6_h8_nulls_and_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape(spark, sf_dir).groupBy("as_of_date").agg(
        F.sum(s.with_null_policy("charge_off_amount", "zero")).cast("decimal(38,2)").alias("filled"), F.sum(F.col("charge_off_amount").isNull().cast("long")).alias("missing"), F.max(s.days_between("origination_date", "as_of_date")).cast("long").alias("oldest_days")
    )


@query(
    """SELECT kind, COUNT(*) AS n FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN 'decimal' WHEN 1 THEN 'text' WHEN 2 THEN 'datetime' WHEN 3 THEN 'integer' ELSE 'unknown' END AS kind FROM part) GROUP BY 1"""
)
def p18_type_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in ("NUMERIC(18,2)", "varchar(20)", "Timestamp", "BIGINT", "blob")])
    native = F.element_at(names, (F.col("p_partkey") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(mapping.type_family(native).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(with_tape("SELECT 'default_incidence' AS metric, COUNT(*) AS cells FROM (SELECT DISTINCT as_of_date FROM tape WHERE period_idx > 0)"))
def p15_u1_requested_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns that a definition reads leave the scan."""
    definition = {"metric": "default_incidence", "fields": ["default_flag", "outstanding_balance"], "filter": {"op": "neq", "field": "risk_rating", "value": "none"}}
    columns = [*KEY, "period_idx", "as_of_date", *mapping.requested_fields([definition])]
    rows = tape(spark, sf_dir).select(*dict.fromkeys(columns)).where(filters.population_filter(definition["filter"]))
    cells = surveillance.default_incidence(rows, periods=periods(spark))
    return cells.agg(F.count("*").alias("cells")).select(F.lit("default_incidence").alias("metric"), "cells")


@query(
    with_tape(f""", c AS (SELECT as_of_date, t, COUNT(*) AS n, sha256(COUNT(k) || ':' || {digest_sums_sql("k")}) AS h FROM (SELECT *, sha256(to_json([source_system, facility_id, loan_id])) AS k FROM tape), (SELECT unnest([30, 60, 90]) AS t) WHERE days_past_due >= t GROUP BY 1, 2),
    d AS (SELECT DISTINCT h FROM c)
    SELECT (SELECT COUNT(*) FROM c) AS cells, 1 AS metrics, (SELECT COUNT(*) FROM c WHERE n < 1000) AS suppressed, 0 AS unavailable, COUNT(h) AS populations, sha256(COUNT(h) || ':' || {digest_sums_sql("h")}) AS populations_hash FROM d""")
)
def s16_result_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir)
    each = rows.select("as_of_date", "days_past_due", row_token(*KEY).alias("token"), F.explode(F.array(F.lit(30), F.lit(60), F.lit(90))).alias("t")).where("days_past_due >= t")
    per = each.groupBy("as_of_date", "t").agg(F.count("*").alias("n"), population_hash(F.col("token")).alias("denominator_hash"))
    cells = per.select(F.lit("dpd").alias("metric"), (F.col("n") < 1000).alias("suppressed"), F.lit("available").alias("availability"), "denominator_hash")
    return finalize.accounting(cells)


@query(with_tape("SELECT 'roll_cure' AS metric, CAST(NULL AS DOUBLE) AS value, CASE WHEN COUNT(DISTINCT as_of_date) < 2 THEN 'no_prior_period' ELSE 'available' END AS availability, FALSE AS suppressed FROM tape WHERE period_idx = 0"))
def a23_no_prior_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of pairs over a single period gives one unavailable cell, decided by the data in the same plan."""
    rows = tape(spark, sf_dir).where("period_idx = 0")
    n = rows.select("as_of_date").distinct().agg(F.count("*").alias("n"))
    cell = finalize.unavailable_cell(spark, "roll_cure", "no_prior_period")
    return cell.crossJoin(n).select("metric", "value", F.when(F.col("n") < 2, F.col("availability")).otherwise("available").alias("availability"), "suppressed")


@query(with_tape("""
    , g AS (SELECT as_of_date, CASE WHEN days_past_due IS NULL THEN 'Unknown/Unmapped' WHEN days_past_due < 30 THEN 'Current' WHEN days_past_due < 60 THEN '30-59' WHEN days_past_due < 90 THEN '60-89' WHEN days_past_due < 120 THEN '90+' ELSE 'Other/Out of range' END AS bucket, COUNT(*) AS loans FROM tape GROUP BY 1, 2)
    SELECT as_of_date, bucket, loans, CASE bucket WHEN 'Current' THEN 0 WHEN '30-59' THEN 1 WHEN '60-89' THEN 2 WHEN '90+' THEN 3 WHEN 'Unknown/Unmapped' THEN 4 ELSE 5 END AS place FROM g"""))
def h1_t2_bins_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tape(spark, sf_dir).groupBy("as_of_date", s.numeric_bin("days_past_due", BINS).alias("bucket")).agg(F.count("*").alias("loans"))
    return g.withColumn("place", s.bin_order("bucket", BINS))


@query(with_tape("SELECT 'outstanding_balance' AS metric, COUNT(*) AS rows, CAST(SUM(outstanding_balance) AS DECIMAL(38,2)) AS balance, string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies, concat_ws(',', CASE WHEN COUNT(*) <> 100 THEN 'row_count' END, CASE WHEN COUNT(DISTINCT currency) > 1 THEN 'currency' END) AS blockers FROM tape WHERE period_idx = 3"))
def q9_sidecar_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls of a sidecar (rows, balance, currency) against 100 declared rows, with the blockers."""
    t = tape(spark, sf_dir).where("period_idx = 3").agg(F.count("*").alias("rows"), F.sum("outstanding_balance").cast("decimal(38,2)").alias("balance"), F.array_sort(F.collect_set("currency")).alias("c"))
    blockers = F.array_compact(F.array(F.when(F.col("rows") != 100, "row_count"), F.when(F.size("c") > 1, "currency")))
    return t.select(F.lit("outstanding_balance").alias("metric"), "rows", "balance", F.array_join("c", ",").alias("currencies"), F.array_join(blockers, ",").alias("blockers"))


@query(
    with_tape("""
    , l AS (SELECT industry_code, SUM(outstanding_balance) AS v FROM tape WHERE period_idx = 0 GROUP BY 1), r AS (SELECT industry_code, SUM(outstanding_balance) AS v FROM tape WHERE period_idx = 3 GROUP BY 1)
    SELECT COALESCE(l.industry_code, r.industry_code) AS industry_code, CAST(l.v AS DECIMAL(38,2)) AS left_value, CAST(r.v AS DECIMAL(38,2)) AS right_value, CAST(r.v - l.v AS DECIMAL(38,2)) AS delta FROM l FULL JOIN r ON l.industry_code = r.industry_code""")
)
def a26_report_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda p: tape(spark, sf_dir).where(f"period_idx = {p}").groupBy("industry_code").agg(F.sum("outstanding_balance").cast("decimal(38,2)").alias("value"))
    return disclosure.comparison(of(0), of(3), ["industry_code"]).withColumn("delta", F.col("delta").cast("decimal(38,2)"))


@query(with_tape("SELECT 'suppressed_value' AS problem, COUNT(*) AS n FROM (SELECT industry_code, COUNT(*) AS n FROM tape GROUP BY 1) WHERE n < 1000000 HAVING COUNT(*) > 0"))
def a26_report_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tape(spark, sf_dir).groupBy("industry_code").agg(F.count("*").alias("value")).withColumn("suppressed", F.col("value") < 1000000).withColumn("unit", F.lit("count"))
    return disclosure.report_problems(cells, ["industry_code"])
