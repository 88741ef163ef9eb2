"""A loan tape derived from the star schema: four month-ends, one row per open loan and date.

``TAPE_SQL`` is the same derivation for DuckDB, as a common table expression named ``tape``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

PERIODS = ["1999-09-30", "1999-10-31", "1999-11-30", "1999-12-31"]

_SHIPPED = ",\n        ".join(f"SUM(CASE WHEN CAST(l_shipdate AS DATE) <= DATE '{d}' THEN CAST(l_extendedprice AS DECIMAL(20,2)) ELSE CAST(0 AS DECIMAL(20,2)) END) AS paid_{i}" for i, d in enumerate(PERIODS))
_ROWS = ", ".join(f"({i}, DATE '{d}')" for i, d in enumerate(PERIODS))
_NOW = "CASE p.period_idx " + " ".join(f"WHEN {i} THEN paid_{i}" for i in range(len(PERIODS))) + " END"
_BEFORE = "CASE p.period_idx WHEN 0 THEN CAST(0 AS DECIMAL(20,2)) " + " ".join(f"WHEN {i} THEN paid_{i - 1}" for i in range(1, len(PERIODS))) + " END"

TAPE_SQL = f"""
shipped AS (
    SELECT l_orderkey,
        {_SHIPPED}
    FROM lineitem GROUP BY l_orderkey),
periods AS (SELECT * FROM (VALUES {_ROWS}) AS t(period_idx, as_of_date)),
base AS (
    SELECT p.period_idx, p.as_of_date, o.o_orderkey AS k, c.c_custkey, c.c_nationkey, c.c_mktsegment, o.o_orderpriority,
        CAST(o.o_orderdate AS DATE) AS origination_date,
        CAST(o.o_totalprice AS DECIMAL(20,2)) AS original_balance,
        CAST(COALESCE({_NOW}, 0) AS DECIMAL(20,2)) AS paid_now,
        CAST(COALESCE({_BEFORE}, 0) AS DECIMAL(20,2)) AS paid_before
    FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
    LEFT JOIN shipped s ON s.l_orderkey = o.o_orderkey
    CROSS JOIN periods p
    WHERE CAST(o.o_orderdate AS DATE) <= p.as_of_date),
tape AS (
    SELECT period_idx, as_of_date,
        CASE WHEN k % 5 = 0 THEN 'alt' ELSE 'core' END AS source_system,
        CONCAT('F', CAST(c_nationkey AS VARCHAR(10))) AS facility_id,
        CAST(k AS VARCHAR(20)) AS loan_id,
        CAST(c_custkey AS VARCHAR(20)) AS borrower_id,
        CASE WHEN (k * 3 + period_idx) % 11 = 0 THEN 'delinquent' WHEN k % 17 = 0 THEN 'default' ELSE 'current' END AS loan_status,
        origination_date, original_balance,
        CAST(CASE WHEN k % 37 = 0 AND period_idx = 2 THEN NULL WHEN original_balance > paid_now THEN original_balance - paid_now ELSE 0 END AS DECIMAL(20,2)) AS outstanding_balance,
        CAST(original_balance + 1000 AS DECIMAL(20,2)) AS commitment_amount,
        CAST(CASE WHEN (k + period_idx) % 29 = 0 THEN NULL ELSE (k * 7 + period_idx * 13) % 150 END AS INT) AS days_past_due,
        CASE WHEN (k + period_idx) % 31 = 0 THEN NULL ELSE (k * 7 + period_idx * 13) % 150 >= 120 END AS default_flag,
        CAST(CASE WHEN k % 13 = 0 THEN NULL WHEN (k + period_idx) % 9 = 0 THEN k % 500 ELSE 0 END AS DECIMAL(20,2)) AS charge_off_amount,
        CAST(CASE WHEN k % 19 = 0 THEN NULL WHEN (k + period_idx) % 18 = 0 THEN k % 100 ELSE 0 END AS DECIMAL(20,2)) AS recovery_amount,
        CAST(CASE WHEN k % 23 = 0 THEN NULL ELSE k % 700 END AS DECIMAL(20,2)) AS scheduled_principal_amount,
        CASE WHEN (k + period_idx) % 41 = 0 THEN NULL ELSE o_orderpriority END AS risk_rating,
        c_mktsegment AS industry_code,
        CAST(CASE WHEN k % 43 = 0 THEN NULL ELSE CAST(k % 1200 AS DECIMAL(12,4)) / 100 END AS DECIMAL(12,4)) AS interest_rate,
        CAST(CASE WHEN k % 47 = 0 THEN NULL WHEN k % 4 = 0 THEN DATE '1999-10-15' WHEN k % 4 = 1 THEN DATE '2000-06-30' WHEN k % 4 = 2 THEN DATE '2001-12-31' ELSE DATE '2005-01-31' END AS DATE) AS maturity_date,
        CAST(CASE WHEN k % 3 = 0 THEN DATE '1999-08-31' END AS DATE) AS default_date,
        CASE WHEN k % 97 = 0 THEN 'EUR' ELSE 'USD' END AS currency
    FROM base WHERE period_idx = 0 OR paid_before < original_balance)
"""

KEY = ["source_system", "facility_id", "loan_id"]


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived tape; lazy, so filters on dates and unused columns are pruned to the scans."""
    views(spark, sf_dir, "orders", "customer", "lineitem")
    return spark.sql(f"WITH {TAPE_SQL} SELECT * FROM tape")


def with_tape(select: str) -> str:
    return f"WITH {TAPE_SQL} {select}"


def periods(spark: SparkSession) -> DataFrame:
    """The dates of the tape, which are known without a scan."""
    return spark.sql(f"SELECT * FROM (VALUES {_ROWS}) AS t(period_idx, as_of_date)")


def digest_sums_sql(digest: str) -> str:
    """Sums of the four 64-bit parts of SHA-256 digests, as texts joined by colons."""
    return " || ':' || ".join(f"CAST(COALESCE(SUM(CAST(CAST('0x' || substr({digest}, {16 * i + 1}, 16) AS UBIGINT) AS HUGEINT)), 0) AS VARCHAR)" for i in range(4))


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a table that several parts of a query read to the shared folder (``spark.checkpoint.dir``), once, and read it back."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
