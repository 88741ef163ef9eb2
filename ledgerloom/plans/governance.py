"""Mapping, sources, corrections, disclosure and reports over tables derived from the star schema."""

from __future__ import annotations

import datetime
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import filters, mapping
from ..functions.dictionary import ALIASES, FIELDS, REQUIRED, label
from ..functions.scalars import infer_temporal, infer_unit, months_until, value_kind
from ..operators import disclosure, history, matching
from ..sources import footers, sqlite, tapes
from .registry import query
from .tape import KEY, PERIODS, digest_sums_sql, tape, views, with_tape, written

_RAW = """
    raw AS (SELECT o_orderkey AS id, CAST(o_orderkey AS VARCHAR(20)) AS loan_no, CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR(20)) AS balance_cents,
        CASE WHEN o_orderkey % 50 = 0 THEN '02/30/1999' WHEN o_orderkey % 3 = 0 THEN replace(substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 10), '-', '') ELSE substr(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 1, 10) END AS report_date,
        o_orderpriority AS grade, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN 'yes' ELSE 'true' END AS flag, CAST(o_custkey AS VARCHAR(20)) AS cust FROM orders)"""


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return spark.sql(f"WITH {_RAW} SELECT * FROM raw")


def _src(c: str) -> dict:
    return {"op": "source", "column": c}


RULES = [
    mapping.Rule("loan", "loan_id", _src("loan_no")),
    mapping.Rule("balance", "balance", {"op": "scale_decimal", "input": _src("balance_cents"), "factor": "0.01", "places": 2, "rounding": "half_even"}),
    mapping.Rule("as-of", "as_of_date", {"op": "parse_date", "input": _src("report_date"), "formats": ["YYYY-MM-DD", "YYYYMMDD", "MM/DD/YYYY"]}),
    mapping.Rule("grade", "grade", {"op": "code_map", "input": {"op": "split", "input": _src("grade"), "delimiter": "-", "index": 0}, "values": {"1": "A", "2": "B", "3": "C", "4": "D"}, "unknown": "reject"}),
    mapping.Rule("flag", "flag", {"op": "exact_cast", "input": _src("flag"), "to": "boolean"}, "null"),
    mapping.Rule("label", "label", {"op": "combine", "inputs": [_src("loan_no"), _src("missing"), _src("grade")], "separator": " / ", "skip_nulls": True}),
    mapping.Rule("segment", "segment", {"op": "dimension_lookup", "input": _src("cust"), "definition": "segment", "missing": "null"}),
    mapping.Rule("size", "size", {"op": "when", "condition": {"op": "or", "args": [{"op": "is_null", "input": _src("flag")}, {"op": "in", "input": _src("flag"), "values": ["yes"]}]}, "then": {"op": "literal", "value": "odd"}, "otherwise": {"op": "coalesce", "inputs": [_src("missing"), {"op": "literal", "value": "even"}]}}),
]
_REJECT = "CASE WHEN report_date = '02/30/1999' THEN 'as-of' WHEN substr(grade, 1, 1) NOT IN ('1', '2', '3', '4') THEN 'grade' END"


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 10 <> 0").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("value"))
    return mapping.execute_mapping(raw_orders(spark, sf_dir), RULES, "id", {"segment": customers})


@query(
    f"""WITH {_RAW}, r AS (SELECT raw.*, {_REJECT} AS rej, c.c_mktsegment AS segment FROM raw LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = cust AND c.c_custkey % 10 <> 0)
    SELECT id, loan_no AS loan_id, CAST(CAST(balance_cents AS DECIMAL(20,2)) / 100 AS DECIMAL(30,2)) AS balance, CASE WHEN length(report_date) = 8 THEN CAST(strptime(report_date, '%Y%m%d') AS DATE) ELSE CAST(report_date AS DATE) END AS as_of_date,
        CASE substr(grade, 1, 1) WHEN '1' THEN 'A' WHEN '2' THEN 'B' WHEN '3' THEN 'C' ELSE 'D' END AS grade, CASE WHEN flag = 'true' THEN TRUE END AS flag, concat(loan_no, ' / ', grade) AS label, segment,
        CASE WHEN flag IS NULL OR flag = 'yes' THEN 'odd' ELSE 'even' END AS size FROM r WHERE rej IS NULL"""
)
def p2_mapping_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)[0].withColumn("balance", F.col("balance").cast("decimal(30,2)"))


@query(f"WITH {_RAW} SELECT id, {_REJECT} AS rule_id FROM raw WHERE {_REJECT} IS NOT NULL")
def p2_mapping_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)[1]


@query(f"WITH {_RAW} SELECT loan_no AS loan_id, CAST(balance_cents AS BIGINT) AS cents, flag AS flag_text FROM raw")
def p1_approved_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.apply_approved(raw_orders(spark, sf_dir), {"loan_id": ("loan_no", "identifier"), "cents": ("balance_cents", "integer"), "flag_text": ("flag", "string")})


_PADS = ["".join(f"\\x{b ^ x:02X}" for b in b"demo key".ljust(64, b"\0")) for x in (0x36, 0x5C)]


@query(
    with_tape(f"""SELECT substr(sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode('loan_id' || chr(31) || loan_id)))), 1, 24) AS loan_id, CASE WHEN length(borrower_id) > 4 THEN '****' || right(borrower_id, 4) ELSE '****' END AS borrower_id,
        risk_rating, outstanding_balance, '[redacted]' AS industry_code FROM tape WHERE period_idx = 3""")
)
def p20_masked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir).where("period_idx = 3").select("loan_id", "borrower_id", "risk_rating", "outstanding_balance", "industry_code")
    return mapping.mask(rows, {"loan_id": "tokenize", "borrower_id": "partial", "risk_rating": "none", "outstanding_balance": "none"}, b"demo key")


@query("SELECT c_custkey, trim(regexp_replace(lower(c_mktsegment || ' rate and ' || c_name), '[^a-z0-9]+', '_', 'g'), '_') AS norm FROM customer")
def p19_normal_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select("c_custkey", mapping.normal_name(F.concat("c_mktsegment", F.lit(" % & "), "c_name")).alias("norm"))


@query(
    r"""WITH c AS (SELECT CASE event_id % 6 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(event_id AS VARCHAR) || '.50' WHEN 2 THEN 'true' WHEN 3 THEN substr(CAST(CAST(ts AS DATE) AS VARCHAR), 1, 10) WHEN 4 THEN event_type ELSE '' END AS v FROM events)
    SELECT CASE WHEN trim(v) = '' THEN 'null' WHEN v IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(v, '-?(0|[1-9][0-9]*)') THEN 'integer' WHEN regexp_full_match(v, '-?(0|[1-9][0-9]*)(\.[0-9]+)?') THEN 'decimal'
        WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' ELSE 'text' END AS kind, COUNT(*) AS n FROM c GROUP BY 1"""
)
def h11_value_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    i, m = F.col("event_id"), F.col("event_id") % 6
    text = i.cast("string")
    v = F.when(m == 0, text).when(m == 1, F.concat(text, F.lit(".50"))).when(m == 2, "true").when(m == 3, F.to_date("ts").cast("string")).when(m == 4, F.col("event_type")).otherwise("")
    return e.select(value_kind(v).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


_NAMES = "interest_rate days_past_due maturity_date loan_count outstanding_balance LTV cumulative_recovery payment_amount default_date updated_at id account_no loan_number status page_views utilization event_kind current_rating other".split()


@query(
    f"""WITH c AS (SELECT p_partkey, lower(list_extract({_NAMES}, CAST(p_partkey % {len(_NAMES)} AS INT) + 1)) AS n FROM part)
    SELECT p_partkey, CASE WHEN n LIKE '%balance%' OR n LIKE '%amount%' OR n LIKE '%price%' OR n LIKE '%value%' OR n LIKE '%cost%' OR n LIKE '%reserve%' OR n LIKE '%commitment%' THEN 'currency'
        WHEN n LIKE '%rate%' OR n LIKE '%percent%' OR n LIKE '%pct%' OR n LIKE '%ltv%' THEN 'percentage' WHEN n LIKE '%days%' OR n LIKE '%dpd%' OR n LIKE '%age%' THEN 'days' WHEN n LIKE '%date%' OR right(n, 3) = '_at' THEN 'date'
        WHEN n = 'id' OR right(n, 3) IN ('_id', '_no') OR right(n, 6) = 'number' THEN 'identifier' ELSE 'unknown' END AS unit,
        CASE WHEN n LIKE '%cumulative%' OR n LIKE '%lifetime%' OR n LIKE '%!_ltd%' ESCAPE '!' THEN 'lifetime_to_date' WHEN n LIKE '%payment%' OR n LIKE '%charge%' OR n LIKE '%recovery%' OR n LIKE '%advance%' OR n LIKE '%flow%' THEN 'flow'
        WHEN n LIKE '%event%' OR n LIKE '%default!_date%' ESCAPE '!' OR n LIKE '%modification!_date%' ESCAPE '!' THEN 'event' WHEN n LIKE '%balance%' OR n LIKE '%status%' OR n LIKE '%rating%' OR n LIKE '%utilization%' THEN 'stock' ELSE 'unknown' END AS temporal FROM c"""
)
def h10_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return p.select("p_partkey", infer_unit(name).alias("unit"), infer_temporal(name).alias("temporal"))


@query(
    with_tape("""SELECT as_of_date, months, COUNT(*) AS loans FROM (SELECT as_of_date, (year(maturity_date) * 12 + month(maturity_date)) - (year(as_of_date) * 12 + month(as_of_date)) + CASE WHEN day(maturity_date) > day(as_of_date) THEN 1 ELSE 0 END AS months FROM tape) GROUP BY 1, 2""")
)
def h5_months_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tape(spark, sf_dir).groupBy("as_of_date", months_until("as_of_date", "maturity_date").alias("months")).agg(F.count("*").alias("loans"))


_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def lake_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, column_name, native_type) of the tables, and of copies of the tape under delivered names, one per supplier."""
    rows = [(t, f.name, f.dataType.simpleString()) for t in _TABLES for f in spark.read.parquet(f"{sf_dir}/{t}.parquet").schema.fields]
    named = spark.createDataFrame(rows, "dataset string, column_name string, native_type string")
    delivered = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(t).alias("native_type")) for c, t in _DELIVERED])
    copies = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("tape_"), F.col("s_suppkey").cast("string")).alias("dataset"), F.explode(delivered).alias("c")).select("dataset", "c.*")
    return named.union(copies)


_LAKE = " UNION ALL ".join(f"SELECT '{t}' AS dataset, column_name, CASE column_type WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END AS native_type FROM (DESCRIBE {t})" for t in _TABLES)
_DELIVERED = (("CurrentBalance", "decimal(18,2)"), ("loan_no", "varchar"), ("Report Date", "date"), ("coupon_rate", "double"), ("riskGrade", "varchar"), ("due_date", "date"))


def _named() -> str:
    rows = [(n, k, v, b) for n, k in FIELDS for v, b in [(n, 0.92), (label(n), 0.86), *((a, 0.88) for a in ALIASES.get(n, "").split())]]
    return ", ".join(f"('{n}', '{k}', '{v}', {b})" for n, k, v, b in rows)


def _words(name: str) -> str:
    split = rf"regexp_replace(strip_accents({name}), '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    return f"trim(regexp_replace(lower(replace(replace({split}, '%', ' rate '), '&', ' and ')), '[^a-z0-9]+', ' ', 'g'))"


def _tokens(words: str) -> str:
    table = "MAP {" + ", ".join(f"'{k}': {v.split()}" for k, v in matching.SHORT.items()) + "}"
    return f"list_distinct(flatten(list_transform(string_split({words}, ' '), lambda w: coalesce({table}[w], [w]))))"


@query(
    f"""WITH lake AS ({_LAKE} UNION ALL SELECT 'tape_' || CAST(s_suppkey AS VARCHAR), c.column_name, c.native_type FROM supplier, (VALUES {", ".join(map(str, _DELIVERED))}) c(column_name, native_type)),
    src AS (SELECT *, {_tokens("norm")} AS words FROM (SELECT *, {_words("column_name")} AS norm FROM lake) WHERE norm <> ''),
    names AS (SELECT *, {_tokens("t_norm")} AS t_words FROM (SELECT *, {_words("name")} AS t_norm FROM (VALUES {_named()}) v(target, logical_type, name, base))),
    p AS (SELECT *, list_intersect(words, t_words) AS met FROM src, names WHERE len(list_intersect(words, t_words)) > 0),
    s AS (SELECT dataset, column_name, native_type, target, logical_type, MAX(CASE WHEN norm = t_norm THEN base END) AS equal,
        MAX((0.65 * 2.0 * len(met) / (len(words) + len(t_words)) + 0.35 * len(met) / least(len(words), len(t_words))) * CASE WHEN len(list_filter(met, lambda w: NOT list_contains({matching.GENERIC_WORDS}, w))) = 0 THEN 0.78 ELSE 1 END) AS alike FROM p GROUP BY ALL),
    f AS (SELECT *, CASE WHEN native_type IN ('int', 'bigint') THEN 'integer' WHEN native_type LIKE 'decimal%' OR native_type = 'double' THEN 'decimal' WHEN native_type IN ('string', 'varchar') THEN 'text' WHEN native_type LIKE 'timestamp%' THEN 'datetime' ELSE native_type END AS family FROM s),
    t AS (SELECT *, CASE logical_type WHEN 'identifier' THEN CASE WHEN family IN ('text', 'integer') THEN 'exact' ELSE 'incompatible' END WHEN 'string' THEN CASE family WHEN 'text' THEN 'exact' ELSE 'incompatible' END
        WHEN 'integer' THEN CASE WHEN family = 'integer' THEN 'exact' WHEN family IN ('decimal', 'text') THEN 'compatible' ELSE 'incompatible' END WHEN 'boolean' THEN CASE family WHEN 'boolean' THEN 'exact' WHEN 'text' THEN 'compatible' ELSE 'incompatible' END
        WHEN 'date' THEN CASE WHEN family = 'date' THEN 'exact' WHEN family IN ('datetime', 'text') THEN 'compatible' ELSE 'incompatible' END ELSE CASE WHEN family = 'decimal' THEN 'exact' WHEN family IN ('integer', 'text') THEN 'compatible' ELSE 'incompatible' END END AS type_fit FROM f),
    c AS (SELECT *, round(least(1.0, greatest(0.0, CAST(coalesce(equal, CASE WHEN alike >= 0.26 THEN least(0.76, alike * 0.76) END) + CASE type_fit WHEN 'exact' THEN 0.08 WHEN 'compatible' THEN 0.04 ELSE -0.15 END + CASE WHEN list_contains({REQUIRED["base"].split()}, target) THEN 0.02 ELSE 0 END AS DOUBLE))), 4) AS score FROM t)
    SELECT dataset, column_name, native_type, target, type_fit, score, rank FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY dataset, column_name, native_type ORDER BY score DESC, target) AS rank FROM c WHERE score >= 0.3) WHERE rank <= 5"""
)
def q11_schema_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.suggest(lake_columns(spark, sf_dir), profile="base")


@query(
    """WITH d AS (SELECT 'tape_' || CAST(s_suppkey AS VARCHAR) AS dataset, s_suppkey AS k FROM supplier)
    SELECT dataset, 'type_mismatch' AS problem, 'coupon_rate' AS item FROM d WHERE k % 2 = 0 UNION ALL SELECT dataset, 'unmapped_column', 'Report Date' FROM d UNION ALL SELECT dataset, CASE WHEN k % 4 = 0 THEN 'type_coercion' ELSE 'unmapped_column' END, 'riskGrade' FROM d
    UNION ALL SELECT dataset, 'unmapped_column', 'due_date' FROM d UNION ALL SELECT dataset, 'unmapped_column', 'coupon_rate' FROM d WHERE k % 2 = 1
    UNION ALL SELECT dataset, 'missing_required', 'as_of_date' FROM d UNION ALL SELECT dataset, 'unknown_source', 'nothing' FROM d WHERE k % 3 = 0 UNION ALL SELECT dataset, 'unknown_target', 'no_such_field' FROM d WHERE k % 3 = 0
    UNION ALL SELECT dataset, 'duplicate_target', 'outstanding_balance' FROM d WHERE k % 5 = 0"""
)
def q10_mapping_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = lake_columns(spark, sf_dir).where(F.col("dataset").startswith("tape_"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("tape_"), F.col("s_suppkey").cast("string")).alias("dataset"), F.col("s_suppkey").alias("k"))
    m = lambda a, b, cond: F.when(cond, F.struct(F.lit(a).alias("source"), F.lit(b).alias("target")))
    yes = F.lit(True)
    maps = F.array_compact(
        F.array(
            m("CurrentBalance", "outstanding_balance", yes), m("loan_no", "loan_id", yes), m("coupon_rate", "currency_code", F.col("k") % 2 == 0), m("riskGrade", "maturity_date", F.col("k") % 4 == 0), m("nothing", "no_such_field", F.col("k") % 3 == 0),
            m("CurrentBalance", "outstanding_balance", F.col("k") % 5 == 0),
        )
    )
    mappings = s.select("dataset", F.explode(maps).alias("m")).select("dataset", "m.*")
    return matching.readiness(columns, mappings, ["as_of_date", "loan_id"]).where("not (problem = 'duplicate_source')")


_MANIFESTS = """
    manifests AS (SELECT o_custkey AS dataset_id, CAST(o_orderdate AS DATE) AS d, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS sequence,
        LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS corrects_id FROM orders)"""


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders in time as one chain of revisions; every 40th link is broken."""
    views(spark, sf_dir, "orders")
    m = spark.sql(f"WITH {_MANIFESTS} SELECT * FROM manifests")
    sha = lambda c: F.sha2(F.col(c).cast("string"), 256)
    broken = F.col("o_orderkey") % 40 == 0
    return m.select("dataset_id", F.col("o_orderkey").alias("manifest_id"), sha("o_orderkey").alias("content_hash"), "sequence", "corrects_id", F.when(broken & F.col("corrects_id").isNotNull(), "x").otherwise(sha("corrects_id")).alias("corrects_hash"), F.col("d").alias("known_at"), F.lit("core").alias("source_system"), F.lit(PERIODS[-1]).cast("date").alias("as_of_date"))


@query(f"WITH {_MANIFESTS} SELECT dataset_id, MAX_BY(o_orderkey, sequence) AS manifest_id, MAX(sequence) AS sequence FROM manifests WHERE d <= DATE '1999-06-30' GROUP BY 1")
def j16_terminal_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.terminal_revisions(manifests(spark, sf_dir), F.lit("1999-06-30").cast("date"), ["dataset_id"]).select("dataset_id", "manifest_id", "sequence")


@query(f"WITH {_MANIFESTS} SELECT DISTINCT dataset_id, 'parent' AS problem FROM manifests WHERE corrects_id IS NOT NULL AND o_orderkey % 40 = 0")
def j16_chain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.chain_violations(manifests(spark, sf_dir), ["dataset_id"])


@query("SELECT o_custkey AS dataset_id, CAST(1 AS BIGINT) AS dates, DATE '1999-12-31' AS first, DATE '1999-12-31' AS last, TRUE AS unique_dates, TRUE AS one_source FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1999-06-30' GROUP BY 1")
def j17_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = history.terminal_revisions(manifests(spark, sf_dir), F.lit("1999-06-30").cast("date"), ["dataset_id"])
    return history.bundle(last)


_RATES = """
    rates AS (SELECT CASE p_partkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' ELSE 'GBP' END AS base, CAST(DATE '1999-09-01' + CAST(p_partkey % 120 AS INT) AS DATE) AS effective_on, CAST(p_partkey AS BIGINT) AS received_at, CAST(1 + CAST(p_partkey % 97 AS DECIMAL(12,6)) / 100 AS DECIMAL(12,6)) AS rate, CAST(p_partkey AS VARCHAR(20)) AS rate_hash FROM part)"""


_QUOTES = "quotes AS (SELECT base, effective_on, CAST(effective_on + CAST(received_at % 50 AS INT) AS DATE) AS received_at, rate, rate_hash FROM rates)"
_KNOWN = "CAST(as_of_date + CAST(5 + CAST(loan_id AS BIGINT) % 3 * 15 AS INT) AS DATE)"


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "part")
    return spark.sql(f"WITH {_RATES} SELECT * FROM rates".replace("DATE '1999-09-01' + CAST(p_partkey % 120 AS INT)", "date_add(DATE '1999-09-01', CAST(p_partkey % 120 AS INT))"))


@query(
    with_tape(f"""
    , {_RATES}, {_QUOTES}, t AS (SELECT as_of_date, currency, {_KNOWN} AS known_at FROM tape), d AS (SELECT as_of_date, currency, known_at, COUNT(*) AS loans FROM t GROUP BY ALL)
    SELECT as_of_date, currency, known_at, loans, (SELECT q.rate FROM quotes q WHERE q.base = d.currency AND q.effective_on <= d.as_of_date AND q.received_at <= d.known_at ORDER BY q.effective_on DESC, q.received_at DESC, q.rate_hash DESC LIMIT 1) AS rate FROM d""")
)
def j13_fx_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates as known some days after each loan's date; quotes arrive up to 49 days after they take effect."""
    quotes = _rates(spark, sf_dir).withColumn("received_at", F.date_add("effective_on", (F.col("received_at") % 50).cast("int")))
    rows = tape(spark, sf_dir).select("as_of_date", "currency", F.date_add("as_of_date", (5 + F.col("loan_id").cast("long") % 3 * 15).cast("int")).alias("known_at"))
    rated = history.rates_as_of(rows, quotes)
    return rated.groupBy("as_of_date", "currency", "known_at").agg(F.count("*").alias("loans"), F.max("rate").alias("rate"))


@query(
    with_tape(f"""
    , {_RATES}, q AS (SELECT base AS currency, CASE WHEN received_at % 2 = 0 THEN 'closing' ELSE 'average' END AS rate_type, received_at % 3 AS definition, effective_on, CAST(effective_on + CAST(received_at % 50 AS INT) AS DATE) AS received_at, rate, rate_hash FROM rates),
    t AS (SELECT loan_id, source_system, facility_id, as_of_date, currency, CASE WHEN days_past_due > 60 THEN 'average' ELSE 'closing' END AS rate_type, CAST(loan_id AS BIGINT) % 3 AS definition, CAST(as_of_date + CAST(CAST(loan_id AS BIGINT) % 61 AS INT) AS DATE) AS known_at FROM tape),
    d AS (SELECT DISTINCT currency, rate_type, definition, as_of_date, known_at FROM t),
    r AS (SELECT *, (SELECT q.rate_hash FROM q WHERE q.currency = d.currency AND q.rate_type = d.rate_type AND q.definition = d.definition AND q.effective_on <= d.as_of_date AND q.received_at <= d.known_at ORDER BY q.effective_on DESC, q.received_at DESC, q.rate_hash DESC LIMIT 1) AS h FROM d)
    SELECT t.loan_id, t.source_system, t.facility_id, t.as_of_date, q.rate, q.effective_on FROM t JOIN r USING (currency, rate_type, definition, as_of_date, known_at) LEFT JOIN q ON q.rate_hash = r.h""")
)
def j13_fx_rate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every loan has its own cutoff, within two months of its date; rate type and definition must agree as well."""
    loan = F.col("loan_id").cast("long")
    kind = F.when(F.col("days_past_due") > 60, "average").otherwise("closing")
    rows = tape(spark, sf_dir).select("loan_id", "source_system", "facility_id", "as_of_date", "currency", kind.alias("rate_type"), (loan % 3).alias("definition"), F.date_add("as_of_date", (loan % 61).cast("int")).alias("known_at"))
    n = F.col("received_at")
    quotes = _rates(spark, sf_dir).withColumns({"rate_type": F.when(n % 2 == 0, "closing").otherwise("average"), "definition": n % 3, "received_at": F.date_add("effective_on", (n % 50).cast("int"))})
    rated = history.rates_as_of(rows, quotes, same=("rate_type", "definition"))
    return rated.select("loan_id", "source_system", "facility_id", "as_of_date", "rate", "effective_on")


@query(
    f"""WITH {_RATES} SELECT rate_hash, base AS other,
        CASE WHEN received_at % 2 = 0 THEN CAST(rate AS DECIMAL(20,12)) ELSE CAST(round_even(1 / CAST(rate AS DOUBLE), 12) AS DECIMAL(20,12)) END AS normal_rate FROM rates"""
)
def b19_normal_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of every currency against a base XXX; every other one is the wrong way round."""
    quotes = _rates(spark, sf_dir)
    flip = F.col("received_at") % 2 != 0
    given = quotes.select("rate_hash", F.when(flip, F.col("base")).otherwise("XXX").alias("base"), F.when(flip, "XXX").otherwise(F.col("base")).alias("quote"), F.col("rate").alias("source_rate"))
    return history.normalise_quotes(given, "XXX").select("rate_hash", "other", "normal_rate")


@query(
    with_tape(f"""
    , {_RATES}, l AS (SELECT base, effective_on, MAX_BY(rate, received_at) AS rate FROM rates GROUP BY 1, 2),
    d AS (SELECT DISTINCT as_of_date, currency FROM tape), r AS (SELECT d.*, (SELECT l.rate FROM l WHERE l.base = d.currency AND l.effective_on <= d.as_of_date ORDER BY l.effective_on DESC LIMIT 1) AS rate FROM d)
    SELECT t.as_of_date, t.loan_id, CAST(round_even(t.outstanding_balance * r.rate, 2) AS DECIMAL(38,2)) AS converted FROM tape t JOIN r ON r.as_of_date = t.as_of_date AND r.currency = t.currency WHERE t.currency = 'EUR'""")
)
def b19_fx_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir).where("currency = 'EUR'").withColumn("known_at", F.lit(1 << 40))
    rated = history.rates_as_of(rows, _rates(spark, sf_dir)).where("rate is not null")
    return rated.select("as_of_date", "loan_id", history.convert(F.col("outstanding_balance"), F.col("rate")).cast("decimal(38,2)").alias("converted"))


_MEMBERS = """
    cand AS (SELECT facility_id AS cell, loan_id AS token FROM tape WHERE period_idx = 3),
    rel AS (SELECT facility_id AS cell, period_idx AS release_id, loan_id AS token FROM tape WHERE period_idx IN (1, 2) AND NOT (facility_id = 'F4' AND CAST(loan_id AS BIGINT) % 50 < 2))"""


@query(
    with_tape(f"""
    , {_MEMBERS}, s AS (SELECT cell, COUNT(DISTINCT token) AS n FROM cand GROUP BY 1), m AS (SELECT cell, release_id, COUNT(DISTINCT token) AS m FROM rel GROUP BY 1, 2),
    b AS (SELECT r.cell, r.release_id, COUNT(*) AS shared FROM rel r JOIN cand c ON c.cell = r.cell AND c.token = r.token GROUP BY 1, 2),
    k AS (SELECT DISTINCT m.cell FROM m JOIN s USING (cell) LEFT JOIN b USING (cell, release_id) WHERE (n - COALESCE(shared, 0) BETWEEN 1 AND 9) OR (m - COALESCE(shared, 0) BETWEEN 1 AND 9))
    SELECT cell, n, CASE WHEN n < 10 THEN 'deny_small_cell' WHEN cell IN (SELECT cell FROM k) THEN 'deny_differencing_risk' ELSE 'permit' END AS decision FROM s""")
)
def j18_m11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sizes, releases and shared members are read from one table of members, not from a join of the star schema each.
    rows = written(tape(spark, sf_dir).select(F.col("facility_id").alias("cell"), F.col("loan_id").alias("token"), "period_idx"), "members")
    old = rows.where("period_idx in (1, 2) and not (cell = 'F4' and cast(token as bigint) % 50 < 2)").withColumn("release_id", F.col("period_idx")).withColumn("released_at", F.col("period_idx"))
    return disclosure.differencing(rows.where("period_idx = 3").drop("period_idx"), old.drop("period_idx"), ["cell"], 10)


@query("SELECT user_id, seq, rows, disclosed, disclosed <= 200 AS allowed FROM (SELECT user_id, event_id AS seq, event_id % 20 AS rows, CAST(SUM(event_id % 20) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS disclosed FROM events)")
def m12_disclosure_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("seq"), (F.col("event_id") % 20).alias("rows"))
    return disclosure.budget(log, ["user_id"], 200)


@query(with_tape("SELECT loan_id, as_of_date, outstanding_balance FROM tape WHERE outstanding_balance > 100000 AND (risk_rating IN ('1-URGENT', '2-HIGH') OR days_past_due IS NULL) AND loan_id > '3' ORDER BY as_of_date, loan_id LIMIT 50 OFFSET 25"))
def f2_t5_investigation_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"op": "and", "args": [{"op": "gt", "field": "outstanding_balance", "value": "100000"}, {"op": "or", "args": [{"op": "in", "field": "risk_rating", "values": ["1-URGENT", "2-HIGH"]}, {"op": "is_null", "field": "days_past_due"}]}]}
    rows = tape(spark, sf_dir).where(filters.investigation_filter(tree)).where("loan_id > '3'").select("loan_id", "as_of_date", "outstanding_balance")
    return disclosure.page(rows, ["as_of_date", "loan_id"], 25, 50)


@query(with_tape("SELECT loan_id, source_system, as_of_date, outstanding_balance FROM tape WHERE outstanding_balance IS NOT NULL AND (as_of_date < DATE '1999-11-30' OR (as_of_date = DATE '1999-11-30' AND (loan_id > '50' OR (loan_id = '50' AND source_system > 'core')))) ORDER BY as_of_date DESC, loan_id, source_system LIMIT 200"))
def t5_page_after_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page that follows a loan of November: newest dates first, then by id."""
    rows = tape(spark, sf_dir).where("outstanding_balance is not null").select("loan_id", "source_system", "as_of_date", "outstanding_balance")
    last = {"as_of_date": datetime.date(1999, 11, 30), "loan_id": "50", "source_system": "core"}
    return disclosure.page_after(rows, [("as_of_date", False), ("loan_id", True), ("source_system", True)], last, 200)


@query(with_tape("SELECT as_of_date, COUNT(*) AS loans FROM tape WHERE facility_id NOT IN (SELECT DISTINCT facility_id FROM tape WHERE CAST(loan_id AS BIGINT) % 900 = 1) AND outstanding_balance <= 50000.5 AND outstanding_balance > 10 GROUP BY 1"))
def f7_f9_watermark_and_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir)
    off = rows.where("cast(loan_id as bigint) % 900 = 1")
    return filters.watermark(filters.without_disabled(rows, off, ["facility_id"]), "outstanding_balance", "50000.5", "decimal", "10").groupBy("as_of_date").agg(F.count("*").alias("loans"))


@query(
    with_tape("""
    , c AS (SELECT industry_code, risk_rating, COUNT(*) AS n, SUM(outstanding_balance) AS v FROM tape WHERE period_idx = 3 AND risk_rating IS NOT NULL GROUP BY 1, 2)
    SELECT industry_code, CAST(MAX(CASE WHEN risk_rating = '1-URGENT' AND n >= 30 THEN v END) AS DECIMAL(38,2)) AS "1-URGENT", CAST(MAX(CASE WHEN risk_rating = '5-LOW' AND n >= 30 THEN v END) AS DECIMAL(38,2)) AS "5-LOW", CAST(SUM((n < 30)::INT) AS BIGINT) AS suppressed_cells FROM c GROUP BY 1""")
)
def a26_report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tape(spark, sf_dir).where("period_idx = 3 and risk_rating is not null").groupBy("industry_code", "risk_rating").agg(F.count("*").alias("n"), F.sum("outstanding_balance").cast("decimal(38,2)").alias("value"))
    return disclosure.report_table(rows.withColumn("suppressed", F.col("n") < 30), "industry_code", "risk_rating", ["1-URGENT", "5-LOW"])


@query(
    with_tape("""
    , c AS (SELECT facility_id, as_of_date, SUM(outstanding_balance) AS value FROM tape GROUP BY 1, 2), o AS (SELECT facility_id, as_of_date, value + CASE WHEN facility_id = 'F7' THEN 1 ELSE 0 END AS value FROM c)
    SELECT facility_id, as_of_date, CAST(value AS DECIMAL(38,2)) AS value FROM o ANTI JOIN c USING (facility_id, as_of_date, value)""")
)
def j19_unbacked_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = tape(spark, sf_dir).groupBy("facility_id", "as_of_date").agg(F.sum("outstanding_balance").cast("decimal(38,2)").alias("value"))
    seen = cells.withColumn("value", (F.col("value") + F.when(F.col("facility_id") == "F7", 1).otherwise(0)).cast("decimal(38,2)"))
    return disclosure.unbacked(seen, cells, ["facility_id", "as_of_date"])


@query(
    """WITH f AS (SELECT CAST(event_id % 700 AS VARCHAR) AS metric_id, CAST(user_id AS VARCHAR) AS ref FROM events), d AS (SELECT DISTINCT CAST(p_partkey % 900 AS VARCHAR) AS metric_id FROM part), t AS (SELECT CAST(c_custkey AS VARCHAR) AS ref FROM customer WHERE c_custkey % 2 = 0)
    SELECT 'unknown' AS problem, metric_id FROM (SELECT DISTINCT metric_id FROM f) ANTI JOIN d USING (metric_id) UNION ALL SELECT 'duplicate', metric_id FROM f GROUP BY metric_id HAVING COUNT(*) > 1
    UNION ALL SELECT 'missing', metric_id FROM d ANTI JOIN f USING (metric_id) UNION ALL SELECT 'untrusted', metric_id FROM (SELECT DISTINCT metric_id FROM f ANTI JOIN t USING (ref))"""
)
def j20_sidecar_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    facts = e.select((F.col("event_id") % 700).cast("string").alias("metric_id"), F.array(F.col("user_id").cast("string")).alias("evidence"))
    defs = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 900).cast("string").alias("metric_id"))
    trusted = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("ref"))
    return disclosure.sidecar_problems(facts, defs, trusted)


@query(
    """WITH c AS (SELECT l_orderkey AS cell_id, CAST(l_suppkey AS VARCHAR) AS population_hash FROM lineitem), s AS (SELECT CAST(s_suppkey AS VARCHAR) AS population_hash FROM supplier WHERE s_suppkey % 10 <> 0)
    SELECT DISTINCT cell_id, population_hash FROM c ANTI JOIN s USING (population_hash)"""
)
def j21_report_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("cell_id")).agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("populations"))
    ok = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey % 10 <> 0").select(F.col("s_suppkey").cast("string").alias("population_hash"))
    return disclosure.unbacked_lineage(cells, ok)


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/ledgerloom-{uuid.uuid4().hex}"


_ORDERS_TEXT = "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, o_orderpriority FROM orders"
_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _orders_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(*[F.col(c).cast("string") for c in _COLS])


@query(_ORDERS_TEXT)
def s1_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    _orders_text(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return tapes.read_csv(spark, path, _COLS)


@query(_ORDERS_TEXT)
def s2_json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of at most 512 neighbouring objects, one array a line of a text file, however many rows there are."""
    path = _folder(spark)
    rows = _orders_text(spark, sf_dir)
    part = F.shiftright(F.monotonically_increasing_id(), 9)
    arrays = rows.select(*_COLS, part.alias("p")).groupBy("p").agg(F.to_json(F.collect_list(F.struct(*_COLS))).alias("value"))
    arrays.select("value").write.text(path)
    return tapes.read_json_array(spark, path, _COLS, by_line=True)


@query(_ORDERS_TEXT)
def s2_one_array_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each file is one array over many lines; it is read by ranges."""
    path = _folder(spark)

    def bracketed(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(["["])], names=["value"])
        before = ""
        for batch in batches:
            lines = []
            for value in batch.column(0).to_pylist():
                lines.append(before + value)
                before = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], names=["value"])

    _orders_text(spark, sf_dir).select(F.to_json(F.struct(*_COLS)).alias("value")).mapInArrow(bracketed, "value string").write.text(path)
    return tapes.read_json_array(spark, path, _COLS)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) || chr(10) || '"' || o_orderpriority || '", }' || chr(13) || chr(10) || o_orderstatus AS note, o_orderstatus AS o_orderstatus FROM orders""")
def s1_quoted_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with line breaks, quotes and commas; ranges of a file may begin inside them."""
    path = _folder(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    note = F.concat(F.col("o_custkey").cast("string"), F.lit('\n"'), "o_orderpriority", F.lit('", }\r\n'), "o_orderstatus")
    cell = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), cell(note), "o_orderstatus")

    def headed(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(["o_orderkey,note,o_orderstatus"])], names=["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["value"])

    orders.select(line.alias("value")).mapInArrow(headed, "value string").write.text(path)
    return tapes.read_csv(spark, path, ["o_orderkey", "note", "o_orderstatus"])


@query(_ORDERS_TEXT)
def s3_ndjson_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    _orders_text(spark, sf_dir).write.json(path)
    return tapes.read_ndjson(spark, path, _COLS)


@query("SELECT unnest(['o_custkey', 'o_extra', 'o_orderkey', 'o_orderpriority', 'o_orderstatus']) AS \"column\"")
def s4_ragged_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark)
    _orders_text(spark, sf_dir).withColumn("o_extra", F.when(F.col("o_orderkey").cast("long") % 9 == 0, "x")).write.json(path)
    return tapes.ragged_columns(spark, path)


@query("SELECT COUNT(*) AS rows, CAST(SUM(CAST(o_totalprice AS DECIMAL(20,2))) AS DECIMAL(38,2)) AS total FROM orders")
def s5_parquet_governed(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.read.parquet(f"{sf_dir}/orders.parquet").schema
    declared = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    return tapes.read_parquet(spark, f"{sf_dir}/orders.parquet", expected, declared).agg(F.count("*").alias("rows"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("decimal(38,2)").alias("total"))


@query(
    """SELECT o_orderstatus AS part, COUNT(*) AS rows, CASE o_orderstatus WHEN 'F' THEN 'unexpected note string required' WHEN 'P' THEN 'missing o_totalprice decimal(20,2) optional,unexpected o_totalprice decimal(18,2) optional'
        ELSE '' END AS problems FROM orders GROUP BY 1"""
)
def s5_footer_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in folders by status, one with a column too many and one of another precision: what the footers say of each file."""
    path = _folder(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(20,2)").alias("o_totalprice"))
    expected = orders.schema
    status = F.col("o_orderstatus")
    deliveries = [
        orders.where(status == "F").withColumn("note", F.lit("x")),
        orders.where(status == "P").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")),
        orders.where(~F.coalesce(status.isin("F", "P"), F.lit(False))),
    ]
    # By partition a task without rows leaves no file; else the first task would leave one without a row group, which is a problem.
    for rows in deliveries:
        rows.withColumn("part", status).write.mode("append").partitionBy("part").parquet(path)
    found = footers.footers(spark, path)
    folder = F.url_decode(F.replace(F.regexp_extract("file", r"/part=([^/]*)/[^/]*$", 1), F.lit("+"), F.lit("%2B")))
    part = F.when(folder != "__HIVE_DEFAULT_PARTITION__", folder).alias("part")
    bad = footers.problems(found, expected).select(part, "problem").distinct().groupBy("part").agg(F.array_join(F.array_sort(F.collect_list("problem")), ",").alias("problems"))
    rows = found.groupBy(part).agg(F.sum("rows").alias("rows"))
    return rows.alias("a").join(bad.alias("b"), F.col("a.part").eqNullSafe(F.col("b.part")), "left").select("a.part", "rows", F.coalesce("problems", F.lit("")).alias("problems"))


@query("""WITH o AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus, CAST(o_orderdate AS VARCHAR)[:10] AS day FROM orders)
    SELECT o_orderstatus, COUNT(*) AS rows, CAST(SUM(o_orderkey) AS BIGINT) AS keys, MAX(o_custkey) AS last_customer, (SELECT COUNT(*) FROM o WHERE day <= '1998-06-30') AS attested FROM o WHERE day <= '1998-06-30' AND o_orderkey >= 100 GROUP BY 1""")
def s8_sqlite_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as SQLite files, one a task, read back by ranges of row ids up to a watermark, with their attestation."""
    path = re.sub("^file:/*", "/", _folder(spark))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), "o_orderstatus", F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("day"))

    def store(batches):
        import os
        import sqlite3

        import pyarrow as pa

        os.makedirs(path, exist_ok=True)
        name = f"{path}/{uuid.uuid4().hex}.db"
        con = sqlite3.connect(name)
        con.execute("CREATE TABLE orders (o_orderkey INTEGER, o_custkey TEXT, o_orderstatus TEXT, day TEXT)")
        for batch in batches:
            con.executemany("INSERT INTO orders VALUES (?, ?, ?, ?)", zip(*(c.to_pylist() for c in batch.columns), strict=True))
        con.commit()
        con.close()
        yield pa.RecordBatch.from_arrays([pa.array([name])], names=["path"])

    # A task that ran twice has left a file that nobody names.
    paths = [r.path for r in orders.repartition(4).mapInArrow(store, "path string").collect()]
    kinds = T.StructType([T.StructField(c, T.LongType() if c == "o_orderkey" else T.StringType()) for c in orders.columns])
    rows, attested = sqlite.sqlite_snapshot(spark, paths, "orders", kinds, ("day", "1998-06-30"))
    total = attested.agg(F.sum("source_rows").alias("attested"))
    found = rows.where("o_orderkey >= 100").groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"), F.max("o_custkey").alias("last_customer"))
    return found.crossJoin(F.broadcast(total))


@query(with_tape("SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, COUNT(*) AS rows, CAST(SUM(CASE WHEN period_idx = 2 THEN 1 ELSE 0 END) AS BIGINT) AS off FROM tape GROUP BY 1"))
def s6_partition_column_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files carry their date inside too; one folder was moved to another date, so that its rows are off."""
    path = _folder(spark)
    rows = tape(spark, sf_dir).select("loan_id", F.col("as_of_date").alias("own_date"), F.when(F.col("period_idx") == 2, F.lit("1999-12-15").cast("date")).otherwise(F.col("as_of_date")).alias("as_of_date"))
    tapes.write_snapshot(rows, path, "demo")
    back = spark.read.parquet(path)
    bad = tapes.partition_mismatch(back, {}, {"as_of_date": "own_date"}).groupBy("own_date").agg(F.count("*").alias("off"))
    whole = back.groupBy("own_date").agg(F.count("*").alias("rows"))
    return whole.join(bad, "own_date", "left").select(F.col("own_date").cast("string").alias("as_of_date"), "rows", F.coalesce("off", F.lit(0)).cast("long").alias("off"))


@query(with_tape("SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, COUNT(*) AS rows FROM tape GROUP BY 1"))
def s6_s12_partitioned_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write once by date, read back, and hold each partition against its expectation."""
    path = _folder(spark)
    tapes.write_snapshot(tape(spark, sf_dir).select("as_of_date", *KEY, "outstanding_balance"), path, "demo")
    back = spark.read.parquet(path)
    bad = tapes.partition_mismatch(back.where(F.col("as_of_date") == PERIODS[0]), {"as_of_date": PERIODS[0]})
    return back.join(bad.select("loan_id"), "loan_id", "left_anti").groupBy(F.col("as_of_date").cast("string").alias("as_of_date")).agg(F.count("*").alias("rows"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment FROM customer")
def s7_worksheet_conformance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as cells of worksheets, up to 100 rows a file, with a blank row at the end of each."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    file, row = F.floor(F.col("c_custkey") / 100), (F.col("c_custkey") % 100 + 2)
    cell = lambda i, v: F.struct(F.lit(i).alias("col"), v.cast("string").alias("value"))
    body = c.select(file.alias("file"), row.alias("row"), F.explode(F.array(cell(1, F.col("c_custkey")), cell(2, F.col("c_name")), cell(3, F.col("c_mktsegment")))).alias("x")).select("file", "row", "x.*")
    files = c.select(file.alias("file")).distinct()
    head = files.select("file", F.lit(1).alias("row"), F.explode(F.array(cell(1, F.lit("id")), cell(2, F.lit("name")), cell(3, F.lit("segment")))).alias("x")).select("file", "row", "x.*")
    tail = files.select("file", F.lit(400).alias("row"), F.lit(1).alias("col"), F.lit(" ").alias("value"))
    cells = body.union(head).union(tail).select("file", F.lit("Tape").alias("sheet"), "row", "col", F.lit("text").alias("kind"), "value")
    # Rows of a file start right below the header only where its first key is present.
    return tapes.worksheet_rows(_compact(cells), "Tape", 1, ["id", "name", "segment"]).select("id", "name", "segment")


def _compact(cells: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    dense = F.dense_rank().over(Window.partitionBy("file", "sheet").orderBy("row"))
    return cells.withColumn("row", dense)


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority FROM orders WHERE o_orderdate <= '1999-06-30' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey ASC NULLS FIRST LIMIT 1001")
def s8_sql_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    sql = tapes.snapshot_query("orders", ["o_orderkey", "o_orderpriority"], ["o_orderkey"], ("o_orderdate", "1999-06-30"), [("o_orderdate", "desc", "last"), ("o_orderkey", "asc", "first")], 1000)
    return spark.sql(sql)


@query("SELECT COUNT(*) AS rows, CAST(MAX(greatest(length(CAST(c_custkey AS VARCHAR)), length(c_name), length(c_mktsegment))) AS INT) AS max_cell_bytes, TRUE AS allowed FROM customer")
def s10_population_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_mktsegment")
    return tapes.population_limits(c, ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"]).drop("max_row_bytes")


@query("""SELECT 'o_custkey' AS "column", 'integer' AS kinds, FALSE AS nullable UNION ALL SELECT 'o_orderkey', 'integer', FALSE UNION ALL SELECT 'o_orderpriority', 'text', FALSE UNION ALL SELECT 'o_orderstatus', 'text', FALSE""")
def s13_infer_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.infer_kinds(_orders_text(spark, sf_dir))


_HASHED = ["period_idx", "as_of_date", "source_system", "facility_id", "loan_id", "outstanding_balance", "days_past_due", "interest_rate", "default_flag"]
_FIELDS = '[["period_idx","int"],["as_of_date","date"],["source_system","string"],["facility_id","string"],["loan_id","string"],["outstanding_balance","decimal(20,2)"],["days_past_due","int"],["interest_rate","decimal(12,4)"],["default_flag","boolean"]]'


@query(
    with_tape(f"""SELECT sha256(COUNT(*) || ':' || {digest_sums_sql("d")}) AS content_hash, COUNT(*) AS rows, sha256('{_FIELDS}') AS field_hash
        FROM (SELECT sha256(to_json([{", ".join(f"CAST({c} AS VARCHAR)" for c in _HASHED)}])) AS d FROM tape)""")
)
def s14_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapes.content_hash(tape(spark, sf_dir).select(*_HASHED))


@query("SELECT COALESCE(m.k, a.k) AS section_id, m.n AS rows, a.n AS actual FROM (SELECT o_orderstatus AS k, COUNT(*) + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS n FROM orders GROUP BY 1) m FULL JOIN (SELECT o_orderstatus AS k, COUNT(*) AS n FROM orders GROUP BY 1) a ON a.k = m.k WHERE m.n IS DISTINCT FROM a.n")
def s15_section_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumnRenamed("o_orderstatus", "section_id")
    declared = rows.groupBy("section_id").agg((F.count("*") + F.when(F.col("section_id") == "P", 1).otherwise(0)).alias("rows"))
    return tapes.section_gaps(rows, declared)
