"""Monitors, alerts, deliveries and staged runs over daily series of the event table."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import mapping
from ..operators import monitor as m
from ..operators import quality as q
from ..operators import staged
from ..operators.stratification import stratify
from ..streaming import streams
from ..streaming.monitors import PROVIDER, monitor_stream
from ..streaming.table_log import TableLog
from .registry import query
from .tape import KEY, PERIODS, tape, with_tape, written

_POINTS = """
    points AS (SELECT user_id AS series, CAST(ts AS DATE) AS as_of_date, MIN(event_id) AS point_id, CASE WHEN MIN(event_id) % 23 = 0 THEN NULL ELSE CAST(COUNT(*) * 10 + MIN(event_id) % 10 AS BIGINT) END AS value FROM events GROUP BY 1, 2)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    g = e.groupBy(F.col("user_id").alias("series"), F.to_date("ts").alias("as_of_date")).agg(F.min("event_id").alias("point_id"), F.count("*").alias("n"))
    return g.select("series", "as_of_date", "point_id", F.when(F.col("point_id") % 23 != 0, F.col("n") * 10 + F.col("point_id") % 10).alias("value"))


_ORDER = ["as_of_date", "point_id"]
_W = "OVER (PARTITION BY series ORDER BY as_of_date, point_id"


@query(f"WITH {_POINTS} SELECT point_id, CAST(value - lag(value, 2) {_W}) AS DOUBLE) AS delta, CASE WHEN lag(value) {_W}) <> 0 THEN CAST(value - lag(value) {_W}) AS DOUBLE) / CAST(abs(lag(value) {_W})) AS DOUBLE) END AS percent FROM points")
def w7_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value").cast("double")
    return points(spark, sf_dir).select("point_id", m.change(v, ["series"], _ORDER, 2, False).alias("delta"), m.change(v, ["series"], _ORDER, 1, True).alias("percent"))


@query(
    f"""WITH {_POINTS}, r AS (SELECT point_id, COUNT(value) {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c, COUNT(*) {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, SUM(value) {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, MAX(value) {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x FROM points)
    SELECT point_id, CASE WHEN c = n AND n >= 2 THEN CAST(s AS DOUBLE) / CAST(n AS DOUBLE) END AS mean3, CASE WHEN c = n AND n >= 3 THEN x END AS max3 FROM r"""
)
def w8_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return points(spark, sf_dir).select("point_id", m.rolling(v, ["series"], _ORDER, 3, "avg", 2).alias("mean3"), m.rolling(v, ["series"], _ORDER, 3, "max", 3).alias("max3"))


@query(f"WITH {_POINTS} SELECT point_id, COUNT(*) {_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) = 2 AND COALESCE(MIN(COALESCE(value >= 30, FALSE)::INT) {_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW), 0) = 1 AS both FROM points")
def w9_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("point_id", m.consecutive(F.col("value") >= 30, ["series"], _ORDER, 2).alias("both"))


@query(
    with_tape("""
    , o AS (SELECT facility_id AS metric_id, as_of_date, CAST(SUM(outstanding_balance) AS DECIMAL(38,2)) AS value FROM tape WHERE facility_id <> 'F9' GROUP BY 1, 2),
    d AS (SELECT CONCAT('F', CAST(n_nationkey AS VARCHAR)) AS metric_id, n_nationkey AS k FROM nation)
    SELECT 'm' || CAST(k AS VARCHAR) AS monitor_id, d.metric_id, CASE WHEN o.metric_id IS NULL THEN 'missing_observation' WHEN k % 5 = 1 THEN 'unit_mismatch' WHEN CASE WHEN k % 2 = 0 THEN value > 40000000 ELSE value <= 30000000 END THEN 'alert' ELSE 'clear' END AS outcome
    FROM d LEFT JOIN o ON o.metric_id = d.metric_id AND o.as_of_date = DATE '1999-12-31'""")
)
def m1_monitor_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k, day = F.col("n_nationkey"), F.lit("1999-12-31").cast("date")
    monitors = n.select(
        F.concat(F.lit("m"), k.cast("string")).alias("monitor_id"), F.concat(F.lit("F"), k.cast("string")).alias("metric_id"), F.lit("1999-12-31").alias("snapshot_id"), day.alias("as_of_date"), F.lit("decimal").alias("type"),
        F.when(k % 2 == 0, "gt").otherwise("lte").alias("op"), F.when(k % 2 == 0, 40000000).otherwise(30000000).cast("decimal(38,2)").alias("bound"), F.lit(None).cast("boolean").alias("bound_flag"), F.when(k % 5 == 1, "EUR").otherwise("USD").alias("unit"),
    )
    rows = tape(spark, sf_dir).where("facility_id <> 'F9'").groupBy(F.col("facility_id").alias("metric_id"), "as_of_date").agg(F.sum("outstanding_balance").cast("decimal(38,2)").alias("value"))
    seen = rows.select("metric_id", F.col("as_of_date").cast("string").alias("snapshot_id"), "as_of_date", F.lit("decimal").alias("type"), "value", F.lit(None).cast("boolean").alias("flag"), F.lit("USD").alias("unit"))
    return m.evaluate_v1(monitors, seen).select("monitor_id", "metric_id", "outcome")


TREE = {"type": "any", "conditions": [{"type": "absolute", "op": "gte", "bound": 45, "reset": 25}, {"type": "change", "op": "gt", "bound": 50, "lookback": 1, "mode": "percent"}, {"type": "rolling", "window": 2, "aggregation": "max", "minimum": 1, "op": "gte", "bound": 60, "reset": 30}]}
_SCOPES = """scopes AS (SELECT user_id AS series, CAST(user_id % 3 = 0 AS BOOLEAN) AS case_open, CASE WHEN user_id % 3 = 0 THEN DATE '2024-01-20' + CAST(user_id % 10 AS INT) END AS last_triggered FROM (SELECT DISTINCT user_id FROM events UNION SELECT -1 - n_nationkey FROM nation))"""


@query(
    f"""WITH {_POINTS}, {_SCOPES}, p AS (SELECT *, lag(value) {_W}) AS was, COUNT(value) {_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS c, COUNT(*) {_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n, MAX(value) {_W} ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS x, ROW_NUMBER() OVER (PARTITION BY series ORDER BY as_of_date DESC, point_id DESC) AS rn FROM points WHERE as_of_date <= DATE '2024-01-29'),
    h AS (SELECT *, value IS NOT NULL AND was IS NOT NULL AND was <> 0 AND c = n AS known, value >= 45 OR CAST(value - was AS DOUBLE) / CAST(abs(was) AS DOUBLE) * 100 > 50 OR x >= 60 AS hit,
        NOT (value >= 25) OR NOT (CAST(value - was AS DOUBLE) / CAST(abs(was) AS DOUBLE) * 100 > 50) OR NOT (x >= 30) AS calm FROM p WHERE rn = 1),
    r AS (SELECT scopes.series, as_of_date, point_id, case_open, CASE WHEN point_id IS NULL THEN 'missing_observation' WHEN date_diff('day', as_of_date, DATE '2024-01-29') > 2 THEN 'stale_observation' WHEN NOT known THEN 'insufficient_history'
        WHEN hit AND COALESCE(date_diff('day', last_triggered, DATE '2024-01-29') < 5, FALSE) THEN 'cooldown_active' WHEN hit THEN 'condition_triggered' WHEN case_open AND NOT calm THEN 'hysteresis_not_reset' ELSE 'condition_clear' END AS reason FROM scopes LEFT JOIN h USING (series))
    SELECT series, as_of_date, point_id, reason, CASE WHEN reason IN ('missing_observation', 'stale_observation', 'insufficient_history') THEN 'blocked' WHEN reason = 'cooldown_active' THEN 'cooldown' WHEN reason = 'condition_triggered' THEN 'triggered' WHEN reason = 'condition_clear' AND case_open THEN 'reset' ELSE 'clear' END AS outcome FROM r"""
)
def m2_m3_monitor_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").union(spark.read.parquet(f"{sf_dir}/nation.parquet").select(-1 - F.col("n_nationkey"))).distinct()
    state = F.when(F.col("user_id") % 3 == 0, F.date_add(F.lit("2024-01-20").cast("date"), (F.col("user_id") % 10).cast("int")))
    scopes = users.select(F.col("user_id").alias("series"), (F.col("user_id") % 3 == 0).alias("case_open"), state.alias("last_triggered"))
    return m.evaluate_v2(scopes, points(spark, sf_dir), TREE, ["series"], F.lit("2024-01-29").cast("date"), 2, "block", 5, ("2024-01-01", None)).drop("value")


@query(
    f"""WITH {_POINTS}, p AS (SELECT *, COUNT(value) {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c, COUNT(*) {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n, MIN((value >= 15)::INT) {_W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS least, ROW_NUMBER() OVER (PARTITION BY series ORDER BY as_of_date DESC, point_id DESC) AS rn FROM points)
    SELECT series, as_of_date, point_id, CASE WHEN date_diff('day', as_of_date, DATE '2024-02-01') > 9 THEN 'stale_observation' WHEN n < 3 OR c < 3 THEN 'insufficient_history' WHEN least = 1 THEN 'condition_triggered' ELSE 'condition_clear' END AS reason,
        CASE WHEN date_diff('day', as_of_date, DATE '2024-02-01') > 9 OR n < 3 OR c < 3 THEN 'missing' WHEN least = 1 THEN 'triggered' ELSE 'clear' END AS outcome FROM p WHERE rn = 1 AND as_of_date <= DATE '2024-02-01'"""
)
def m3_consecutive_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = points(spark, sf_dir)
    tree = {"type": "consecutive", "periods": 3, "condition": {"type": "absolute", "op": "gte", "bound": 15}}
    return m.evaluate_v2(rows.select("series").distinct(), rows, tree, ["series"], F.lit("2024-02-01").cast("date"), 9).drop("value")


_FOLD = f"""WITH RECURSIVE {_POINTS}, p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY series ORDER BY as_of_date, point_id) AS rn FROM points),
    f AS (
        SELECT series, as_of_date, point_id, value, rn, CASE WHEN value IS NULL THEN 'missing' WHEN value >= 35 THEN 'triggered' ELSE 'clear' END AS transition, COALESCE(value >= 35, FALSE) AS is_open, CASE WHEN value >= 35 THEN as_of_date END AS triggered FROM p WHERE rn = 1
        UNION ALL
        SELECT series, as_of_date, point_id, value, rn, transition, CASE transition WHEN 'triggered' THEN TRUE WHEN 'reset' THEN FALSE ELSE is_open END, CASE transition WHEN 'triggered' THEN as_of_date ELSE triggered END
        FROM (SELECT p.*, f.is_open, f.triggered, CASE WHEN p.value IS NULL THEN 'missing' WHEN p.value >= 35 AND COALESCE(date_diff('day', f.triggered, p.as_of_date) < 3, FALSE) THEN 'cooldown' WHEN p.value >= 35 THEN 'triggered' WHEN f.is_open AND p.value >= 25 THEN 'open' WHEN f.is_open THEN 'reset' ELSE 'clear' END AS transition
            FROM f JOIN p ON p.series = f.series AND p.rn = f.rn + 1))
    SELECT series, as_of_date, point_id, CAST(value AS DOUBLE) AS value, transition FROM f"""


@query(_FOLD)
def m4_stateful_cases_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.fold_cases(points(spark, sf_dir), ["series"], 35.0, 25.0, 3)


def _path(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query(_FOLD)
def m4_stateful_cases_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cases through a stream; equal to the batch fold."""
    at = _path(spark)
    rows = points(spark, sf_dir).select("series", "as_of_date", "point_id", F.col("value").cast("double").alias("value"))
    rows.write.parquet(f"{at}/in")
    stream = streams.file_stream(spark, f"{at}/in", rows.schema)
    return streams.run_to_table(streams.stateful_cases(stream, ["series"], 35.0, 25.0, 3), f"{at}/out", f"{at}/checkpoint")


_DAILY = _FOLD.replace("points AS (", "points0 AS (", 1).replace(", p AS (", ", points AS (SELECT series, as_of_date, CAST(as_of_date AS VARCHAR) AS point_id, MAX(value) AS value FROM points0 GROUP BY 1, 2), p AS (", 1)
_SAID = "CASE transition WHEN 'triggered' THEN 'condition_triggered' WHEN 'cooldown' THEN 'cooldown_active' WHEN 'open' THEN 'hysteresis_not_reset' WHEN 'missing' THEN 'insufficient_history' ELSE 'condition_clear' END"


@query(f"SELECT series, as_of_date AS as_of, point_id, value, CASE transition WHEN 'open' THEN 'clear' ELSE transition END AS outcome, {_SAID} AS reason FROM ({_DAILY})")
def m4_monitor_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest value of each user and day through a stream of many files, judged day by day with the case carried on."""
    at = _path(spark)
    rows = points(spark, sf_dir).groupBy("series", "as_of_date").agg(F.max("value").cast("double").alias("value"))
    rows = rows.select("series", F.col("as_of_date").cast("date").alias("as_of_date"), F.col("as_of_date").cast("string").alias("point_id"), "value")
    rows.repartition(6, "as_of_date").write.parquet(f"{at}/in")
    # A last row of no user, far behind all others, ends their days.
    spark.createDataFrame([(-1, datetime.date(2030, 1, 1), "end", 0.0)], rows.schema).write.mode("append").parquet(f"{at}/in")
    was = spark.conf.get(PROVIDER[0])
    spark.conf.set(*PROVIDER)
    try:
        tree = {"type": "absolute", "op": "gte", "bound": 35.0, "reset": 25.0}
        out = monitor_stream(streams.file_stream(spark, f"{at}/in", rows.schema), tree, ["series"], 36_500, cooldown_days=3, delay_days=100)
        return streams.run_to_table(out, f"{at}/out", f"{at}/checkpoint").where("series >= 0")
    finally:
        spark.conf.set(PROVIDER[0], was)


_OCC = "occ AS (SELECT event_id % 400 AS occurrence_key, user_id AS dedupe_key, ts AS seen_at FROM events)"


@query(f"WITH {_OCC}, o AS (SELECT dedupe_key, occurrence_key, MIN(seen_at) AS seen_at FROM occ GROUP BY 1, 2) SELECT dedupe_key, COUNT(*) AS recurrences, CAST(MIN(seen_at) AS DATE) AS first_seen, CAST(MAX(seen_at) AS DATE) AS last_seen FROM o GROUP BY 1")
def m5_alert_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    occ = e.select((F.col("event_id") % 400).alias("occurrence_key"), F.col("user_id").alias("dedupe_key"), F.col("ts").alias("seen_at"))
    return m.alert_cases(occ).select("dedupe_key", "recurrences", F.to_date("first_seen").alias("first_seen"), F.to_date("last_seen").alias("last_seen"))


_LOG = "log AS (SELECT user_id AS case_id, event_id AS seq, CASE WHEN event_id % 6 = 5 THEN 'occurrence' ELSE 'manual' END AS kind, CASE WHEN event_id % 6 = 5 THEN 'open' ELSE ['open', 'acknowledged', 'escalated', 'resolved', 'suppressed'][CAST(event_id % 5 + 1 AS INT)] END AS status FROM events)"


@query(
    f"""WITH RECURSIVE {_LOG}, p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY case_id ORDER BY seq) AS rn FROM log),
    f AS (
        SELECT case_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS status, CAST(0 AS BIGINT) AS invalid, CAST(0 AS BIGINT) AS reopened FROM (SELECT DISTINCT case_id FROM log)
        UNION ALL
        SELECT case_id, rn, CASE WHEN kind = 'occurrence' THEN CASE WHEN was IS NULL OR was = 'resolved' THEN 'open' ELSE was END WHEN ok THEN status ELSE was END, invalid + (kind = 'manual' AND NOT ok)::INT, reopened + (kind = 'occurrence' AND COALESCE(was = 'resolved', FALSE))::INT
        FROM (SELECT p.*, f.status AS was, f.invalid, f.reopened, COALESCE(CASE p.status WHEN 'acknowledged' THEN f.status = 'open' WHEN 'escalated' THEN f.status IN ('open', 'acknowledged') WHEN 'open' THEN f.status IN ('resolved', 'suppressed') ELSE f.status IN ('open', 'acknowledged', 'escalated') END, FALSE) AS ok
            FROM f JOIN p ON p.case_id = f.case_id AND p.rn = f.rn + 1))
    SELECT case_id, status, invalid, reopened, rn AS events FROM f WHERE rn = (SELECT COUNT(*) FROM log WHERE log.case_id = f.case_id)"""
)
def m6_case_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    names = F.array(*[F.lit(s) for s in ("open", "acknowledged", "escalated", "resolved", "suppressed")])
    auto = F.col("event_id") % 6 == 5
    log = e.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), F.when(auto, "occurrence").otherwise("manual").alias("kind"), F.when(auto, "open").otherwise(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int"))).alias("status"))
    return m.case_status(log)


_DELIVERED = "d AS (SELECT event_type AS source, event_id % 900 AS fingerprint, ts AS observed_at, user_id AS watermark_end FROM events)"


@query(
    f"""WITH {_DELIVERED}, o AS (SELECT source, fingerprint, MIN(observed_at) AS observed_at, MAX(watermark_end) AS w FROM d GROUP BY 1, 2)
    SELECT source, COUNT(*) AS deliveries, CAST(SUM((CAST(floor(epoch(TIMESTAMP '2024-01-15 12:00:00')) AS BIGINT) - CAST(floor(epoch(observed_at)) AS BIGINT) > 3600)::INT) AS BIGINT) AS late, MAX(w) AS high_watermark FROM o GROUP BY 1"""
)
def m7_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = e.select(F.col("event_type").alias("source"), (F.col("event_id") % 900).alias("fingerprint"), F.col("ts").alias("observed_at"), F.col("user_id").alias("watermark_end"))
    return m.deliveries(d, F.lit("2024-01-15 12:00:00").cast("timestamp"), 60)


@query("SELECT event_type AS source, COUNT(DISTINCT event_id % 900) AS deliveries FROM events GROUP BY 1")
def m7_deliveries_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries once per fingerprint through a stream with state for a year."""
    at = _path(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("event_type").alias("source"), (F.col("event_id") % 900).alias("fingerprint"), F.col("ts").cast("timestamp").alias("observed_at"), F.col("ts").cast("timestamp").alias("due_at"))
    rows.write.parquet(f"{at}/in")
    out = streams.run_to_table(streams.delivery_alerts(streams.file_stream(spark, f"{at}/in", rows.schema), 60, "365 days"), f"{at}/out", f"{at}/checkpoint")
    return out.groupBy("source").agg(F.count("*").alias("deliveries"))


@query("SELECT user_id, MAX(event_id) AS event_id FROM events GROUP BY 1")
def m8_upsert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, kept by a sink that repeats of a batch don't change."""
    at = _path(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id")
    rows.repartition(4, "user_id").write.parquet(f"{at}/in")
    streams.upsert_sink(streams.file_stream(spark, f"{at}/in", rows.schema, 2), f"{at}/out", ["user_id"], "event_id", f"{at}/checkpoint").awaitTermination()
    return streams.read_latest(spark, f"{at}/out", ["user_id"], "event_id").select("user_id", "event_id")


@query(
    """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS as_of_date, event_id % 3 AS part FROM events),
    r AS (SELECT as_of_date, 'current' AS kind FROM e WHERE (day(as_of_date) <= 10 AND part = 2) OR (day(as_of_date) > 10 AND part < 2) UNION ALL SELECT as_of_date, 'revision' FROM e WHERE day(as_of_date) > 10 AND part = 2)
    SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, kind, COUNT(*) AS rows FROM r GROUP BY 1, 2"""
)
def m8_delivery_modes_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A full delivery of one third of the events, a delta of another, then a backfill of early days and corrections of the rest."""
    at = _path(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.to_date("ts").alias("as_of_date"))
    modes = ["full", "delta", F.when(F.dayofmonth("as_of_date") <= 10, "backfill").otherwise("correction")]
    for part, mode in enumerate(modes):
        rows = e.where(F.col("event_id") % 3 == part).withColumn("mode", F.lit(mode) if isinstance(mode, str) else mode)
        rows.write.mode("append").parquet(f"{at}/in")
        streams.delivery_sink(streams.file_stream(spark, f"{at}/in", rows.schema), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    each = lambda df, kind: df.groupBy(F.col("as_of_date").cast("string").alias("as_of_date")).agg(F.count("*").alias("rows")).select("as_of_date", F.lit(kind).alias("kind"), "rows")
    return each(streams.read_deliveries(spark, f"{at}/out"), "current").union(each(streams.read_corrections(spark, f"{at}/out"), "revision"))


@query(
    """WITH e AS (SELECT event_id, CAST(ts AS DATE) AS as_of_date, event_id % 5 AS part FROM events),
    k AS (SELECT *, CASE WHEN as_of_date = DATE '2024-01-05' THEN part = 0 WHEN as_of_date = DATE '2024-01-06' THEN FALSE WHEN day(as_of_date) <= 10 THEN part IN (2, 3) ELSE part IN (0, 1, 3) END AS present FROM e)
    SELECT CAST(as_of_date AS VARCHAR) AS as_of_date, 'current' AS kind, COUNT(*) AS rows, CAST(SUM(event_id) AS BIGINT) AS ids FROM k WHERE present GROUP BY 1
    UNION ALL SELECT CAST(as_of_date AS VARCHAR), 'revision of 1', COUNT(*), CAST(SUM(event_id) AS BIGINT) FROM k WHERE day(as_of_date) > 10 AND part = 4 GROUP BY 1"""
)
def m8_table_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six versions of a table of events: full, delta, a backfill of early days, delta, a correction, a full version of two days of which
    one is empty; a checkpoint between them, and two versions that come twice."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.to_date("ts").alias("as_of_date"))
    part = lambda n: e.where(F.col("event_id") % 5 == n)
    log = TableLog(spark, _path(spark), "event_id long, as_of_date date", every=4)
    early, day = F.dayofmonth("as_of_date") <= 10, lambda n: datetime.date(2024, 1, n)
    log.commit(0, part(0), "full", (day(1), datetime.date(2030, 1, 1)))
    log.commit(1, part(1), "delta")
    log.commit(2, part(2).where(early), "backfill", (day(1), day(10)), supersedes=0)
    log.commit(3, part(3), "delta")
    log.commit(4, part(4).where(~early), "correction", supersedes=1)
    log.commit(1, part(1), "delta")
    log.commit(5, part(0).where(F.col("as_of_date") == F.lit(day(5))), "full", (day(5), day(6)))
    log.commit(5, part(2), "full", (day(1), day(31)))
    log.vacuum()
    each = lambda df, kind: df.groupBy(F.col("as_of_date").cast("string").alias("as_of_date"), kind.alias("kind")).agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))
    return each(log.read(), F.lit("current")).union(each(log.corrections(), F.concat(F.lit("revision of "), F.col("supersedes").cast("string"))))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, COUNT(*) AS n FROM events WHERE CAST(ts AS DATE) < (SELECT MAX(CAST(ts AS DATE)) FROM events) GROUP BY 1, 2")
def m9_windowed_totals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily windows of event time in append mode; the last day stays open until its watermark passes."""
    at = _path(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    rows.write.parquet(f"{at}/in")
    totals = streams.windowed_totals(streams.file_stream(spark, f"{at}/in", rows.schema), "ts", "0 seconds", "1 day", ["event_type"], "value")
    out = streams.run_to_table(totals, f"{at}/out", f"{at}/checkpoint")
    return out.select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n")


@query(with_tape("SELECT late, COUNT(*) AS rows FROM (SELECT as_of_date > DATE '1999-11-30' AS late FROM tape) GROUP BY 1"))
def m9_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, late = m.quarantine_late(tape(spark, sf_dir), F.lit("1999-11-30").cast("date"))
    n = lambda df, flag: df.agg(F.count("*").alias("rows")).select(F.lit(flag).alias("late"), "rows")
    return n(good, False).union(n(late, True))


_DELIVERED = ["loan_id", *[k for k in KEY if k != "loan_id"], "as_of_date", "outstanding_balance", "currency", "industry_code", "days_past_due"]


def _run(spark: SparkSession, delivered: DataFrame, broken: bool) -> DataFrame:
    """All stages over a delivery; broken: some balances are negative."""
    given, names = delivered, _DELIVERED
    if broken:
        given = given.withColumn("outstanding_balance", F.when(F.col("loan_id").cast("long") % 201 == 0, "-5").otherwise(F.col("outstanding_balance")))
    declared = given.groupBy(F.col("as_of_date").cast("date").alias("as_of_date")).agg(F.count("*").alias("row_count"), F.sum(F.coalesce(F.col("outstanding_balance").cast("decimal(20,2)"), F.lit(0))).cast("decimal(38,2)").alias("balance"), F.lit("USD").alias("declared_currency"))
    kinds = {"as_of_date": "date", "outstanding_balance": "currency", "days_past_due": "integer"}
    rules = q.Profile(keys=[*KEY, "as_of_date"], decimals=["outstanding_balance"], not_negative=["outstanding_balance"], dates=["as_of_date"], as_of=PERIODS[-1], mode="history")
    tree = {"type": "change", "op": "lt", "bound": 0, "lookback": 1}
    series = lambda t: t.groupBy(F.col("facility_id").alias("series"), "as_of_date").agg(F.sum("outstanding_balance").alias("value")).withColumn("point_id", F.col("as_of_date").cast("string"))
    stages = [
        staged.Stage("profile", lambda t: q.profile(given, ["outstanding_balance", "industry_code", "days_past_due"])),
        staged.Stage("map", lambda t: mapping.apply_approved(given, {c: (c, kinds.get(c, "string")) for c in names})),
        staged.Stage("dq", lambda t: q.run_quality(given, rules)),
        staged.Stage("reconcile", lambda t: q.reconcile(t["map"], declared, ["as_of_date"])),
        staged.Stage("certify", lambda t: q.certify(t["dq"], t["reconcile"]), "status = 'certified'"),
        staged.Stage("analyze", lambda t: stratify(t["map"], F.col("industry_code"))),
        staged.Stage("monitor", lambda t: m.evaluate_v2(series(t["map"]).select("series").distinct(), series(t["map"]), tree, ["series"], F.lit(PERIODS[-1]).cast("date"), 10)),
        staged.Stage("report", lambda t: t["analyze"].agg(F.sum("loans").alias("loans"), F.sum("balance").alias("balance")).crossJoin(t["monitor"].agg(F.count_if(F.col("outcome") == "triggered").alias("alerts")))),
    ]
    return staged.run_stages(spark, _path(spark), stages)


@query(
    with_tape("""
    , u AS (SELECT *, CAST(loan_id AS BIGINT) % 201 = 0 AS hit FROM tape WHERE currency = 'USD'), bad AS (SELECT COUNT(*) AS n FROM u WHERE hit),
    k AS (SELECT 'profile' AS stage, CAST(3 AS BIGINT) AS rows UNION ALL SELECT 'map', COUNT(*) FROM u UNION ALL SELECT 'dq', 0 UNION ALL SELECT 'reconcile', COUNT(DISTINCT as_of_date) FROM u UNION ALL SELECT 'certify', 1
        UNION ALL SELECT 'analyze', COUNT(*) FROM (SELECT DISTINCT as_of_date, industry_code FROM u) UNION ALL SELECT 'monitor', COUNT(DISTINCT facility_id) FROM u UNION ALL SELECT 'report', 1)
    SELECT 'clean' AS run, stage, 'done' AS status, rows FROM k
    UNION ALL SELECT 'broken', stage, CASE WHEN n = 0 THEN 'done' WHEN stage = 'certify' THEN 'blocked' WHEN stage IN ('analyze', 'monitor', 'report') THEN 'skipped' ELSE 'done' END, CASE WHEN n > 0 AND stage = 'dq' THEN 1 WHEN n > 0 AND stage IN ('analyze', 'monitor', 'report') THEN NULL ELSE rows END FROM k, bad""")
)
def m10_staged_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs through all stages: a clean delivery, and one that certification stops."""
    # The dollar loans of the tape as text, written once: four stages of each run read what was delivered.
    delivered = written(tape(spark, sf_dir).where("currency = 'USD'").select(*[F.col(c).cast("string").alias(c) for c in _DELIVERED]), "delivered")
    return _run(spark, delivered, False).select(F.lit("clean").alias("run"), "*").union(_run(spark, delivered, True).select(F.lit("broken").alias("run"), "*"))
