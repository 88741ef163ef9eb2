"""Threshold monitors over series of points, alerts and cases, in batch. Every window is keyed by series."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import dedupe_key

OPS = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def threshold(op: Column, value: Column, bound: Column) -> Column:
    """The comparison that ``op`` names; null where the value is."""
    out = None
    for name, f in OPS.items():
        out = F.when(op == name, f(value, bound)) if out is None else out.when(op == name, f(value, bound))
    return out


def evaluate_v1(monitors: DataFrame, observations: DataFrame, gate: str = "publish") -> DataFrame:
    """Each monitor against the observation of its metric and snapshot: alert, clear, missing_observation, unit_mismatch,
    future_observation or, if the quality gate is not open, gate_<state>.

    monitors: monitor_id, metric_id, snapshot_id, as_of_date, type (decimal or boolean), op, bound (decimal), bound_flag, unit.
    observations: metric_id, snapshot_id, as_of_date, type, value, flag, unit.
    """
    seen = observations.select("metric_id", "snapshot_id", F.col("as_of_date").alias("seen_on"), F.col("type").alias("seen_type"), "value", "flag", F.col("unit").alias("seen_unit"))
    joined = monitors.join(seen, ["metric_id", "snapshot_id"], "left")
    hit = F.when(F.col("type") == "boolean", threshold(F.col("op"), F.col("flag"), F.col("bound_flag"))).otherwise(threshold(F.col("op"), F.col("value"), F.col("bound")))
    outcome = F.when(F.lit(gate != "publish"), F.lit(f"gate_{gate}")).when(F.col("seen_type").isNull(), "missing_observation").when(F.col("seen_on") > F.col("as_of_date"), "future_observation")
    outcome = outcome.when((F.col("unit") != F.col("seen_unit")) | (F.col("type") != F.col("seen_type")), "unit_mismatch").when(hit, "alert").otherwise("clear")
    return joined.select("monitor_id", "metric_id", "snapshot_id", "value", outcome.alias("outcome"), dedupe_key("monitor_id", "snapshot_id").alias("dedupe_key"))


def change(value: Column, series: list[str], order: list[str], periods: int, percent: bool) -> Column:
    """Against the value ``periods`` points back; as a share of its size, unknown if that is zero."""
    was = F.lag(value, periods).over(Window.partitionBy(*series).orderBy(*order))
    return F.when(was != 0, (value - was) / F.abs(was)) if percent else value - was


def rolling(value: Column, series: list[str], order: list[str], periods: int, how: str, least: int) -> Column:
    """avg, min or max of the last ``periods`` points; unknown under ``least`` points or with an unknown one among them."""
    w = Window.partitionBy(*series).orderBy(*order).rowsBetween(-(periods - 1), 0)
    full = (F.count(value).over(w) == F.count(F.lit(1)).over(w)) & (F.count(F.lit(1)).over(w) >= least)
    return F.when(full, {"avg": F.avg, "min": F.min, "max": F.max}[how](value).over(w))


def consecutive(hit: Column, series: list[str], order: list[str], periods: int) -> Column:
    """All of the last ``periods`` points hit, and there are so many."""
    w = Window.partitionBy(*series).orderBy(*order).rowsBetween(-(periods - 1), 0)
    return (F.count(F.lit(1)).over(w) == periods) & F.coalesce(F.min(F.coalesce(hit, F.lit(False))).over(w), F.lit(False))


class Condition(NamedTuple):
    """known: there is enough history; hit: it holds; calm: an open case may close (the reset value is no longer reached)."""

    known: Column
    hit: Column
    calm: Column


def scalar(tree: dict, series: list[str], order: list[str], value: str = "value") -> Condition:
    """absolute, change (percent in points of a hundred) or rolling at every point of a series. ``reset`` is a second bound: the case stays open while the
    comparison still holds against it; without one it may close as soon as the condition doesn't hold."""
    kind, v = tree["type"], F.col(value)
    if kind == "change":
        percent = tree.get("mode") == "percent"
        seen = change(v, series, order, tree.get("lookback", 1), percent) * (100 if percent else 1)
    elif kind == "rolling":
        seen = rolling(v, series, order, tree["window"], tree["aggregation"], tree.get("minimum", tree["window"]))
    elif kind == "absolute":
        seen = v
    else:
        raise ValueError(f"unknown condition {kind}")
    known = v.isNotNull() & seen.isNotNull()
    hit = F.coalesce(known & OPS[tree["op"]](seen, F.lit(tree["bound"])), F.lit(False))
    calm = ~hit if tree.get("reset") is None else ~F.coalesce(known & OPS[tree["op"]](seen, F.lit(tree["reset"])), F.lit(False))
    return Condition(known, hit, calm)


def condition(tree: dict, series: list[str], order: list[str], value: str = "value") -> Condition:
    """A scalar condition, or ``consecutive`` of one, or ``all`` or ``any`` of several. A compound is only known if each of
    its parts is; ``consecutive`` if all of its points are and there are enough of them."""
    kind = tree["type"]
    if kind in ("all", "any"):
        parts = [scalar(c, series, order, value) for c in tree["conditions"]]
        join = (lambda a, b: a & b) if kind == "all" else (lambda a, b: a | b)
        return Condition(reduce(lambda a, b: a & b, [p.known for p in parts]), reduce(join, [p.hit for p in parts]), reduce(join, [p.calm for p in parts]))
    if kind == "consecutive":
        one = scalar(tree["condition"], series, order, value)
        return Condition(consecutive(one.known, series, order, tree["periods"]), consecutive(one.hit, series, order, tree["periods"]), one.calm)
    return scalar(tree, series, order, value)


def evaluate_v2(scopes: DataFrame, points: DataFrame, tree: dict, series: list[str], as_of: Column, stale_days: int, missing: str = "alert", cooldown_days: int = 0, effective: tuple[str, str | None] | None = None) -> DataFrame:
    """One row for each scope: outcome (triggered, cooldown, reset, clear, missing, blocked) and reason at ``as_of``.

    scopes: the columns of ``series`` and, if cases are carried on, case_open and last_triggered. points: the series,
    as_of_date, point_id and value; later ones than ``as_of`` don't count. No point, a latest point older than ``stale_days`` and
    too little history follow ``missing`` (alert gives missing, block blocked, clear clear). A condition that holds again less than
    ``cooldown_days`` after the last trigger is a cooldown. An open case resets only where the reset value is no longer reached.
    effective: first and last day of the definition; on other days every scope is refused.
    """
    order = ["as_of_date", "point_id"]
    found = condition(tree, series, order)
    flagged = points.where(F.col("as_of_date") <= as_of).select(*series, *order, "value", found.known.alias("known"), found.hit.alias("hit"), found.calm.alias("calm"))
    last = flagged.withColumn("__rn", F.row_number().over(Window.partitionBy(*series).orderBy(F.col("as_of_date").desc(), F.col("point_id").desc()))).where("__rn = 1").drop("__rn")
    kept = [c for c in ("case_open", "last_triggered") if c in scopes.columns]
    all_scopes = scopes.select(*series, *kept)
    for name, kind in (("case_open", "boolean"), ("last_triggered", "date")):
        if name not in kept:
            all_scopes = all_scopes.withColumn(name, F.lit(None).cast(kind))
    reason = F.when(F.col("point_id").isNull(), "missing_observation").when(F.datediff(as_of, "as_of_date") > stale_days, "stale_observation").when(~F.col("known"), "insufficient_history")
    reason = reason.when(F.col("hit") & F.coalesce(F.datediff(as_of, "last_triggered") < cooldown_days, F.lit(False)), "cooldown_active").when(F.col("hit"), "condition_triggered")
    reason = reason.when(F.coalesce("case_open", F.lit(False)) & ~F.col("calm"), "hysteresis_not_reset").otherwise("condition_clear")
    if effective:
        on = (as_of >= F.lit(effective[0]).cast("date")) & (as_of <= F.coalesce(F.lit(effective[1]).cast("date"), as_of))
        reason = F.when(~on, "not_effective").otherwise(reason)
    absent = F.lit({"alert": "missing", "block": "blocked", "clear": "clear"}[missing])
    outcome = F.when(F.col("reason") == "not_effective", "refused").when(F.col("reason").isin("missing_observation", "stale_observation", "insufficient_history"), absent).when(F.col("reason") == "cooldown_active", "cooldown")
    outcome = outcome.when(F.col("reason") == "condition_triggered", "triggered").when((F.col("reason") == "condition_clear") & F.coalesce("case_open", F.lit(False)), "reset").otherwise("clear")
    return all_scopes.join(last, series, "left").withColumn("reason", reason).select(*series, "as_of_date", "point_id", "value", outcome.alias("outcome"), "reason")


def fold_cases(points: DataFrame, series: list[str], bound: float, reset: float, cooldown_days: int) -> DataFrame:
    """What a monitor (at or over ``bound``, reset value ``reset``) says of a series at each of its points, with the state
    carried on: triggered, cooldown, reset, open (not triggered, but the reset value is still reached), clear or missing.

    An ordered fold per series (``CaseState``): Spark brings the points of a series together, a series is one group.
    """
    import pyarrow as pa

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("as_of_date", "ascending"), ("point_id", "ascending")])
        state = CaseState(bound, reset, cooldown_days)
        return table.append_column("transition", pa.array([state.step(d, v) for d, v in zip(table.column("as_of_date").to_pylist(), table.column("value").to_pylist(), strict=True)], pa.string()))

    rows = points.select(*series, "as_of_date", "point_id", F.col("value").cast("double").alias("value"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", transition string"
    return rows.groupBy(*series).applyInArrow(fold, schema)


class CaseState:
    """The state of one case that batch folds and streams share: open or not, day of the last trigger and of the last reset.

    The cooldown counts from the last trigger, whether the case is still open or not. A missing value changes nothing.
    """

    def __init__(self, bound: float, reset: float, cooldown_days: int, is_open: bool = False, triggered: object = None, cleared: object = None):
        self.bound, self.reset, self.cooldown_days, self.is_open, self.triggered, self.cleared = bound, reset, cooldown_days, is_open, triggered, cleared

    def step(self, day, value: float | None) -> str:
        if value is None:
            return "missing"
        if value >= self.bound:
            if self.triggered is not None and (day - self.triggered).days < self.cooldown_days:
                return "cooldown"
            self.is_open, self.triggered = True, day
            return "triggered"
        if self.is_open and value >= self.reset:
            return "open"
        if self.is_open:
            self.is_open, self.cleared = False, day
            return "reset"
        return "clear"


def alert_cases(occurrences: DataFrame) -> DataFrame:
    """Occurrences (occurrence_key, dedupe_key, seen_at) to one case per dedupe key; a repeated occurrence changes nothing."""
    return occurrences.groupBy("dedupe_key", "occurrence_key").agg(F.min("seen_at").alias("seen_at")).groupBy("dedupe_key").agg(F.count("*").alias("recurrences"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))


#: Statuses from which a manual move to each status is allowed.
ALLOWED = {"acknowledged": ["open"], "escalated": ["open", "acknowledged"], "resolved": ["open", "acknowledged", "escalated"], "suppressed": ["open", "acknowledged", "escalated"], "open": ["resolved", "suppressed"]}


def case_status(log: DataFrame, case: str = "case_id") -> DataFrame:
    """Events (case, seq, status, kind manual or occurrence) folded in order of seq: status, invalid moves, reopenings, events.

    A case begins, open, with its first occurrence. A later occurrence reopens a resolved case and changes no other status. A
    manual move that the present status doesn't allow is counted as invalid and changes nothing, so each move is judged against the
    last valid status. The events of a case are one array.
    """
    now = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).cast("long").alias("invalid"), F.lit(0).cast("long").alias("reopened"))

    def step(state: Column, event: Column) -> Column:
        auto = event["kind"] == "occurrence"
        manual = reduce(lambda out, x: out | x, [(event["status"] == to) & state["status"].isin(*whence) for to, whence in ALLOWED.items()])
        valid = auto | F.coalesce(manual, F.lit(False))
        again = auto & (state["status"] == "resolved")
        status = F.when(auto, F.when(state["status"].isNull() | again, F.lit("open")).otherwise(state["status"])).when(valid, event["status"]).otherwise(state["status"])
        return F.struct(status.alias("status"), (state["invalid"] + (~valid).cast("long")).alias("invalid"), (state["reopened"] + F.coalesce(again, F.lit(False)).cast("long")).alias("reopened"))

    events = log.groupBy(case).agg(F.sort_array(F.collect_list(F.struct("seq", "kind", "status"))).alias("events"))
    folded = events.select(case, F.aggregate("events", now, step).alias("s"), F.size("events").cast("long").alias("events"))
    return folded.select(case, "s.status", "s.invalid", "s.reopened", "events")


def deliveries(manifests: DataFrame, clock: Column, sla_minutes: int) -> DataFrame:
    """Per source: the deliveries that count (one of each fingerprint), late ones and the high watermark."""
    once = manifests.groupBy("source", "fingerprint").agg(F.min("observed_at").alias("observed_at"), F.max("watermark_end").alias("watermark_end"))
    late = (F.unix_timestamp(clock) - F.unix_timestamp("observed_at")) > sla_minutes * 60
    return once.groupBy("source").agg(F.count("*").alias("deliveries"), F.sum(late.cast("long")).alias("late"), F.max("watermark_end").alias("high_watermark"))


def quarantine_late(rows: DataFrame, cutoff: Column, date: str = "as_of_date") -> tuple[DataFrame, DataFrame]:
    """(on time, late): rows dated after the cutoff block certification and are kept apart."""
    return rows.where(F.col(date) <= cutoff), rows.where(F.col(date) > cutoff)
