"""Monitors of any condition over streams: a bounded history per series, timers for days that end and for silence.

A day of a series is judged once the watermark has passed it, so the order in which points arrive within the delay doesn't matter.
A series has a timer for its first open day only, which judges all days that are over by then: each call of state or timers is a round
trip to the JVM.
State is the last points that the condition can look back to, the points of days that are still open, and the case; a series that
was silent long enough is reported stale once, and forgotten after ``forget_days``.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY_MS = 86_400_000
#: transformWithState needs this provider.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_OPS = {"eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}


def history(tree: dict) -> int:
    """Points, the last included, that a condition looks at."""
    kind = tree["type"]
    if kind in ("all", "any"):
        return max(history(c) for c in tree["conditions"])
    if kind == "consecutive":
        return tree["periods"] - 1 + history(tree["condition"])
    return {"absolute": 1, "change": tree.get("lookback", 1) + 1, "rolling": tree.get("window", 1)}[kind]


def judge(tree: dict, values: list[float | None]) -> tuple[bool, bool, bool]:
    """(known, hit, calm) at the last of the values, as ``operators.monitor.condition`` has them."""
    kind = tree["type"]
    if kind in ("all", "any"):
        parts = [judge(c, values) for c in tree["conditions"]]
        join = all if kind == "all" else any
        return all(k for k, _, _ in parts), join(h for _, h, _ in parts), join(c for _, _, c in parts)
    if kind == "consecutive":
        n = tree["periods"]
        each = [judge(tree["condition"], values[: i + 1]) for i in range(max(0, len(values) - n), len(values))]
        full = len(each) == n
        return full and all(k for k, _, _ in each), full and all(h for _, h, _ in each), each[-1][2]
    now, seen = values[-1], None
    if kind == "absolute":
        seen = now
    elif kind == "change":
        back = tree.get("lookback", 1)
        was = values[-1 - back] if len(values) > back else None
        if now is not None and was is not None:
            seen = (None if was == 0 else (now - was) / abs(was) * 100) if tree.get("mode") == "percent" else now - was
    elif kind == "rolling":
        last = values[-tree["window"] :]
        if None not in last and len(last) >= tree.get("minimum", tree["window"]):
            seen = {"avg": lambda x: sum(x) / len(x), "min": min, "max": max}[tree["aggregation"]](last)
    else:
        raise ValueError(f"unknown condition {kind}")
    known = now is not None and seen is not None
    hit = known and _OPS[tree["op"]](seen, tree["bound"])
    return known, hit, not hit if tree.get("reset") is None else not (known and _OPS[tree["op"]](seen, tree["reset"]))


class Monitor(StatefulProcessor):
    """Rows of a series in, one row a judged day out."""

    def __init__(self, series: list[str], tree: dict, stale_days: int, missing: str, cooldown_days: int, forget_days: int):
        self.series, self.tree, self.stale_days, self.cooldown_days, self.forget_days = series, tree, stale_days, cooldown_days, forget_days
        self.absent, self.need = {"alert": "missing", "block": "blocked", "clear": "clear"}[missing], history(tree)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.case = handle.getValueState("case", "held string")

    def close(self) -> None:
        pass

    def _held(self) -> dict:
        return json.loads(self.case.get()[0]) if self.case.exists() else {"past": [], "open_days": {}, "is_open": False, "triggered": None, "last": None, "since": None, "told": False, "timer": None}

    def _timer(self, held: dict, day: int) -> None:
        """Wake on that day, unless an earlier timer stands; that one sets the next."""
        if held.get("timer") is None or day < held["timer"]:
            held["timer"] = day
            self.handle.registerTimer(day * DAY_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, wake = self._held(), []
        for batch in rows:
            days = batch["as_of"].to_numpy().astype("datetime64[D]").astype("int64").tolist()
            for day, point, value in zip(days, batch["point_id"].tolist(), batch["value"].tolist(), strict=True):
                if pd.isna(point):  # a scope that is to be watched
                    if held["last"] is None and held["since"] is None:
                        held["since"] = day
                        wake.append(day + self.stale_days + 2)
                elif held["last"] is None or day > held["last"]:
                    held["open_days"].setdefault(str(day), []).append([str(point), None if pd.isna(value) else float(value)])
                    wake.append(day + 1)
        if wake:
            self._timer(held, min(wake))
        self.case.update((json.dumps(held),))
        yield from ()

    def _row(self, key: tuple, day: int, point: str | None, value: float | None, outcome: str, reason: str) -> dict:
        return dict(zip(self.series, key, strict=True)) | {"as_of": datetime.date(1970, 1, 1) + datetime.timedelta(days=day), "point_id": point, "value": value, "outcome": outcome, "reason": reason}

    def _quiet(self, key: tuple, held: dict, until: int) -> list[dict]:
        """The first day of silence, if it is before ``until`` and has not been told."""
        last = held["last"] if held["last"] is not None else held["since"]
        day = last + self.stale_days + 1
        if held["told"] or day >= until:
            return []
        held["told"] = True
        if held["last"] is None:
            return [self._row(key, day, None, None, self.absent, "missing_observation")]
        return [self._row(key, day, *held["past"][-1], self.absent, "stale_observation")]

    def _judged(self, key: tuple, held: dict, day: int) -> dict:
        # Points of one day are in order of their id; the last one stands for the day.
        points = sorted(held["open_days"].pop(str(day)))
        held["past"] += points
        known, hit, calm = judge(self.tree, [v for _, v in held["past"]])
        held["past"], held["last"], held["told"] = held["past"][-self.need :], day, False
        if not known:
            outcome, reason = self.absent, "insufficient_history"
        elif hit and held["triggered"] is not None and day - held["triggered"] < self.cooldown_days:
            outcome, reason = "cooldown", "cooldown_active"
        elif hit:
            outcome, reason, held["is_open"], held["triggered"] = "triggered", "condition_triggered", True, day
        elif held["is_open"] and not calm:
            outcome, reason = "clear", "hysteresis_not_reset"
        else:
            outcome, reason, held["is_open"] = "reset" if held["is_open"] else "clear", "condition_clear", False
        return self._row(key, day, *points[-1], outcome, reason)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.case.exists():
            return
        # Days before this one are over.
        held, now, out = self._held(), timerValues.getCurrentWatermarkInMs() // DAY_MS, []
        if held.get("timer") is not None and held["timer"] <= expiredTimerInfo.getExpiryTimeInMs() // DAY_MS:
            held["timer"] = None
        for day in sorted(int(d) for d in held["open_days"] if int(d) < now):
            if held["last"] is not None or held["since"] is not None:
                out += self._quiet(key, held, day)
            out.append(self._judged(key, held, day))
        if not held["open_days"] and (held["last"] is not None or held["since"] is not None):
            out += self._quiet(key, held, now)
            silent = (held["last"] if held["last"] is not None else held["since"]) + self.stale_days + 1
            if now > silent + self.forget_days:
                self.case.clear()
            else:
                self._timer(held, silent + 1 if not held["told"] else silent + self.forget_days + 1)
                self.case.update((json.dumps(held),))
        else:
            if held["open_days"]:
                self._timer(held, min(int(d) for d in held["open_days"]) + 1)
            self.case.update((json.dumps(held),))
        if out:
            yield pd.DataFrame(out)


def monitor_stream(stream: DataFrame, tree: dict, series: list[str], stale_days: int, missing: str = "alert", cooldown_days: int = 0, delay_days: int = 0, forget_days: int = 365) -> DataFrame:
    """What ``operators.monitor.evaluate_v2`` says of each series on each of its days, and on the first day that it is stale or, for a
    scope that never had a point, missing; cases are carried on. stream: the series, as_of_date, point_id (text; null announces
    a scope) and value. Points more than ``delay_days`` behind the newest are late and dropped. The session must use PROVIDER."""
    kinds = dict(stream.dtypes)
    rows = stream.select(*series, F.col("as_of_date").cast("timestamp").alias("as_of"), F.col("point_id").cast("string").alias("point_id"), F.col("value").cast("double").alias("value"))
    out = ", ".join(f"{c} {kinds[c]}" for c in series) + ", as_of date, point_id string, value double, outcome string, reason string"
    watched = rows.withWatermark("as_of", f"{delay_days} days").groupBy(*series)
    return watched.transformWithStateInPandas(Monitor(series, tree, stale_days, missing, cooldown_days, forget_days), out, "append", "eventTime")
