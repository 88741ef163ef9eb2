"""Closed filter trees compiled to Columns, and the row selections that go with dates, versions and watermarks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import DECIMAL_TEXT, blank_to_null

ORDERED: dict[str, Callable[[Column, Column], Column]] = {"gt": lambda a, b: a > b, "gte": lambda a, b: a >= b, "lt": lambda a, b: a < b, "lte": lambda a, b: a <= b}
MAX_DEPTH, MAX_NODES = 4, 50


def check_filter(tree: dict, depth: int = 1) -> int:
    """Nodes of the tree; too deep, too many or unknown ones are errors."""
    op = tree.get("op")
    if depth > MAX_DEPTH:
        raise ValueError("filter is too deep")
    if op in ("and", "or"):
        if not tree.get("args"):
            raise ValueError(f"{op} needs arguments")
        n = 1 + sum(check_filter(a, depth + 1) for a in tree["args"])
    elif op in (*ORDERED, "eq", "neq", "in", "is_null") and "field" in tree:
        n = 1
    else:
        raise ValueError(f"unknown filter {op}")
    if n > MAX_NODES:
        raise ValueError("filter has too many nodes")
    return n


def _number(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.rlike(DECIMAL_TEXT), text.try_cast("decimal(38,10)"))


def population_filter(tree: dict) -> Column:
    """Two-valued: a comparison that can't be made is false; ``neq`` holds for absent values; order is for numbers only."""
    check_filter(tree)

    def build(t: dict) -> Column:
        op = t["op"]
        if op in ("and", "or"):
            return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), [build(a) for a in t["args"]])
        c = F.col(t["field"])
        text = blank_to_null(c)
        if op == "is_null":
            return text.isNull()
        if op == "eq":
            return F.coalesce(text == F.lit(str(t["value"])), F.lit(False))
        if op == "neq":
            return F.coalesce(text != F.lit(str(t["value"])), F.lit(True))
        if op == "in":
            return F.coalesce(text.isin([str(v) for v in t["values"]]), F.lit(False))
        return F.coalesce(ORDERED[op](_number(c), F.lit(str(t["value"])).cast("decimal(38,10)")), F.lit(False))

    return build(tree)


def investigation_filter(tree: dict) -> Column:
    """As numbers if both sides are, else as text; an absent value comes before every other."""

    def build(t: dict) -> Column:
        op = t["op"]
        if op in ("and", "or"):
            return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), [build(a) for a in t["args"]])
        c = F.col(t["field"]).cast("string")
        if op == "is_null":
            return c.isNull()
        if op == "in":
            return F.coalesce(c.isin([str(v) for v in t["values"]]), F.lit(False))
        v = F.lit(str(t["value"]))
        number, bound = _number(c), _number(v)
        sign = F.when(c.isNull(), -1)
        sign = sign.when(number.isNotNull() & bound.isNotNull(), F.when(number < bound, -1).when(number > bound, 1).otherwise(0))
        sign = sign.otherwise(F.when(c < v, -1).when(c > v, 1).otherwise(0))
        return {"eq": sign == 0, "ne": sign != 0, "gt": sign > 0, "gte": sign >= 0, "lt": sign < 0, "lte": sign <= 0}[op]

    return build(tree)


def eligibility_condition(tree: dict, depth: int = 1) -> Column:
    """Receivables: days_past_due at least n, a flag is set, debtor in a list; all, any, not."""
    if depth > 10:
        raise ValueError("condition is too deep")
    op = tree["op"]
    if op in ("all", "any"):
        return reduce((lambda a, b: a & b) if op == "all" else (lambda a, b: a | b), [eligibility_condition(a, depth + 1) for a in tree["args"]])
    if op == "not":
        return ~eligibility_condition(tree["arg"], depth + 1)
    if op == "days_past_due_at_least":
        return F.coalesce(F.col("days_past_due") >= tree["days"], F.lit(False))
    if op == "has_flag":
        return F.coalesce(F.array_contains("flags", tree["flag"]), F.lit(False))
    if op == "debtor_in":
        return F.coalesce(F.col("debtor_id").isin(tree["debtors"]), F.lit(False))
    raise ValueError(f"unknown condition {op}")


def effective(as_of: Column, start: Column | str, end: Column | str, inclusive_end: bool) -> Column:
    """Active on the date; an absent end is open. Policies of receivables end before ``end``, those of collateral on it."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return (start <= as_of) & (end.isNull() | ((as_of <= end) if inclusive_end else (as_of < end)))


def conflicting_versions(rules: DataFrame, rule_id: str = "rule_id") -> DataFrame:
    """Must be empty: rules of which more than one version is active."""
    return rules.groupBy(rule_id).count().where("count > 1")


def as_of_rows(df: DataFrame, mode: str, date: Column, column: str = "as_of_date") -> DataFrame:
    """snapshot: exactly that date; history and vintage: up to it. Prunes partitions on the date."""
    c = F.col(column)
    return df.where(c == date if mode == "snapshot" else c <= date)


def latest_periods(df: DataFrame, n: int, by: list[str] | None = None, date: str = "as_of_date") -> DataFrame:
    """Rows of the last ``n`` distinct dates (of each group of ``by``). Only the distinct dates are ranked."""
    keys = [*(by or []), date]
    dates = df.select(*keys).distinct()
    window = Window.partitionBy(*(by or [F.lit(1)])).orderBy(F.col(date).desc())
    last = dates.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n).drop("__rank")
    return df.join(last, keys, "left_semi")


def watermark(df: DataFrame, column: str, upper: str, kind: str, lower: str | None = None) -> DataFrame:
    """Rows in (lower, upper], typed: date, datetime, decimal, integer or text."""
    types = {"date": "date", "datetime": "timestamp", "decimal": "decimal(38,10)", "integer": "long", "text": "string"}
    if kind not in types:
        raise ValueError(f"unknown watermark kind {kind}")
    c, up = F.col(column).cast(types[kind]), F.lit(upper).cast(types[kind])
    return df.where((c <= up) if lower is None else (c <= up) & (c > F.lit(lower).cast(types[kind])))


def without_disabled(df: DataFrame, disabled: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(disabled.select(*keys).distinct(), keys, "left_anti")
