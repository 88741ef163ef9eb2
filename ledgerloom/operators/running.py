"""Running sums and maxima over keys of any size: no task holds a key.

Rows are dealt by ranges of (keys, order); each range is summed by key, the few sums of a key give each of its ranges what comes
before it, and that enters the range as its first row. A key that holds a third of all rows is as many ranges as that takes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import settled

_PART, _FIRST = "__range", "__first"


def running(df: DataFrame, keys: list[str], order: list[tuple[str, bool]], values: dict[str, tuple[str, Column]], what: str = "running") -> DataFrame:
    """Adds, per name, the running ``sum`` or ``max`` of a column over the rows of the same keys up to the row, in the order given
    (name, ascending). Null keys are a key; nulls add nothing. Rows that tie in the order are placed as Spark finds them, so the
    order should be total. Rows are written once to the shared folder, as ranges must not change between the steps."""
    kind = lambda how, c: F.sum(c) if how == "sum" else F.max(c)
    by = [F.col(k).asc() if up else F.col(k).desc() for k, up in order]
    mine = {f"__v_{n}": c for n, (_, c) in values.items()}
    dealt = df.withColumns(mine).repartitionByRange(*[F.col(k) for k in keys], *by).withColumn(_PART, F.spark_partition_id())
    dealt = settled(dealt, what)
    totals = dealt.groupBy(*keys, _PART).agg(*[kind(how, f"__v_{n}").alias(f"__v_{n}") for n, (how, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, _PART, *[kind(how, f"__v_{n}").over(before).alias(f"__v_{n}") for n, (how, _) in values.items()], F.lit(0).alias(_FIRST))
    # Sums are wider than what they add; both get the wider type, so that a union loses no digit.
    wide = {f.name: f.dataType for f in carried.schema.fields}
    rows = dealt.withColumns({c: F.col(c).cast(wide[c]) for c in mine}).withColumn(_FIRST, F.lit(1)).unionByName(carried, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, _PART).orderBy(_FIRST, *by).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({n: kind(how, f"__v_{n}").over(upto) for n, (how, _) in values.items()}).where(f"{_FIRST} = 1").select(*df.columns, *values)


def after_key(keys: list[tuple[str, bool]], last: dict) -> Column:
    """Rows that come after a row with these key values (not null) in the order given: the next page of a stable order."""
    out = F.lit(False)
    same = F.lit(True)
    for k, up in keys:
        out = out | (same & ((F.col(k) > F.lit(last[k])) if up else (F.col(k) < F.lit(last[k]))))
        same = same & (F.col(k) == F.lit(last[k]))
    return out


def same_keys(a: str, b: str, keys: list[str]) -> Column:
    """Null-safe equality of the keys of two aliased tables."""
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])
