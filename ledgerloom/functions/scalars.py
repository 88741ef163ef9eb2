"""Scalar building blocks as Column expressions. No Python runs per row."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted texts of canonical types.
DECIMAL_TEXT = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
INTEGER_TEXT = r"^-?(0|[1-9][0-9]*)$"
DATE_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DATETIME_TEXT = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
UNKNOWN = "Unknown/Unmapped"
OTHER = "Other/Out of range"

AMOUNT = "decimal(20,2)"
WIDE = "decimal(38,2)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    """Null, empty and white space all mean absent."""
    text = F.trim(col(c).cast("string"))
    return F.when(text != "", text)


def ratio(num: Column | str, den: Column | str) -> Column:
    """Null where the denominator is null or zero."""
    return F.when(col(den) != 0, col(num).cast("double") / col(den).cast("double"))


@dataclass(frozen=True)
class Bin:
    """[lower, upper) by default; a missing bound is open."""

    label: str
    lower: Decimal | int | None = None
    upper: Decimal | int | None = None
    lower_inclusive: bool = True
    upper_inclusive: bool = False


def check_bins(bins: list[Bin]) -> None:
    """Bins must be in order, not empty and not overlap, with labels of their own."""
    if len({b.label for b in bins} | {UNKNOWN, OTHER}) < len(bins) + 2:
        raise ValueError("bin labels must be unique and not reserved")
    for b in bins:
        if b.lower is not None and b.upper is not None and (b.lower > b.upper or b.lower == b.upper and not (b.lower_inclusive and b.upper_inclusive)):
            raise ValueError(f"bin {b.label} is empty")
    for a, b in zip(bins, bins[1:], strict=False):
        if a.upper is None or b.lower is None or a.upper > b.lower or a.upper == b.lower and a.upper_inclusive and b.lower_inclusive:
            raise ValueError(f"bins {a.label} and {b.label} overlap or are out of order")


def numeric_bin(value: Column | str, bins: list[Bin], unknown: str = UNKNOWN, other: str = OTHER) -> Column:
    """Label of the bin that holds the number; null gives ``unknown``, a number in no bin ``other``."""
    check_bins(bins)
    v = col(value)
    out = F.when(v.isNull(), F.lit(unknown))
    for b in bins:
        inside = F.lit(True)
        if b.lower is not None:
            inside &= (v >= F.lit(b.lower)) if b.lower_inclusive else (v > F.lit(b.lower))
        if b.upper is not None:
            inside &= (v <= F.lit(b.upper)) if b.upper_inclusive else (v < F.lit(b.upper))
        out = out.when(inside, F.lit(b.label))
    return out.otherwise(F.lit(other))


def bin_order(label: Column | str, bins: list[Bin], unknown: str = UNKNOWN, other: str = OTHER) -> Column:
    """Declared order, then unknown, then other."""
    out = F.when(col(label) == other, len(bins) + 1).when(col(label) == unknown, len(bins))
    for i, b in enumerate(bins):
        out = out.when(col(label) == b.label, i)
    return out.otherwise(len(bins) + 2)


def category(value: Column | str) -> Column:
    """Trimmed text; absent values are one bucket."""
    return F.coalesce(blank_to_null(value), F.lit(UNKNOWN))


def cohort(date: Column | str, grain: str) -> Column:
    """First day of the month, quarter or year."""
    if grain not in ("month", "quarter", "year"):
        raise ValueError(f"unknown grain {grain}")
    return F.trunc(col(date), grain)


def months_between_calendar(start: Column | str, end: Column | str) -> Column:
    """Difference of calendar months; the day of the month does not count."""
    return (F.year(col(end)) * 12 + F.month(col(end))) - (F.year(col(start)) * 12 + F.month(col(start)))


def months_until(as_of: Column | str, maturity: Column | str) -> Column:
    """Calendar months, one more if the maturity day is past the as-of day."""
    later = F.when(F.dayofmonth(col(maturity)) > F.dayofmonth(col(as_of)), 1).otherwise(0)
    return months_between_calendar(as_of, maturity) + later


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(col(end), col(start))


def with_null_policy(value: Column | str, policy: str) -> Column:
    """``zero`` fills amounts; ``exclude`` and ``unavailable`` keep nulls (the caller drops rows or marks the cell)."""
    if policy not in ("exclude", "zero", "unavailable"):
        raise ValueError(f"unknown null policy {policy}")
    return F.coalesce(col(value), F.lit(0)) if policy == "zero" else col(value)


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces: equal definitions give equal text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)


def definition_hash(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def row_token(*parts: Column | str) -> Column:
    """SHA-256 of the JSON array of the parts; absent parts are empty text."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts])), 256)


def digest_sums(digest: Column) -> list[Column]:
    """Sums of the four 64-bit parts of SHA-256 digests (hex): an order-free aggregate over all 256 bits; nulls don't count."""
    part = lambda i: F.conv(F.substring(digest, 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")
    return [F.coalesce(F.sum(part(i)), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(4)]


def population_hash(token: Column) -> Column:
    """Order-free hash of row tokens (SHA-256 in hex): their count and digest sums. Combines before the shuffle, holds no set."""
    return F.sha2(F.concat_ws(":", F.count(token), *digest_sums(token)), 256)


def entity_token(tenant: str, field: str, value: Column, resolved: Column) -> Column:
    """``Entity-`` or ``Unresolved-`` and 16 hex digits of a tenant-salted hash."""
    mark = F.substring(F.sha2(F.to_json(F.array(F.lit(tenant), F.lit(field), value.cast("string"))), 256), 1, 16)
    return F.concat(F.when(resolved, F.lit("Entity-")).otherwise(F.lit("Unresolved-")), mark)


#: Parts of field names that tell the unit and the kind of time; the first that fits counts.
UNIT_WORDS = {"currency": "balance|amount|price|value|cost|reserve|commitment", "percentage": "rate|percent|pct|ltv", "days": "days|dpd|age", "date": "date|_at$", "identifier": "^id$|_id$|number$|_no$"}
TEMPORAL_WORDS = {"lifetime_to_date": "cumulative|lifetime|_ltd", "flow": "payment|charge|recovery|advance|flow", "event": "event|default_date|modification_date", "stock": "balance|status|rating|utilization"}


def _by_name(field: Column | str, table: dict[str, str]) -> Column:
    name, out = F.lower(col(field)), None
    for kind, words in table.items():
        out = F.when(name.rlike(words), kind) if out is None else out.when(name.rlike(words), kind)
    return out.otherwise("unknown")


def infer_unit(field: Column | str) -> Column:
    """currency, percentage, days, date, identifier or unknown, by the name of a field."""
    return _by_name(field, UNIT_WORDS)


def infer_temporal(field: Column | str) -> Column:
    """lifetime_to_date, flow, event, stock or unknown, by the name of a field."""
    return _by_name(field, TEMPORAL_WORDS)


def value_kind(text: Column | str) -> Column:
    """null, boolean, integer, decimal, date, datetime or text."""
    t = col(text)
    return (
        F.when(blank_to_null(t).isNull(), "null")
        .when(F.lower(t).isin("true", "false"), "boolean")
        .when(t.rlike(INTEGER_TEXT), "integer")
        .when(t.rlike(DECIMAL_TEXT), "decimal")
        .when(t.rlike(DATE_TEXT) & F.try_to_date(t, "yyyy-MM-dd").isNotNull(), "date")
        .when(t.rlike(DATETIME_TEXT) & F.try_to_timestamp(t).isNotNull(), "datetime")
        .otherwise("text")
    )


def evidence_refs(refs: Column | str) -> Column:
    """Distinct references in order."""
    return F.array_sort(F.array_distinct(col(refs)))


def dedupe_key(*parts: Column | str) -> Column:
    """``monitor:`` and the hash of monitor and scope; equal conditions share a case."""
    return F.concat(F.lit("monitor:"), F.sha2(F.concat_ws("\u001f", *[F.coalesce(col(p).cast("string"), F.lit("")) for p in parts]), 256))


# Sums may be divided: amounts first go to decimal(38,2), ratios to double.
def amount(c: Column | str) -> Column:
    return col(c).cast(AMOUNT)


def total(c: Column | str) -> Column:
    return F.sum(col(c)).cast(WIDE)


def nz(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0))
