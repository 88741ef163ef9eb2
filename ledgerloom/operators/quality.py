"""Data quality, profiles, drift and reconciliation as single-pass aggregates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import DATE_TEXT, DECIMAL_TEXT, WIDE, blank_to_null, digest_sums, infer_temporal, infer_unit, ratio, value_kind
from ..functions.tables import settled


@dataclass
class Profile:
    """What one snapshot is held against. Columns are raw text."""

    keys: list[str]
    required: list[str] = field(default_factory=list)
    decimals: list[str] = field(default_factory=list)
    not_negative: list[str] = field(default_factory=list)
    dates: list[str] = field(default_factory=list)
    date_orders: list[tuple[str, str]] = field(default_factory=list)
    codes: dict[str, list[str]] = field(default_factory=dict)
    null_rates: dict[str, float] = field(default_factory=dict)
    as_of: str = ""
    mode: str = "snapshot"
    balance: str = "outstanding_balance"
    currency: str | None = None
    max_age_days: int | None = None
    status_dpd: int | None = None


#: The severity of each finding. Critical and error block, warning does not.
SEVERITY = {
    "required_value_missing": "critical", "grain_key_missing": "critical", "exact_decimal_invalid": "critical", "numeric_value_invalid": "critical", "negative_value": "error",
    "date_value_invalid": "critical", "as_of_date_mismatch": "critical", "as_of_date_after_cutoff": "critical", "date_order_invalid": "error", "code_value_unknown": "warning",
    "status_delinquency_inconsistent": "error", "duplicate_grain_key": "critical", "null_rate_exceeded": "error", "empty_snapshot": "critical", "as_of_cutoff_missing": "critical",
    "snapshot_stale": "warning", "mixed_currency_population": "error", "currency_mismatch": "error",
}


def severity_of(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv]), code)


def _date(c: str) -> Column:
    text = blank_to_null(c)
    return F.when(text.rlike(DATE_TEXT), F.try_to_date(text, "yyyy-MM-dd"))


def _number(c: str) -> Column:
    text = blank_to_null(c)
    return F.when(text.rlike(DECIMAL_TEXT), text.try_cast("decimal(38,6)"))


def row_findings(p: Profile) -> list[tuple[str, str, Column]]:
    """(code, field, condition) of everything that one row alone can show."""
    out = [("required_value_missing", f, blank_to_null(f).isNull()) for f in p.required]
    out += [("grain_key_missing", f, blank_to_null(f).isNull()) for f in p.keys]
    for f in p.decimals:
        text = blank_to_null(f)
        out.append(("exact_decimal_invalid", f, text.isNotNull() & ~text.rlike(DECIMAL_TEXT)))
    out += [("negative_value", f, F.coalesce(_number(f) < 0, F.lit(False))) for f in p.not_negative]
    out += [("date_value_invalid", f, blank_to_null(f).isNotNull() & _date(f).isNull()) for f in p.dates]
    if p.as_of:
        cutoff = F.lit(p.as_of).cast("date")
        wrong = F.coalesce((_date("as_of_date") != cutoff) if p.mode == "snapshot" else (_date("as_of_date") > cutoff), F.lit(False))
        out.append(("as_of_date_mismatch" if p.mode == "snapshot" else "as_of_date_after_cutoff", "as_of_date", wrong))
    out += [("date_order_invalid", b, F.coalesce(_date(a) > _date(b), F.lit(False))) for a, b in p.date_orders]
    for f, values in p.codes.items():
        text = blank_to_null(f)
        out.append(("code_value_unknown", f, text.isNotNull() & ~F.lower(text).isin([v.lower() for v in values])))
    if p.status_dpd is not None:
        dpd, status = _number("days_past_due"), F.lower(blank_to_null("loan_status"))
        out.append(("status_delinquency_inconsistent", "loan_status", F.coalesce(((status == "current") & (dpd >= p.status_dpd)) | ((status == "delinquent") & (dpd == 0)), F.lit(False))))
    return out


def run_quality(df: DataFrame, p: Profile) -> DataFrame:
    """Findings by code and field with rows and balance affected, most severe first by name. One pass for the row rules and the
    table rules together; one aggregate by key for duplicates (all rows of a repeated key count)."""
    rules = row_findings(p)
    balance = F.coalesce(_number(p.balance), F.lit(0))
    hit = lambda cond: F.coalesce(cond, F.lit(False))
    aggs = [F.count("*").alias("__rows"), F.max(_date("as_of_date")).alias("__last"), F.min(F.upper(blank_to_null("currency"))).alias("__c0"), F.max(F.upper(blank_to_null("currency"))).alias("__c1")] if "currency" in df.columns else [F.count("*").alias("__rows"), F.max(_date("as_of_date")).alias("__last"), F.lit(None).cast("string").alias("__c0"), F.lit(None).cast("string").alias("__c1")]
    for i, (_, _, cond) in enumerate(rules):
        aggs += [F.sum(hit(cond).cast("long")).alias(f"r{i}"), F.sum(F.when(hit(cond), balance)).alias(f"b{i}")]
    for i, f in enumerate(p.null_rates):
        aggs.append(F.sum(blank_to_null(f).isNull().cast("long")).alias(f"n{i}"))
    one = df.agg(*aggs)
    cell = lambda code, name, rows, bal, fires: F.when(fires, F.struct(F.lit(code).alias("code"), F.lit(name).alias("field"), rows.cast("long").alias("affected_rows"), F.coalesce(bal, F.lit(0)).cast(WIDE).alias("affected_balance")))
    zero = F.lit(0).cast("decimal(38,6)")
    found = [cell(code, name, F.col(f"r{i}"), F.col(f"b{i}"), F.col(f"r{i}") > 0) for i, (code, name, _) in enumerate(rules)]
    rows = F.col("__rows")
    for i, (f, most) in enumerate(p.null_rates.items()):
        share = F.when(rows == 0, F.lit(1.0)).otherwise(F.col(f"n{i}").cast("double") / rows)
        found.append(cell("null_rate_exceeded", f, F.coalesce(f"n{i}", F.lit(0)), zero, share > most))
    found.append(cell("empty_snapshot", "", rows, zero, rows == 0))
    found.append(cell("mixed_currency_population", "currency", rows, zero, F.col("__c0") != F.col("__c1")))
    if p.currency:
        found.append(cell("currency_mismatch", "currency", rows, zero, (F.col("__c0") == F.col("__c1")) & (F.col("__c0") != p.currency)))
    if p.as_of and p.max_age_days is not None:
        found.append(cell("snapshot_stale", "as_of_date", rows, zero, F.datediff(F.lit(p.as_of).cast("date"), "__last") > p.max_age_days))
    if not p.as_of:
        found.append(cell("as_of_cutoff_missing", "as_of_date", rows, zero, F.lit(True)))
    table = one.select(F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.*")
    keys = [F.coalesce(blank_to_null(k), F.lit("")).alias(k) for k in p.keys]
    doubled = df.groupBy(*keys).count().where("count > 1").agg(F.sum("count").alias("n")).where("n > 0")
    twice = doubled.select(F.lit("duplicate_grain_key").alias("code"), F.lit("").alias("field"), F.col("n").cast("long").alias("affected_rows"), F.lit(0).cast(WIDE).alias("affected_balance"))
    return table.unionByName(twice).withColumn("severity", severity_of(F.col("code")))


def decision(findings: DataFrame) -> DataFrame:
    """publish, or block if any finding is critical or an error."""
    bad = F.max(F.col("severity").isin("critical", "error"))
    return findings.agg(F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("publish").alias("decision"), F.count("*").alias("findings"))


@dataclass
class Rule:
    """v2 rule: required, allowed_values, decimal_range, equals_sum or unique. Null passes a range and fails a sum."""

    rule_id: str
    kind: str
    column: str
    values: list[str] = field(default_factory=list)
    low: str | None = None
    high: str | None = None
    parts: list[str] = field(default_factory=list)
    tolerance: str = "0"
    blocks: bool = False

    def violated(self) -> Column:
        c = F.col(self.column)
        if self.kind == "required":
            return blank_to_null(c).isNull()
        if self.kind == "allowed_values":
            return ~F.coalesce(blank_to_null(c).isin(self.values), F.lit(False))
        if self.kind == "decimal_range":
            low = c < F.lit(self.low).cast("decimal(38,6)") if self.low is not None else F.lit(False)
            high = c > F.lit(self.high).cast("decimal(38,6)") if self.high is not None else F.lit(False)
            return F.coalesce(low | high, F.lit(False))
        if self.kind == "equals_sum":
            whole = sum((F.col(x) for x in self.parts[1:]), F.col(self.parts[0]))
            return F.coalesce(F.abs(c - whole) > F.lit(self.tolerance).cast("decimal(38,6)"), F.lit(True))
        if self.kind == "unique":
            return F.coalesce(F.count(c).over(Window.partitionBy(c)) > 1, F.lit(False)) & c.isNotNull()
        raise ValueError(f"unknown rule {self.kind}")


def run_quality_v2(df: DataFrame, rules: list[Rule], balance: str, material: str) -> DataFrame:
    """One row per rule, passes too: rows and balance affected, share of the whole balance, material or not, blocking or not."""
    flags = df.select(F.coalesce(F.col(balance), F.lit(0)).alias("__b"), *[r.violated().alias(f"v{i}") for i, r in enumerate(rules)])
    aggs = [F.count("*").alias("n"), F.sum("__b").alias("whole")]
    for i in range(len(rules)):
        aggs += [F.sum(F.col(f"v{i}").cast("long")).alias(f"n{i}"), F.sum(F.when(F.col(f"v{i}"), F.col("__b")).otherwise(0)).alias(f"b{i}")]
    rows = F.array(*[F.struct(F.lit(r.rule_id).alias("rule_id"), F.coalesce(f"n{i}", F.lit(0)).alias("affected_rows"), F.coalesce(f"b{i}", F.lit(0)).cast(WIDE).alias("affected_balance"), F.lit(r.blocks).alias("blocks")) for i, r in enumerate(rules)])
    out = flags.agg(*aggs).select("whole", F.explode(rows).alias("r")).select("r.*", "whole")
    return out.select(
        "rule_id", "affected_rows", "affected_balance", ratio("affected_balance", "whole").alias("affected_share"), (F.col("affected_balance") >= F.lit(material).cast(WIDE)).alias("material"),
        F.when(F.col("affected_rows") == 0, "pass").when(F.col("blocks"), "block").otherwise("warn").alias("outcome"),
    )


def unpivot_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value) of every cell as text; blank is null."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), blank_to_null(c).alias("value")) for c in columns])).alias("x")).select("x.field", "x.value")


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per field: rows, nulls and their share, distinct values, kinds of values, least and greatest (as numbers if all are),
    unit and temporal kind by name. Values are first counted per (field, value), so distinct counts are exact and combine."""
    counted = unpivot_text(df, columns).groupBy("field", "value").agg(F.count("*").alias("n"))
    number = F.when(F.col("value").rlike(DECIMAL_TEXT), F.col("value").try_cast("decimal(38,6)"))
    grouped = counted.groupBy("field").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), value_kind("value")))), ",").alias("kinds"),
        F.min("value").alias("min_text"),
        F.max("value").alias("max_text"),
        F.min(number).alias("min_number"),
        F.max(number).alias("max_number"),
        (F.count("value") == F.count(number)).alias("numeric"),
    )
    text = lambda c: F.col(c).cast("decimal(38,6)").cast("string")
    return grouped.select(
        "field", "rows", "nulls", ratio("nulls", "rows").alias("null_share"), "distinct", ratio("distinct", F.col("rows") - F.col("nulls")).alias("uniqueness"), "kinds",
        F.when(F.col("numeric"), text("min_number")).otherwise(F.col("min_text")).alias("least"), F.when(F.col("numeric"), text("max_number")).otherwise(F.col("max_text")).alias("greatest"),
        infer_unit("field").alias("unit"), infer_temporal("field").alias("temporal"),
    )


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent values of each field with their shares; ties by value."""
    counted = unpivot_text(df, columns).where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    whole = counted.groupBy("field").agg(F.sum("n").alias("whole"))
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), "value"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(whole), "field").select("field", "rank", "value", "n", ratio("n", "whole").alias("share"))


#: Candidates that are sent to all tasks are at most so many.
CANDIDATES = 200_000


def _summaries(batches: Iterator[pa.RecordBatch], counters: int) -> Iterator[pa.RecordBatch]:
    """Per task and field the values that may be frequent, counted from below (value, n), and (null, cells, how far a count may be short)."""
    held: dict[str, Counter] = {}
    cells: Counter = Counter()
    short: Counter = Counter()

    def pruned(name: str) -> Counter:
        kept = held[name].most_common(counters + 1)
        if len(kept) <= counters:
            return held[name]
        # All counts fall by the least that is dropped: what is dropped had no more than that.
        least = kept[-1][1]
        short[name] += least
        return Counter({v: n - least for v, n in kept[:-1] if n > least})

    for batch in batches:
        for name, part in pa.TableGroupBy(pa.Table.from_batches([batch]), ["field", "value"]).aggregate([([], "count_all")]).to_pandas().groupby("field"):
            found = held.setdefault(name, Counter())
            found.update(dict(zip(part["value"], part["count_all"].tolist(), strict=True)))
            cells[name] += int(part["count_all"].sum())
            if len(found) > 2 * counters:
                held[name] = pruned(name)
    for name in held:
        kept = pruned(name)
        values = [None, *kept]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(values)), pa.array(values, pa.string()), pa.array([cells[name], *kept.values()], pa.int64()), pa.array([short[name]] + [0] * len(kept), pa.int64())], names=["field", "value", "n", "short"])


def frequent_values(df: DataFrame, columns: list[str], k: int, counters: int = 4096) -> DataFrame:
    """``top_values`` in two scans, whose shuffles don't grow with the number of distinct values.

    Each task keeps ``counters`` counters a field (Misra and Gries, 1982, as Space-Saving has them); merged, a count is short by at
    most E, the sum of what the tasks fell by, and a value without a counter has at most E. If E is less than the k-th count from
    below, only values whose count plus E reaches it can be among the first k, and these are counted exactly. Fields for which
    that isn't so (no value is frequent) are counted in full.
    """
    run = lambda batches: _summaries(batches, counters)
    merged = unpivot_text(df, columns).where("value is not null").select("field", "value").mapInArrow(run, "field string, value string, n long, short long")
    merged = settled(merged.groupBy("field", "value").agg(F.sum("n").alias("n"), F.sum("short").alias("short")), "counters")
    whole = merged.where("value is null").select("field", F.col("n").alias("whole"), F.col("short").alias("error"))
    low = merged.where("value is not null").withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), "value")))
    kth = low.groupBy("field").agg(F.coalesce(F.max(F.when(F.col("rank") == k, F.col("n"))), F.lit(0)).alias("least"))
    fields = {r.field: r for r in whole.join(kth, "field", "left").select("field", "whole", "error", F.coalesce("least", F.lit(0)).alias("least")).collect()}
    proven = [c for c in columns if c in fields and (fields[c].error < fields[c].least or not fields[c].error)]
    candidates = low.join(whole, "field").join(kth, "field").where(F.col("field").isin(proven) & (F.col("n") + F.col("error") >= F.col("least"))).select("field", "value")
    if candidates.count() > CANDIDATES:
        proven = []
    rest = [c for c in columns if c in fields and c not in proven]
    counted = []
    if proven:
        counted.append(unpivot_text(df, proven).join(F.broadcast(candidates), ["field", "value"]).groupBy("field", "value").agg(F.count("*").alias("n")))
    if rest or not proven:
        counted.append(unpivot_text(df, rest or columns).where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n")))
    every = reduce(DataFrame.unionByName, [c.select("field", "value", "n") for c in counted])
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.col("n").desc(), "value"))).where(F.col("rank") <= k)
    return ranked.join(F.broadcast(whole.select("field", "whole")), "field").select("field", "rank", "value", "n", ratio("n", "whole").alias("share"))


def drift(before: DataFrame, after: DataFrame, null_share: float = 0.05) -> DataFrame:
    """Fields that are added, removed, of another type, or whose share of nulls moved by more than ``null_share``."""
    a = before.select("field", F.col("kinds").alias("k0"), F.col("null_share").alias("s0"), F.lit(1).alias("a"))
    b = after.select("field", F.col("kinds").alias("k1"), F.col("null_share").alias("s1"), F.lit(1).alias("b"))
    both = a.join(b, "field", "full")
    moved = F.abs(F.coalesce("s1", F.lit(0.0)) - F.coalesce("s0", F.lit(0.0)))
    kinds = F.array_compact(
        F.array(
            F.when(F.col("a").isNull(), "added"),
            F.when(F.col("b").isNull(), "removed"),
            F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("k0") != F.col("k1")), "type"),
            F.when(F.col("a").isNotNull() & F.col("b").isNotNull() & (moved > null_share), "null_share"),
        )
    )
    return both.select("field", F.explode(kinds).alias("change"), F.col("s0").alias("share_before"), F.col("s1").alias("share_after"))


def category_drift(before: DataFrame, after: DataFrame, columns: list[str], least: float = 0.05) -> DataFrame:
    """Values whose share of a field moved by at least ``least``."""

    def shares(df: DataFrame, name: str) -> DataFrame:
        n = unpivot_text(df, columns).where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
        whole = n.groupBy("field").agg(F.sum("n").alias("w"))
        return n.join(whole, "field").select("field", "value", ratio("n", "w").alias(name))

    both = shares(before, "s0").join(shares(after, "s1"), ["field", "value"], "full").na.fill(0.0, ["s0", "s1"])
    return both.withColumn("moved", F.col("s1") - F.col("s0")).where(F.abs("moved") >= least)


def reconcile(actual: DataFrame, declared: DataFrame, scope: list[str], tolerance: str = "0") -> DataFrame:
    """Declared controls (row_count, balance, currency) against the rows, per scope, with reasons. Scopes on one side only fail."""
    sums = actual.groupBy(*scope).agg(F.count("*").alias("rows"), F.sum(F.coalesce("outstanding_balance", F.lit(0))).cast(WIDE).alias("actual_balance"), F.min("currency").alias("c0"), F.max("currency").alias("c1"))
    both = declared.join(sums, scope, "full")
    off = F.abs(F.coalesce("actual_balance", F.lit(0)) - F.coalesce("balance", F.lit(0)))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("rows").isNull(), "missing_population"),
            F.when(F.col("row_count").isNull(), "undeclared_population"),
            F.when(F.col("rows") != F.col("row_count"), "row_count_mismatch"),
            F.when(off.cast("decimal(28,6)") > F.lit(tolerance).cast("decimal(28,6)"), "balance_mismatch"),
            F.when((F.col("c0") != F.col("c1")) | (F.col("c0") != F.col("declared_currency")), "currency_mismatch"),
        )
    )
    return both.select(*scope, "rows", "row_count", "actual_balance", "balance", off.cast(WIDE).alias("difference"), F.array_join(reasons, ",").alias("reasons"), (F.size(reasons) == 0).alias("passed"))


def reconcile_segments(actual: DataFrame, expected: DataFrame, dims: list[str], tolerance: str = "0.005") -> DataFrame:
    """Balances by up to five dimensions and currency; an absent dimension is ``[NULL]``."""
    if not 1 <= len(dims) <= 5:
        raise ValueError("one to five dimensions")
    keys = [*dims, "currency"]
    named = lambda df: df.select(*[F.coalesce(blank_to_null(k), F.lit("[NULL]")).alias(k) for k in keys], "balance")
    a = named(actual).groupBy(*keys).agg(F.sum("balance").cast(WIDE).alias("actual"))
    e = named(expected).groupBy(*keys).agg(F.sum("balance").cast(WIDE).alias("expected"))
    both = a.join(e, keys, "full")
    diff = (F.coalesce("actual", F.lit(0)) - F.coalesce("expected", F.lit(0))).cast(WIDE)
    return both.select(*keys, "expected", "actual", diff.alias("difference"), (F.abs(diff).cast("decimal(28,6)") <= F.lit(tolerance).cast("decimal(28,6)")).alias("passed"))


def certify(findings: DataFrame, controls: DataFrame) -> DataFrame:
    """One row: certified or failed, with the blocking codes of quality and reconciliation in order."""
    bad = findings.where(F.col("severity").isin("critical", "error")).select(F.col("code").alias("blocker"))
    off = controls.where(~F.col("passed")).select(F.explode(F.split("reasons", ",")).alias("blocker"))
    codes = bad.union(off).agg(F.array_join(F.array_sort(F.collect_set("blocker")), ",").alias("blockers"))
    return codes.select(F.when(F.col("blockers") == "", "certified").otherwise("failed").alias("status"), "blockers")


def fingerprint(rows: DataFrame, findings: DataFrame, profile: str) -> DataFrame:
    """One hash of what was judged and what was found: profile, rows and findings, whatever their order. Sums of digests combine
    before the shuffle, so nothing is sorted or collected."""

    def whole(df: DataFrame, name: str) -> DataFrame:
        digest = F.sha2(F.to_json(F.array(*[F.col(f"`{c}`").cast("string") for c in sorted(df.columns)])), 256)
        return df.agg(F.concat_ws(":", F.count("*"), *digest_sums(digest)).alias(name))

    both = whole(rows, "rows").crossJoin(whole(findings, "findings"))
    return both.select(F.sha2(F.concat_ws("|", F.lit(profile), "rows", "findings"), 256).alias("fingerprint"))
