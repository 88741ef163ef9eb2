"""Mapping of delivered columns to canonical ones: a closed expression tree compiled to Columns.

Every node compiles to a pair (value, failed): failed is a boolean Column, so bad input never raises inside a task unless a
rule says so. Rules run in order; a rule with ``reject_row`` rejects the row under its code, ``null`` nulls the field, and
``fail_application`` raises.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scalars import DATE_TEXT, DATETIME_TEXT, DECIMAL_TEXT, INTEGER_TEXT, blank_to_null



@dataclass
class Rule:
    rule_id: str
    target: str
    expression: dict
    on_error: str = "reject_row"


Pair = tuple[Column, Column]


def _never() -> Column:
    return F.lit(False)


def exact_cast(text: Column, to: str) -> Pair:
    """(value, failed) of the nine logical types; null stays null and never fails. Shapes are checked before any cast."""
    t = text.cast("string")
    here = t.isNotNull()
    fails = lambda v: here & v.isNull()
    if to in ("string", "identifier"):
        return t, _never()
    if to == "integer":
        v = F.when(t.rlike(INTEGER_TEXT), t.try_cast("long"))
    elif to in ("decimal", "currency", "percentage"):
        v = F.when(t.rlike(DECIMAL_TEXT), t.try_cast("decimal(38,10)"))
    elif to == "boolean":
        v = F.when(F.lower(t).isin("true", "1"), True).when(F.lower(t).isin("false", "0"), False)
    elif to == "date":
        v = F.when(t.rlike(DATE_TEXT), F.try_to_date(t, "yyyy-MM-dd"))
    elif to == "datetime":
        v = F.when(t.rlike(DATETIME_TEXT), F.try_to_timestamp(t))
    elif to == "currency_code":
        v = F.when(t.rlike("^[A-Z]{3}$"), t)
    else:
        raise ValueError(f"unknown type {to}")
    return v, fails(v)


#: Accepted date formats, by their shape.
DATE_FORMATS = {"YYYY-MM-DD": (DATE_TEXT, "yyyy-MM-dd"), "MM/DD/YYYY": (r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$", "MM/dd/yyyy"), "YYYYMMDD": (r"^[0-9]{8}$", "yyyyMMdd")}


def parse_date(text: Column, formats: list[str]) -> Pair:
    t = text.cast("string")
    v = F.coalesce(*[F.when(t.rlike(shape), F.try_to_date(t, fmt)) for shape, fmt in (DATE_FORMATS[f] for f in formats)])
    return v, t.isNotNull() & v.isNull()


def condition(tree: dict, compile_: object) -> Column:
    """Two-valued; null equals null."""
    op = tree["op"]
    if op in ("and", "or"):
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), [condition(a, compile_) for a in tree["args"]])
    if op == "not":
        return ~condition(tree["arg"], compile_)
    v = compile_(tree["input"])[0]
    if op == "is_null":
        return v.isNull()
    if op == "equals":
        return v.eqNullSafe(F.lit(tree["value"]))
    if op == "in":
        some = F.coalesce(v.isin([x for x in tree["values"] if x is not None]), F.lit(False))
        return some | v.isNull() if None in tree["values"] else some
    raise ValueError(f"unknown condition {op}")


def compile_expression(tree: dict, columns: list[str]) -> Pair:
    """(value, failed) of one expression over the given columns."""

    def go(t: dict) -> Pair:
        op = t["op"]
        if op == "source":
            return (F.col(t["column"]) if t["column"] in columns else F.lit(None).cast("string")), _never()
        if op == "literal":
            return F.lit(t["value"]), _never()
        if op == "exact_cast":
            v, bad = go(t["input"])
            w, worse = exact_cast(v, t["to"])
            return w, bad | worse
        if op == "parse_date":
            v, bad = go(t["input"])
            w, worse = parse_date(v, t["formats"])
            return w, bad | worse
        if op == "scale_decimal":
            v, bad = go(t["input"])
            number, worse = exact_cast(v, "decimal")
            exact = (number.cast("decimal(20,8)") * F.lit(t["factor"]).cast("decimal(12,6)")).cast("decimal(38,14)")
            rounded = F.bround(exact, t["places"])
            lossy = (rounded != exact) if t.get("rounding", "reject") == "reject" else _never()
            return rounded, bad | worse | F.coalesce(lossy, F.lit(False))
        if op == "code_map":
            v, bad = go(t["input"])
            table = F.create_map(*[F.lit(x) for kv in t["values"].items() for x in kv])
            hit = F.try_element_at(table, v)
            miss = v.isNotNull() & hit.isNull()
            unknown = t.get("unknown", "reject")
            return (F.coalesce(hit, v) if unknown == "preserve" else hit), bad | (miss if unknown == "reject" else _never())
        if op == "coalesce":
            parts = [go(a) for a in t["inputs"]]
            return F.coalesce(*[p[0] for p in parts]), reduce(lambda a, b: a | b, [p[1] for p in parts])
        if op == "when":
            test = condition(t["condition"], go)
            (a, bad_a), (b, bad_b) = go(t["then"]), go(t["otherwise"])
            return F.when(test, a).otherwise(b), F.when(test, bad_a).otherwise(bad_b)
        if op == "split":
            v, bad = go(t["input"])
            part = F.get(F.split(v, re.escape(t["delimiter"])), F.lit(t["index"]))
            return (F.trim(part) if t.get("trim") else part), bad | (v.isNotNull() & part.isNull())
        if op == "combine":
            parts = [go(a) for a in t["inputs"]]
            values = [p[0].cast("string") for p in parts]
            joined = F.concat_ws(t.get("separator", ""), *values)
            missing = reduce(lambda a, b: a | b, [v.isNull() for v in values])
            return (joined if t.get("skip_nulls") else F.when(~missing, joined)), reduce(lambda a, b: a | b, [p[1] for p in parts])
        if op == "dimension_lookup":
            v, bad = go(t["input"])
            hit = F.col(f"__dim_{t['definition']}")
            unknown = t.get("missing", "reject")
            return (F.coalesce(hit, v) if unknown == "preserve" else hit), bad | ((v.isNotNull() & hit.isNull()) if unknown == "reject" else _never())
        raise ValueError(f"unknown expression {op}")

    return go(tree)


def lookups(tree: object) -> list[dict]:
    """Dimension lookups anywhere in a tree."""
    if isinstance(tree, dict):
        own = [tree] if tree.get("op") == "dimension_lookup" else []
        return own + [x for v in tree.values() for x in lookups(v)]
    return [x for v in tree for x in lookups(v)] if isinstance(tree, list) else []


def execute_mapping(df: DataFrame, rules: list[Rule], row_id: str, dimensions: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejections). records: row_id and one column per rule of the rows that no rule rejects; rejections: row_id and the
    first rule that rejects it. Dimensions (key, value) join by equality, and a repeated key ends the run; Spark sends small ones to
    the tasks by itself.
    """
    for look in lookups([r.expression for r in rules]):
        name = look["definition"]
        if f"__dim_{name}" not in df.columns:
            key = compile_expression(look["input"], df.columns)[0].cast("string")
            dim = dimensions[name].where("key is not null").groupBy(F.col("key").cast("string").alias(f"__key_{name}")).agg(F.count("*").alias("__n"), F.first("value").alias("__v"))
            twice = F.raise_error(F.concat(F.lit(f"dimension {name} repeats key "), F.col(f"__key_{name}")))
            dim = dim.select(f"__key_{name}", F.when(F.col("__n") > 1, twice).otherwise(F.col("__v")).alias(f"__dim_{name}"))
            df = df.withColumn(f"__in_{name}", key).join(dim, F.col(f"__in_{name}") == F.col(f"__key_{name}"), "left").drop(f"__key_{name}", f"__in_{name}")
    out, first = df, None
    for i, rule in enumerate(rules):
        value, failed = compile_expression(rule.expression, df.columns)
        bad = F.coalesce(failed, F.lit(False))
        if rule.on_error == "fail_application":
            value = F.when(bad, F.raise_error(F.lit(f"rule {rule.rule_id} failed"))).otherwise(value)
        elif rule.on_error == "null":
            value = F.when(~bad, value)
        else:
            first = F.when(bad, rule.rule_id) if first is None else first.when(bad, rule.rule_id)
        out = out.withColumn(f"__out_{i}", value)
    out = out.withColumn("__rejected", first if first is not None else F.lit(None).cast("string"))
    records = out.where("__rejected is null").select(row_id, *[F.col(f"__out_{i}").alias(r.target) for i, r in enumerate(rules)])
    return records, out.where("__rejected is not null").select(row_id, F.col("__rejected").alias("rule_id"))


def apply_approved(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """One-to-one mapping target: (source, type); a value that isn't of its type ends the run."""
    cols = []
    for target, (source, kind) in fields.items():
        v, bad = exact_cast(blank_to_null(source), kind)
        cols.append(F.when(bad, F.raise_error(F.concat(F.lit(f"{target}: "), F.col(source).cast("string")))).otherwise(v).alias(target))
    return df.select(*cols)


#: Families of native column types.
TYPE_FAMILIES = [("decimal", "^(decimal|numeric|number|money)"), ("integer", "^(tinyint|smallint|int|integer|bigint|long|serial)"), ("float", "^(float|double|real)"), ("boolean", "^bool"), ("datetime", "^(timestamp|datetime)"), ("date", "^date$"), ("time", "^time"), ("text", "^(char|varchar|string|text|uuid)"), ("json", "^(json|variant|struct|map|array)")]


def type_family(native: Column) -> Column:
    low, out = F.lower(F.trim(native)), None
    for name, shape in TYPE_FAMILIES:
        out = F.when(low.rlike(shape), name) if out is None else out.when(low.rlike(shape), name)
    return out.otherwise("unknown")


_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def normal_name(name: Column) -> Column:
    """snake_case without accents; ``%`` reads rate and ``&`` and."""
    split = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    words = F.regexp_replace(F.regexp_replace(F.lower(split), "%", " rate "), "&", " and ")
    plain = F.translate(words, *_ACCENTS)
    return F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex from built-in functions."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256)


def mask(df: DataFrame, policies: dict[str, str], key: bytes) -> DataFrame:
    """Columns by policy: none, tokenize (24 hex digits of an HMAC), partial (last four) or redact; without a policy, redact."""
    out = []
    for c in df.columns:
        how, text = policies.get(c, "redact"), F.col(c).cast("string")
        if how == "none":
            out.append(F.col(c))
        elif how == "tokenize":
            out.append(F.substring(hmac_sha256(key, F.concat(F.lit(f"{c}\u001f"), text)), 1, 24).alias(c))
        elif how == "partial":
            out.append(F.when(F.length(text) > 4, F.concat(F.lit("****"), F.right(text, F.lit(4)))).otherwise(F.when(text.isNotNull(), "****")).alias(c))
        else:
            out.append(F.when(text.isNotNull(), "[redacted]").alias(c))
    return df.select(*out)


def requested_fields(definitions: list[dict]) -> list[str]:
    """Columns that a set of metric definitions reads, for one projection before the scan."""
    found: set[str] = set()

    def walk(x: object) -> None:
        if isinstance(x, dict):
            found.update(v for k, v in x.items() if k == "field" and isinstance(v, str))
            found.update(f for k, v in x.items() if k == "fields" for f in v)
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(definitions)
    return sorted(found)

