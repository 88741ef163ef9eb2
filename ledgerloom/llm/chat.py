"""Chat formatting by schema fingerprints, in DataFrame functions only.

The nested field paths of a layout are sorted and hashed; the hash selects a declarative mapping to canonical turns
(array of role, text). Tables are fingerprinted by their schema, JSON rows one by one by the schema of their value, so a
column may mix layouts. Canonical turns become one transcript in which control strings mark turns, and the loss mask is a
run-length list over it. Texts are escaped reversibly: a backslash is doubled, and ``<|`` is parted by a backslash, so no
text can hold a control string.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def paths_of(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a type; ``[]`` stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths_of(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths_of(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _turn(role: str, text: str) -> str:
    return f"named_struct('role', {role}, 'text', {text})"


#: Declarative mappings. Rows of turns: (key, order, role, text). Whole conversations: one SQL expression over the columns
#: (or, for JSON, over ``v``) that gives the turns.
ROW_LAYOUTS = {
    fingerprint(["conv_id", "turn", "role", "text"]): ("conv_id", "turn", "role", "text"),
    fingerprint(["conversation_id", "index", "role", "content"]): ("conversation_id", "index", "role", "content"),
}
_ALIASES = "CASE lower({0}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE {0} END"
DOCUMENT_LAYOUTS = {
    fingerprint(["prompt", "response"]): f"array({_turn("'user'", '{prompt}')}, {_turn("'assistant'", '{response}')})",
    fingerprint(["prompt", "completion"]): f"array({_turn("'user'", '{prompt}')}, {_turn("'assistant'", '{completion}')})",
    fingerprint(["instruction", "output"]): f"array({_turn("'user'", '{instruction}')}, {_turn("'assistant'", '{output}')})",
    fingerprint(["instruction", "input", "output"]): "array("
    + _turn("'user'", r"IF(coalesce({input}, '') = '', {instruction}, concat({instruction}, '\n\n', {input}))")
    + f", {_turn("'assistant'", '{output}')})",
    fingerprint(["system", "prompt", "response"]): f"array({_turn("'system'", '{system}')}, {_turn("'user'", '{prompt}')}, {_turn("'assistant'", '{response}')})",
    fingerprint(["messages[].role", "messages[].content"]): f"transform({{messages:array<struct<role:string,content:string>>}}, m -> {_turn('m.role', 'm.content')})",
    fingerprint(["conversations[].from", "conversations[].value"]): f"transform({{conversations:array<struct<`from`:string,value:string>>}}, m -> {_turn(_ALIASES.format('m.`from`'), 'm.value')})",
}


def _fill(layout: str, field) -> Column:
    """Put the columns in: {name} is text, {name:type} another type."""
    return F.expr(re.sub(r"\{(\w+)(?::([^}]+))?\}", lambda m: field(m[1], m[2] or "string"), layout))


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table with one row per turn; its fingerprint selects the columns. Extra columns don't count.

    Turns are in the order of turn, role, text, nulls first; null roles and texts are empty; a null id is a conversation too.
    """
    names = {c.lower(): c for c in rows.columns}
    for key, order, role, text in ROW_LAYOUTS.values():
        mine = [names.get(c) for c in (key, order, role, text)]
        if None not in mine and fingerprint([c.lower() for c in mine]) in ROW_LAYOUTS:
            key, order, role, text = (F.col(f"`{c}`") for c in mine)
            turn = F.struct(order.alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
            got = rows.groupBy(key.alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("t"))
            return got.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    raise ValueError(f"no mapping for the fields {sorted(names)}")


def turns_of_table(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and turns of a table with one row per conversation; all other columns make the fingerprint."""
    schema = T.StructType([f for f in rows.schema.fields if f.name not in keep])
    layout = DOCUMENT_LAYOUTS.get(fingerprint(paths_of(schema)))
    if layout is None:
        raise ValueError(f"no mapping for the fields {paths_of(schema)}")
    turns = _fill(layout, lambda name, kind: f"CAST(`{name}` AS {kind})")
    return rows.select(*keep, _tidy(turns).alias("turns"))


def turns_of_json(rows: DataFrame, json_col: str) -> DataFrame:
    """All columns, fingerprint and turns of a column of JSON objects whose layouts may differ row by row.

    Unparseable, null and unknown layouts have null turns (and keep their fingerprint, so that a mapping can be added).
    Fields whose value is null in a row count by name; the fields of an array's elements are those of its first one.
    """
    parsed = rows.withColumn("v", F.try_parse_json(F.col(json_col)))
    # Field names of the object, and those of the objects in its arrays: two levels cover every mapping.
    top = F.expr("sort_array(coalesce(json_object_keys(to_json(v)), array()))")
    element = lambda k: F.call_function("get_json_object", F.to_json("v"), F.concat(F.lit("$['"), k, F.lit("'][0]")))
    inner = lambda k: F.transform(F.json_object_keys(element(k)), lambda j: F.concat(k, F.lit("[]."), j))
    path = F.flatten(F.transform(top, lambda k: F.when(element(k).startswith("{"), inner(k)).otherwise(F.array(k))))
    marked = parsed.withColumn("fingerprint", F.sha2(F.array_join(F.sort_array(path), "\n"), 256))
    turns = F.lit(None).cast(TURNS)
    for mark, layout in DOCUMENT_LAYOUTS.items():
        got = _fill(layout, lambda name, kind: f"try_variant_get(v, '$.{name}', '{kind.replace('`', '')}')")
        turns = F.when(F.col("fingerprint") == mark, _tidy(got)).otherwise(turns)
    return marked.withColumn("turns", turns).drop("v")


def _tidy(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_turns(conversations: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds formatted and loss to a table with turns. loss is the mask over formatted as runs: (chars, learn), three a turn
    (marks and role; text; end mark); only the texts of the roles in ``learn`` are under it. No turns give an empty transcript."""
    turns = F.coalesce(F.col("turns"), F.array().cast(TURNS))
    safe = F.transform(turns, lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), t["role"].isin(*learn).alias("learn")))
    kept = conversations.drop("formatted", "loss").withColumn("__safe", safe)
    one = lambda t: F.concat(F.lit(TURN), t["role"], F.lit(BODY), t["text"], F.lit(END))
    run = lambda n, flag: F.struct(n.alias("chars"), flag.alias("learn"))
    no = F.lit(False)
    runs = F.flatten(
        F.transform(
            "__safe",
            lambda t: F.array(run(F.length(t["role"]) + len(TURN) + len(BODY), no), run(F.length(t["text"]), t["learn"]), run(F.lit(len(END)), no)),
        )
    )
    return kept.withColumn("formatted", F.array_join(F.transform("__safe", one), "")).withColumn("loss", runs).drop("__safe")


def _starts(sizes: Column) -> Column:
    """Where each part begins if the parts follow each other."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sizes, state, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]


def parse_formatted(formatted: DataFrame) -> DataFrame:
    """Adds read: the turns (role, text, learn) that the transcript and its mask hold, unescaped again. learn: the mask has a run
    under loss that begins and ends, counted from the start of the transcript, where the text does."""
    # The transcript starts with a mark, so the first part of the split is empty.
    parts = F.split("formatted", re.escape(TURN))
    parts = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    fields = F.transform(parts, lambda p: F.struct(F.substring_index(p, BODY, 1).alias("role"), p.alias("part")))
    placed = formatted.withColumn("__part", _starts(F.transform(parts, lambda p: F.length(p) + len(TURN)))).withColumn("__run", _starts(F.transform("loss", lambda r: r["chars"])))

    def turn(f: Column, i: Column) -> Column:
        before = F.length(f["role"]) + len(BODY)
        body = f["part"].substr(before + 1, F.length(f["part"]) - before - len(END))
        run = F.get(F.col("loss"), i * 3 + 1)
        same = (run["chars"] == F.length(body)) & (F.get(F.col("__run"), i * 3 + 1) == F.get(F.col("__part"), i) + len(TURN) + before)
        return F.struct(unescape(f["role"]).alias("role"), unescape(body).alias("text"), (run["learn"] & same).alias("learn"))

    return placed.withColumn("read", F.transform(fields, turn)).drop("__part", "__run")
