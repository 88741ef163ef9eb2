"""PII by patterns and information-theoretic sanitisation.

Base spans are e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers. Beyond them the corpus says which
terms give an entity of each kind away: with ``P(near)`` the share of all terms within ``reach`` words of such an entity and
``P(near | t)`` that share of the occurrences of term t, t discloses too much if its pointwise mutual information
``log P(near | t) / P(near)`` is at least ``alpha`` times the information ``-log P(near)`` that the entity itself holds. All
counts are occurrences in distinct texts, so copies of one text are one witness, and ``P(near | t)`` is smoothed by some
further occurrences at the share ``P(near)``: a rare term that only occurs near entities gives them away, too. Wherever a text
holds an entity of a kind that a term gives away, the term is generalised to ``[TERM]``; one that all but determines the entity
(``beta`` times its information) is removed. Texts without an entity stay as they are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import append_columns, discard, no_text, settle

KINDS = ("email", "ip", "card", "phone")
LABEL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]", "removed": ""}
# Each is the base pattern with possessive repeats: the same matches, without quadratic retries in long runs.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
#: A task combines its terms whenever it holds so many, and sends them on in batches of so many rows.
HELD_TERMS, OUT_ROWS = 500_000, 50_000
OUT = [T.StructField("spans", T.ArrayType(SPAN)), T.StructField("clean_text", T.StringType())]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out: list[tuple[str, int, int]] = []
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = at = m.end()
        else:
            done = at = at + 1
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


_MAYBE = np.zeros(256, bool)
_MAYBE[[ord(c) for c in "0123456789@+"]] = True


def rows_with_marks(col: pa.Array) -> Iterator[tuple[int, str]]:
    """Rows that may hold a base span: those with a digit, an at sign or a plus."""
    raw, at = K.rows_of(col)
    for lo, hi in K.chunks(at):
        places = np.flatnonzero(_MAYBE[raw[at[lo] : at[hi]]]) + at[lo]
        for r in np.unique(np.searchsorted(at, places, side="right") - 1).tolist():
            yield r, raw[at[r] : at[r + 1]].tobytes().decode()


def terms(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, starts and ends (code points) of the terms that are in no span and are not just digits."""
    w = next(K.words(pa.array([text]), K.LETTER_WORDS))
    chars = np.concatenate(([0], np.cumsum((w.data & 0xC0) != 0x80)))
    start, end = chars[w.start], chars[w.end]
    use = np.array([not w.text(i).isdigit() for i in range(len(start))], bool)
    for _, s, e in spans:
        use &= (end <= s) | (start >= e)
    return w.value[use], start[use], end[use]


def near(start: np.ndarray, end: np.ndarray, spans: list[tuple[str, int, int]], reach: int) -> Iterator[np.ndarray]:
    """For each span: the places of the terms within ``reach`` terms before and after it."""
    for _, s, e in spans:
        before, after = int(np.searchsorted(end, s, "right")), int(np.searchsorted(start, e))
        yield np.r_[max(0, before - reach) : before, after : min(len(start), after + reach)]


def disclosing_terms(docs: DataFrame, text_col: str = "text", reach: int = 4, alpha: float = 0.8, beta: float = 0.98, prior: float = 1.0) -> DataFrame:
    """(term long, share double, general int, remove int): hashed terms over the disclosure threshold, from all distinct texts of
    ``docs``. share is the largest of the kinds; general and remove are bits by kind, in the order of KINDS.

    prior: how many occurrences at the common share are added to those of each term.
    """
    rows = docs.select(no_text(F.col(text_col)).alias("text")).distinct()
    sums = ["n", *(f"near_{k}" for k in KINDS)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def add(value: np.ndarray, column: int, by: int = 1) -> None:
            nonlocal size
            u, many = np.unique(value, return_counts=True)
            held.append((column, u, by * many))
            size += len(u)

        def flush() -> Iterator[pa.RecordBatch]:
            u, inv = np.unique(np.concatenate([v for _, v, _ in held]), return_inverse=True)
            column = np.concatenate([np.full(len(v), c, np.int64) for c, v, _ in held])
            table = np.bincount(column * len(u) + inv, np.concatenate([n for _, _, n in held]), len(sums) * len(u)).astype(np.int64).reshape(len(sums), len(u))
            whole = pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), *(pa.array(x) for x in table)], names=["term", *sums])
            for lo in range(0, whole.num_rows, OUT_ROWS):
                yield whole.slice(lo, OUT_ROWS)

        for batch in batches:
            for w in K.words(batch.column("text"), K.LETTER_WORDS):
                digits = np.concatenate(([0], np.cumsum((w.data >= 48) & (w.data <= 57))))
                add(w.value[digits[w.end] - digits[w.start] < w.end - w.start], 0)
                if size > HELD_TERMS:
                    yield from flush()
                    held, size = [], 0
            inside: list[np.ndarray] = []
            around: list[list[np.ndarray]] = [[] for _ in KINDS]
            for _, text in rows_with_marks(batch.column("text")):
                spans = base_spans(text)
                if spans:
                    value, start, end = terms(text, spans)
                    # What stands in a span is no term: its words are taken off again.
                    every, _, _ = terms(text, [])
                    u, n = np.unique(np.concatenate((every, value)), return_counts=True)
                    own, mine = np.unique(value, return_counts=True)
                    n[np.searchsorted(u, own)] -= 2 * mine
                    inside.append(np.repeat(u, n))
                    for i, kind in enumerate(KINDS):
                        if some := [s for s in spans if s[0] == kind]:
                            around[i].append(value[np.unique(np.concatenate(list(near(start, end, some, reach))))])
            if inside:
                add(np.concatenate(inside), 0, -1)
            for i, found in enumerate(around):
                if found:
                    add(np.concatenate(found), 1 + i)
        if held:
            yield from flush()

    fields = ", ".join(f"{c} long" for c in ["term", *sums])
    by_term = settle(rows.mapInArrow(count, fields).groupBy("term").agg(*[F.sum(c).alias(c) for c in sums]), "terms")
    total = by_term.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums]).first()
    share, general, remove = [], F.lit(0), F.lit(0)
    for i, kind in enumerate(KINDS):
        common = total[f"near_{kind}"] / total["n"] if total["n"] else 0
        if not common:
            continue
        own = (F.col(f"near_{kind}") + F.lit(prior * common)) / (F.col("n") + F.lit(prior))
        seen = F.col(f"near_{kind}") > 0
        gone = seen & (own >= common ** (1 - beta))
        share.append(F.when(seen & (own >= common ** (1 - alpha)), own))
        general = general + F.when(seen & (own >= common ** (1 - alpha)) & ~gone, 1 << i).otherwise(0)
        remove = remove + F.when(gone, 1 << i).otherwise(0)
    most = F.greatest(*share) if len(share) > 1 else share[0] if share else F.lit(None).cast("double")
    return by_term.select("term", most.alias("share"), general.cast("int").alias("general"), remove.cast("int").alias("remove")).where("share is not null")


def sanitise(docs: DataFrame, text_col: str = "text", reach: int = 4, alpha: float = 0.8, beta: float = 0.98, prior: float = 1.0, block_terms: int = 1_000_000) -> DataFrame:
    """All rows and columns of ``docs`` with spans (kind, start, end; code points; base kinds first, then term and removed) and
    clean_text (spans replaced by their label; overlapping ones by the first).

    Null counts as empty text. Disclosing terms go to the executors in blocks of ``block_terms`` (10 MB); more terms mean more
    passes, never fewer terms.
    """
    spark = docs.sparkSession
    found = settle(disclosing_terms(docs, text_col, reach, alpha, beta, prior), "disclosing")
    blocks = max(1, -(-found.count() // block_terms))
    before = f"__{uuid.uuid4().hex}"
    work, last = docs, None
    for n in range(blocks):
        part = found.where(F.pmod("term", F.lit(blocks)) == n).select("term", "general", "remove").toPandas()
        part = part.assign(term=part["term"].to_numpy(np.int64).view(np.uint64)).sort_values("term")
        held = spark.sparkContext.broadcast((part["term"].to_numpy(np.uint64), part["general"].to_numpy(np.uint8), part["remove"].to_numpy(np.uint8)))
        if blocks > 1:
            work = work.withColumnRenamed("spans", before) if n else work
            work = settle(append_columns(work, lambda b, h=held, first=n == 0: _spans(b, text_col, h.value, None if first else before), OUT[:1]).drop(before), "pii")
            if last is not None:
                discard(last)
            last = work
    if blocks > 1:
        return append_columns(work, lambda b: {"spans": b.column("spans"), "clean_text": _clean(b, text_col, b.column("spans").to_pylist())}, [OUT[1]])

    def both(batch: pa.RecordBatch) -> dict[str, list]:
        spans = _spans(batch, text_col, held.value, None)["spans"]
        return {"spans": spans, "clean_text": _clean(batch, text_col, spans)}

    return append_columns(docs, both, OUT)


def _spans(batch: pa.RecordBatch, text_col: str, disclosing: tuple[np.ndarray, np.ndarray, np.ndarray], before: str | None) -> dict[str, list]:
    out: list[list[dict]] = batch.column(before).to_pylist() if before else [[] for _ in range(batch.num_rows)]
    known, general, remove = disclosing
    for r, text in rows_with_marks(batch.column(text_col)):
        spans = base_spans(text)
        if not spans:
            continue
        if not before:
            out[r] = [{"kind": k, "start": s, "end": e} for k, s, e in spans]
        if len(known):
            here = np.uint8(sum(1 << KINDS.index(k) for k in {k for k, _, _ in spans}))
            value, start, end = terms(text, spans)
            at = np.searchsorted(known, value)
            at[at == len(known)] = 0
            same = known[at] == value
            gone = same & (remove[at] & here > 0)
            hit = gone | same & (general[at] & here > 0)
            new = [{"kind": "removed" if gone[i] else "term", "start": int(start[i]), "end": int(end[i])} for i in np.flatnonzero(hit)]
            base = [s for s in out[r] if s["kind"] in KINDS]
            out[r] = base + sorted([*(s for s in out[r] if s["kind"] not in KINDS), *new], key=lambda s: s["start"])
    return {"spans": out}


def _clean(batch: pa.RecordBatch, text_col: str, spans: list[list[dict]]) -> list[str]:
    out = []
    for text, own in zip(batch.column(text_col), spans, strict=True):
        text = text.as_py() or ""
        if own:
            parts, at = [], 0
            for s in sorted(own, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [text[at : s["start"]], LABEL[s["kind"]]]
                at = max(at, s["end"])
            text = "".join([*parts, text[at:]])
        out.append(text)
    return out
