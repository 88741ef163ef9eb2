"""Language ID with interpolated Kneser-Ney character models.

Characters are folded to 128 symbols (0: not a letter; 1-26: a-z; the other letters share the rest by a hash of their code
point), so an n-gram is an exact packed number of 7 bits a symbol and prefixes and suffixes are shifts. Counts come from the
training rows, up to a bound of letters a language that is drawn by a hash of the text, summed by Spark; the models of all
languages live in one sorted array of n-grams per order with a matrix of log probabilities beside it. A text goes to the
language of least cross-entropy per character. Rejection is calibrated in one more pass over all training rows: centre and
spread of each language's cross-entropies come from all its distinct texts, and how many spreads are too many from the texts
that were left out of the counts, at a stated rate of false rejections.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as K
from .common import append_columns, no_text, shielded

BITS, SYMBOLS, PAD = 7, 128, 4
#: Cross-entropies are counted in this many classes a bit; a language of fewer distinct texts than LEAST takes wide bounds.
CLASSES, LEAST = 1024, 20
#: Spreads beyond which a text is rejected where too few texts were left out to tell: wide, so that clean texts stay.
WIDE = 12.0
#: The tail of distances is what this share of texts is beyond; so many texts stand for what isn't known of it.
TAIL, PRIOR = 0.1, 10.0
OUT = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("cross_entropy", T.DoubleType()),
    T.StructField("rejected", T.BooleanType()),
]
_FOLD: list[np.ndarray] = []


def fold_table() -> np.ndarray:
    """Code point to symbol, case folded."""
    if not _FOLD:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if 0xD800 <= c < 0xE000:
                continue
            ch = chr(c)
            if ch.isalpha():
                low = ord(ch.lower()[0])
                table[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SYMBOLS - 27)
        _FOLD.append(table)
    return _FOLD[0]


def symbols(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, symbols, starts, lengths) of chunks: runs of other characters are one boundary, PAD boundaries part the rows."""
    raw, at = K.rows_of(col)
    table = fold_table()
    for lo, hi in K.chunks(at):
        own = raw[at[lo] : at[hi]]
        code = np.frombuffer(own.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        # Where each row starts, in characters: bytes that don't continue a character.
        ptr = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))[at[lo : hi + 1] - at[lo]]
        s = table[code]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        keep[ptr[:-1][ptr[:-1] < len(s)]] = True
        kept = np.concatenate(([0], np.cumsum(keep)))[ptr]
        n = hi - lo
        length = np.diff(kept)
        out = np.zeros(kept[-1] + PAD * (n + 1), np.uint8)
        out[np.arange(kept[-1]) + np.repeat(PAD * np.arange(1, n + 1), length)] = s[keep]
        yield n, out, kept[:-1] + PAD * np.arange(1, n + 1), length


def packed(s: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each position (from order - 1 on)."""
    out = s[: len(s) - order + 1].astype(np.uint32)
    for j in range(1, order):
        out = (out << np.uint32(BITS)) | s[j : len(s) - order + 1 + j]
    return out


def gram_counts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): occurrences of n-grams of the highest order, combined in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def closed(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held[lang]])
            n = np.concatenate([c for _, c in held[lang]])
            u, inv = np.unique(keys, return_inverse=True)
            return u, np.bincount(inv, n, len(u)).astype(np.int64)

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                mine = batch.column("text").filter(pa.array([x == lang for x in langs]))
                for _, s, _, _ in symbols(mine):
                    grams = packed(s, order)
                    held.setdefault(lang, []).append(np.unique(grams[grams > 0], return_counts=True))
                if len(held.get(lang, ())) > 32:
                    held[lang] = [closed(lang)]
        for lang in held:
            keys, n = closed(lang)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    order: int
    #: Per order 1..n: sorted n-grams, log2 probabilities (n-grams x languages).
    keys: list[np.ndarray]
    logp: list[np.ndarray]
    #: Per order 2..n: sorted contexts and log2 back-off weights.
    ctx: list[np.ndarray]
    back: list[np.ndarray]
    #: Per language: mean and spread of the cross-entropy of its training texts.
    mean: np.ndarray
    spread: np.ndarray
    #: Spreads beyond which a text is rejected.
    z: float = WIDE


def fit_counts(langs: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]], order: int) -> Model:
    """Interpolated Kneser-Ney: raw counts at the highest order, numbers of distinct left neighbours below."""
    tables: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(order)]
    for lang in langs:
        keys, n = grams[lang]
        for o in range(order, 0, -1):
            tables[o - 1].append((keys, n))
            if o > 1:
                short, inv = np.unique(keys & ((1 << BITS * (o - 1)) - 1), return_inverse=True)
                keys, n = short, np.bincount(inv, minlength=len(short))
    all_keys = [np.unique(np.concatenate([k for k, _ in t])) for t in tables]
    logp, ctxs, backs, lower = [], [], [], None
    for o in range(1, order + 1):
        keys = all_keys[o - 1]
        prob = np.zeros((len(keys), len(langs)))
        ctx_all = np.unique(keys >> BITS)
        back = np.ones((len(ctx_all), len(langs)))
        for j, (k, n) in enumerate(tables[o - 1]):
            n = n.astype(float)
            once, twice = (n == 1).sum(), (n == 2).sum()
            d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
            ctx, inv = np.unique(k >> BITS, return_inverse=True)
            total, kinds = np.bincount(inv, n), np.bincount(inv)
            at = np.searchsorted(ctx_all, ctx)
            back[at, j] = d * kinds / total
            prob[np.searchsorted(keys, k), j] = (n - d) / total[inv]
        at = np.searchsorted(ctx_all, keys >> BITS)
        if o == 1:
            prob += back[at] / SYMBOLS
        else:
            prob += back[at] * lower[np.searchsorted(all_keys[o - 2], keys & ((1 << BITS * (o - 1)) - 1))]
        lower = prob
        logp.append(np.log2(prob).astype(np.float32))
        ctxs.append(ctx_all)
        backs.append(np.log2(back).astype(np.float32))
    return Model(langs, order, all_keys, logp, ctxs, backs, np.zeros(len(langs)), np.ones(len(langs)))


def _find(keys: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """Places in the sorted array, -1 where absent."""
    at = np.searchsorted(keys, ask)
    at[at == len(keys)] = 0
    return np.where(keys[at] == ask, at, -1)


def gram_logp(model: Model, grams: np.ndarray, order: int | None = None) -> np.ndarray:
    """log2 probabilities (n-grams x languages), backed off where an n-gram is unknown."""
    o = order or model.order
    at = _find(model.keys[o - 1], grams)
    out = model.logp[o - 1][at]
    gone = np.flatnonzero(at < 0)
    if len(gone):
        g = grams[gone]
        c = _find(model.ctx[o - 1], g >> BITS)
        weight = np.where(c[:, None] >= 0, model.back[o - 1][c], np.float32(0))
        out[gone] = weight + (gram_logp(model, g & ((1 << BITS * (o - 1)) - 1), o - 1) if o > 1 else np.float32(-math.log2(SYMBOLS)))
    return out


def cross_entropies(model: Model, col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bits per symbol for rows x languages, letters of each row), chunk by chunk."""
    for n, s, start, length in symbols(col):
        run = np.zeros((len(s) + 1, len(model.langs)))
        lp = gram_logp(model, packed(s, model.order))
        np.cumsum(lp, axis=0, out=run[model.order :], dtype=np.float64)
        seen = np.concatenate(([0], np.cumsum(s > 0)))
        end = start + length + 1
        yield -(run[end] - run[start]) / (length + 1)[:, None], seen[start + length] - seen[start]


def _wider(letters: np.ndarray) -> np.ndarray:
    """Short texts vary more."""
    return np.maximum(1, np.sqrt(200 / np.maximum(letters, 1)))


def predict(model: Model, col: pa.Array, z: float | None = None) -> dict[str, pa.Array]:
    names = pa.array([*model.langs, "und"])
    out: dict[str, list] = {"lang_pred": [], "score": [], "cross_entropy": [], "rejected": []}
    for bits, letters in cross_entropies(model, col):
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(bits)), best]
        # Posterior of the best language, with the evidence of at most 64 symbols so that it stays graded.
        odds = np.exp2(-(bits - least[:, None]) * np.minimum(64, np.maximum(letters, 1))[:, None])
        over = least > model.mean[best] + (model.z if z is None else z) * model.spread[best] * _wider(letters)
        none = letters == 0
        out["lang_pred"].append(names.take(pa.array(np.where(none, len(model.langs), best))))
        out["score"].append(pa.array(np.where(none, 0.0, 1 / odds.sum(axis=1))))
        out["cross_entropy"].append(pa.array(least, mask=none))
        out["rejected"].append(pa.array(over | none))
    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "cross_entropy": pa.float64(), "rejected": pa.bool_()}
    return {k: pa.chunked_array(v, kinds[k]).combine_chunks() for k, v in out.items()}


def _bounds(model: Model, rows: DataFrame, rate: float) -> None:
    """Sets mean and spread from all distinct training texts of at least 50 letters, and z from those of them that were left out
    of the counts, so that about a share ``rate`` of such texts would be rejected (``tail_bound``).

    A language of fewer than LEAST such texts says little about texts it wasn't fitted on: it takes the median bounds of the
    other languages, or its own where they are wider. If no language has enough, no text with letters is rejected.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {x: j for j, x in enumerate(held.value.langs)}
        for batch in batches:
            at, lang = 0, np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            use, bits, wide = [], [], []
            for b, letters in cross_entropies(held.value, batch.column("text")):
                own = lang[at : at + len(b)]
                some = np.flatnonzero((letters >= 50) & (own >= 0))
                use.append(at + some)
                bits.append(np.floor(b[some, own[some]] * CLASSES).astype(np.int64))
                wide.append(np.ceil(10 * _wider(letters[some])).astype(np.int64))
                at += len(b)
            if use:
                use = pa.array(np.concatenate(use))
                yield pa.RecordBatch.from_arrays([pa.array(lang).take(use), batch.column("mark").take(use), batch.column("out").take(use), pa.array(np.concatenate(bits)), pa.array(np.concatenate(wide))], names=["lang", "mark", "out", "bits", "wide"])

    # Copies meet by a hash of the text, combined in each task before the shuffle; then only counts of classes are left.
    each = rows.mapInArrow(seen, "lang long, mark long, out boolean, bits long, wide long").groupBy("lang", "mark").agg(F.min("bits").alias("bits"), F.min("wide").alias("wide"), F.max("out").alias("out"))
    got = each.groupBy("lang", "bits", "wide", "out").count().toPandas().sort_values("bits")
    held.unpersist()
    total = np.zeros(len(model.langs), np.int64)
    for j, mine in got.groupby("lang"):
        upto = mine["count"].to_numpy().cumsum()
        total[j] = upto[-1]
        low, mid, high = (mine["bits"].to_numpy()[np.searchsorted(upto, q * upto[-1])] / CLASSES for q in (0.25, 0.5, 0.75))
        model.mean[j], model.spread[j] = mid + 0.5 / CLASSES, max((high - low) / 1.35, 0.05)
    known = total >= LEAST
    mean, spread = (np.median(model.mean[known]), np.median(model.spread[known])) if known.any() else (math.log2(SYMBOLS), 1.0)
    for j in np.flatnonzero(~known):
        own = (model.mean[j], model.spread[j]) if total[j] else (0.0, 0.0)
        model.mean[j], model.spread[j] = max(mean, own[0]), max(spread, own[1])
    left = got[got["out"]]
    lang = left["lang"].to_numpy()
    far = (left["bits"].to_numpy() / CLASSES - model.mean[lang]) / model.spread[lang] * 10 / left["wide"].to_numpy()
    model.z = tail_bound(far, left["count"].to_numpy(), rate)


def tail_bound(far: np.ndarray, n: np.ndarray, rate: float) -> float:
    """Spreads that a share ``rate`` of texts passes, from n texts at each distance: one rule at every number of texts.

    The tail beyond the distance that TAIL of the texts pass is taken as exponential. PRIOR texts of a wide tail (WIDE at a rate
    of 1e-4) stand for what isn't known, and the mean excess is raised by two standard errors, so the bound is wide with no text
    and tightens with their number, without a step.
    """
    order = np.argsort(far)
    far, n = far[order], n[order]
    total = n.sum()
    slope, edge = (WIDE - 2.0) / math.log(TAIL / 1e-4) / (1 + 2 / math.sqrt(PRIOR)), 2.0
    k, excess = 0.0, 0.0
    if total:
        own = far[np.searchsorted(n.cumsum(), (1 - TAIL) * total)]
        over = far > own
        k, excess = float(n[over].sum()), float((n[over] * (far[over] - own)).sum())
        edge = (PRIOR * edge + k * own) / (PRIOR + k)
    slope = (PRIOR * slope + excess) / (PRIOR + k) * (1 + 2 / math.sqrt(PRIOR + k))
    return max(1.0, edge + slope * math.log(max(1.0, TAIL / rate)))


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", order: int = 4, max_letters: int = 32 << 20, max_total: int = 256 << 20, rate: float = 1e-4) -> Model | None:
    """order: up to PAD. Learn from the rows that ``train`` keeps and whose language is not null; None if there is none.

    Equal texts of a language count once, at every size. Of each language about an eighth of the texts, drawn by a hash of the text,
    is left out of the counts, and if what is left has more than ``max_letters`` characters, or its part of ``max_total`` for all
    languages, about so many are counted; this bounds the tables of n-grams that are gathered. The text of least hash, if it
    isn't empty, is always counted. rate: the share of texts left out that the calibrated bounds would reject.
    """
    rows = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), no_text(F.col(text_col)).alias("text")).where("lang <> 'und'")
    marked = rows.withColumn("mark", F.xxhash64("text")).withColumn("draw", F.pmod(F.xxhash64("mark"), F.lit(1 << 20)))
    texts = marked.groupBy("lang", "mark").agg(F.max(F.length("text")).alias("size"), F.max("draw").alias("draw"))
    sizes = [tuple(r) for r in texts.groupBy("lang").agg(F.sum("size"), F.coalesce(F.min(F.when(F.col("size") > 0, F.col("draw"))), F.lit(0))).collect()]
    if not sizes:
        return None
    most = min(max_letters, max_total // len(sizes))
    share = {x: max(int((1 << 20) * min(0.875, most / max(1, size))), first + 1) for x, size, first in sizes}
    keep = F.try_element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col("lang"))
    marked = marked.withColumn("out", F.coalesce(F.col("draw") >= keep, F.lit(True))).drop("draw")
    counted = marked.where(~F.col("out")).dropDuplicates(["lang", "mark"])
    got = gram_counts(counted.select("lang", "text"), order).toPandas()
    langs = sorted(x for x in got["lang"].unique() if x != "und")
    if not langs:
        return None
    grams = {}
    for lang in langs:
        mine = got[got["lang"] == lang].sort_values("gram")
        grams[lang] = (mine["gram"].to_numpy(np.int64).astype(np.uint32), mine["n"].to_numpy(np.int64))
    model = fit_counts(langs, grams, order)
    _bounds(model, marked, rate)
    return model


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", z: float | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred, score (0 to 1), cross_entropy (bits a symbol) and rejected.

    z: spreads beyond which a text is rejected, if not those of the model. Null texts and texts without letters are ``und``,
    score 0, rejected; so is every text if nothing was learnt. Ties between languages go to the first by name. Rejected texts
    with letters keep their best language.
    """
    return shielded(docs, [text_col], [f.name for f in OUT], lambda d: _identify(d, model, text_col, z))


def _identify(docs: DataFrame, model: Model | None, text_col: str, z: float | None) -> DataFrame:
    if model is None:
        return append_columns(docs, lambda b: {"lang_pred": ["und"] * b.num_rows, "score": [0.0] * b.num_rows, "cross_entropy": [None] * b.num_rows, "rejected": [True] * b.num_rows}, OUT)
    held = docs.sparkSession.sparkContext.broadcast(model)
    return append_columns(docs, lambda b: predict(held.value, b.column(text_col), z), OUT)
