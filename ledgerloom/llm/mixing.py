"""Mixing sources to target weights by iterative proportional fitting.

One aggregate gives the tokens of every (source, language, topic) cell. Raking scales the cells until their sums meet the
target marginals of all three dimensions; the ratio of raked to present tokens is a cell's weight, and one common factor,
with a ceiling of 1, turns weights into inclusion probabilities whose expected tokens meet the budget. A document is drawn
if a hash of its id and text lies below its probability, so a run can be repeated and a lost task gives the same rows again.

Raking goes in blocks: the largest dimension is scaled to its targets, then the table of the other two, summed over it, is
raked in itself; so however many cells there are, each round takes one sum over them and the driver holds that small
table alone. Rounds end at one tolerance, wherever the cells lie; targets that can't be met are reported as ``raking_error``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, discard, no_text, settle, shielded
from .topics import Topics, vectors
from .topics import fit as fit_topics

#: Cells up to this many are summed on the driver (some MB), more by Spark; the rounds are the same.
MAX_CELLS = 100_000
#: Raking ends when no marginal is off by more than this. Targets that can't be met end it, too: once so many rounds in
#: succession have not brought the error down by a tenth.
TOLERANCE, PATIENCE = 1e-10, 100
#: Combinations of the two smaller dimensions that the driver will hold.
MOST_PAIRS = 1_000_000
DIMS = ["source", "lang", "topic"]
NONE = "∅"
MARKS = [T.StructField("topic", T.StringType()), T.StructField("n_tokens", T.LongType())]


def with_topics(docs: DataFrame, topics: int = 8, text_col: str = "text", model: Topics | None = None) -> DataFrame:
    """Adds topic (t0..) and n_tokens: the nearest of at most ``topics`` clusters of the texts (``topics.fit``), or of ``model``'s.
    A text without words has topic ``t0``. Null text has no words. Each language is clustered about its own mean."""
    model = model or fit_topics(_named(docs, text_col), topics, ["__lang"])[0]
    if model is None:
        return append_columns(docs, lambda b: {"topic": ["t0"] * b.num_rows, "n_tokens": [0] * b.num_rows}, MARKS)
    held = docs.sparkSession.sparkContext.broadcast(model)
    lang = docs.columns[[c.lower() for c in docs.columns].index("lang")] if "lang" in [c.lower() for c in docs.columns] else None

    def mark(batch: pa.RecordBatch) -> dict[str, list]:
        x, n = vectors(held.value.words, batch.column(text_col))
        langs = [NONE] * batch.num_rows if lang is None else [NONE if v is None else str(v) for v in batch.column(lang).to_pylist()]
        at = held.value.assign(x, langs)
        return {"topic": [f"t{i}" if many else "t0" for i, many in zip(at, n, strict=True)], "n_tokens": n.tolist()}

    return append_columns(docs, mark, MARKS)


def _named(docs: DataFrame, text_col: str) -> DataFrame:
    """text and the dimensions that are given, as texts."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) if c in [x.lower() for x in docs.columns] else F.lit(NONE)
    return docs.select(no_text(F.col(text_col)).alias("text"), name("source").alias("__source"), name("lang").alias("__lang"))


def smoothed(tokens: dict[str, float], power: float) -> dict[str, float]:
    """Target shares in proportion to tokens ** power: 1 keeps the mix, 0 makes it even."""
    raised = {k: v**power for k, v in tokens.items() if v > 0}
    total = sum(raised.values()) or 1.0
    return {k: v / total for k, v in raised.items()}


def _scaled(table: np.ndarray, targets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Factors of the rows and columns of a table after raking it to both targets, from the factors given."""
    columns = np.where(targets[1] > 0, columns, 0.0)
    for _ in range(1000):
        sums = table @ columns
        rows = np.divide(targets[0], sums, out=np.zeros_like(sums), where=sums > 0)
        sums = rows @ table
        off = float(np.abs(columns * sums - targets[1])[sums > 0].max(initial=0))
        columns = np.divide(targets[1], sums, out=np.zeros_like(sums), where=sums > 0)
        if off < tolerance / 10:
            break
    return rows, columns


def fit_factors(sums: Callable[[np.ndarray], np.ndarray], targets: list[np.ndarray], rounds: int = PATIENCE, tolerance: float = TOLERANCE) -> tuple[np.ndarray, float]:
    """(factors of the pairs of the two smaller dimensions, largest error of a marginal).

    sums: given such factors, the tokens of each pair, every value of the largest dimension being scaled to its own target.
    rounds: how many rounds without progress end it; there is no other end but the tolerance.
    """
    rows, columns = np.ones(len(targets[0])), np.ones(len(targets[1]))
    best, least, waited, kept, seen = np.inf, np.inf, 0, None, []
    while True:
        pairs = np.outer(rows, columns)
        table = sums(pairs)
        now = table * pairs
        off = max(float(np.abs(m - t).max(initial=0)) for m, t in ((now.sum(1), targets[0]), (now.sum(0), targets[1])))
        if off < least:
            least, kept = off, pairs
        best, waited = (off, 0) if off < best * 0.9 else (best, waited + 1)
        if off < tolerance or waited >= rounds:
            return kept, least
        after = _scaled(table, targets, rows, columns, tolerance)
        if off > 10 * least:
            seen = []
        rows, columns = _extrapolated(seen, (rows, columns), after)


def _extrapolated(seen: list[tuple[np.ndarray, np.ndarray]], before: tuple[np.ndarray, np.ndarray], after: tuple[np.ndarray, np.ndarray], most: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """The factors that the last rounds point to (Anderson's method on their logarithms); ``seen`` holds (factors, step) of those."""
    used = [(b > 0) & (a > 0) for b, a in zip(before, after, strict=True)]
    scale = [x[1][used[1]].max(initial=1e-300) for x in (before, after)]
    x, y = (np.log(np.concatenate((f[0][used[0]] * c, f[1][used[1]] / c))) for f, c in zip((before, after), scale, strict=True))
    if seen and len(seen[0][0]) != len(x):
        seen.clear()
    seen.append((x, y - x))
    del seen[:-most]
    if len(seen) > 1:
        dx, df = (np.diff(np.array([s[i] for s in seen]), axis=0).T for i in (0, 1))
        y = y - (dx + df) @ np.linalg.lstsq(df, y - x, rcond=1e-10)[0]
    out = [np.zeros_like(a) for a in after]
    y = np.exp(np.clip(y, -500, 500))
    out[0][used[0]], out[1][used[1]] = y[: used[0].sum()], y[used[0].sum() :]
    return out[0], out[1]


def rake(codes: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], rounds: int = PATIENCE, tolerance: float = TOLERANCE) -> np.ndarray:
    """codes: cells x dimensions; targets: one array of shares per dimension. Shares of cells after raking, sum 1."""
    first, *others = _by_size(targets)
    size = [len(targets[d]) for d in others]
    pair = codes[:, others[0]] * size[1] + codes[:, others[1]]

    def scale(pairs: np.ndarray) -> np.ndarray:
        now = np.bincount(codes[:, first], tokens * pairs.ravel()[pair], len(targets[first]))
        return np.divide(targets[first], now, out=np.zeros_like(now), where=now > 0)[codes[:, first]]

    pairs, _ = fit_factors(lambda x: np.bincount(pair, tokens * scale(x), size[0] * size[1]).reshape(size), [targets[d] for d in others], rounds, tolerance)
    share = tokens * scale(pairs) * pairs.ravel()[pair]
    return share / max(share.sum(), 1e-300)


def raking_error(codes: np.ndarray, share: np.ndarray, targets: list[np.ndarray]) -> float:
    return max(float(np.abs(np.bincount(codes[:, d], share, len(t)) - t).max(initial=0)) for d, t in enumerate(targets))


def _by_size(targets: list[np.ndarray]) -> list[int]:
    """The dimensions, the one with the most values first."""
    order = sorted(range(len(targets)), key=lambda d: -len(targets[d]))
    if len(targets[order[1]]) * len(targets[order[2]]) > MOST_PAIRS:
        raise ValueError(f"two dimensions have more than {MOST_PAIRS} combinations: {[len(t) for t in targets]} values")
    return order


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * weight) with expected tokens of the budget (all cells with weight, if it is larger)."""
    order = np.argsort(-weight, kind="stable")
    w, t = weight[order], tokens[order]
    if budget >= t[w > 0].sum():
        return (weight > 0).astype(float)
    full = np.concatenate(([0.0], np.cumsum(t)))[:-1]
    rest = np.cumsum((w * t)[::-1])[::-1]
    some = int((rest > 0).sum())
    c = (budget - full[:some]) / rest[:some]
    # The first cell that stays below 1 when all before it are at 1.
    at = int(np.argmax(c * w[:some] <= 1))
    return np.minimum(1.0, c[at] * weight)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.7, keep: float = 0.8, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with topic, n_tokens, weight, probability, selected and raking_error.

    targets: shares per dimension (source, lang, topic) and value; a dimension without any gets its present token shares to
    the ``power``. Values without a target get none of the budget; targets of absent values are spread over the others.
    keep: the budget, as a share of all tokens. Null source or language is a value of its own. Documents without words have
    no tokens to weigh: weight 1, always selected. Repeated rows are drawn alike. raking_error: the largest gap that is left
    between a target share and the raked one, over 1e-10 only if the targets can't be met together. source and lang count in any
    case of their names; columns of any other name may be there, those of the names of new ones are replaced.
    """
    new = ["topic", "n_tokens", "weight", "probability", "selected", "raking_error"]
    return shielded(docs, [id_col, text_col, "source", "lang"], new, lambda d: _mix(d, targets, power, keep, seed, id_col, text_col))


def _mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None, power: float, keep: float, seed: str, id_col: str, text_col: str) -> DataFrame:
    model, cells = fit_topics(_named(docs, text_col), 8, ["__source", "__lang"])
    marked = with_topics(docs, text_col=text_col, model=model)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) if c in marked.columns else F.lit(NONE)
    keyed = marked.select("*", *[name(d).alias(f"__{d}") for d in DIMS])
    # Documents without words belong to no cell; their ids keep them apart in a shuffle.
    keyed = keyed.withColumn("__topic", F.when(F.col("n_tokens") > 0, F.col("__topic")).otherwise(F.concat(F.lit(NONE), F.col(id_col).cast("string"))))
    cells = cells.groupBy(*[f"__{d}" for d in DIMS]).agg(F.sum("n_tokens").alias("tokens"))
    rated = _cell_table(cells, targets or {}, power, keep)
    out = keyed.join(rated, [f"__{d}" for d in DIMS], "left")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    out = out.withColumn("weight", F.coalesce("__w", F.lit(1.0))).withColumn("probability", F.coalesce("__p", F.lit(1.0))).withColumn("raking_error", F.coalesce("__e", F.lit(0.0)))
    out = out.withColumn("selected", draw < F.col("probability"))
    return out.drop(*[f"__{d}" for d in DIMS], "__w", "__p", "__e")


SCHEMA = "__source string, __lang string, __topic string, __w double, __p double, __e double"


def _cell_table(cells: DataFrame, targets: dict[str, dict[str, float]], power: float, keep: float) -> DataFrame:
    spark = cells.sparkSession
    first = cells.limit(MAX_CELLS + 1).toPandas().sort_values([f"__{d}" for d in DIMS], ignore_index=True)
    if len(first) > MAX_CELLS:
        return _rake_by_spark(cells, targets, power, keep)
    if not len(first):
        return spark.createDataFrame([], SCHEMA)
    tokens = first["tokens"].to_numpy(float)
    codes, shares = np.zeros((len(first), 3), int), []
    for d, dim in enumerate(DIMS):
        values, codes[:, d] = np.unique(first[f"__{dim}"].to_numpy(str), return_inverse=True)
        shares.append(_shares(values.tolist(), np.bincount(codes[:, d], tokens), targets.get(dim), power))
    share = rake(codes, tokens, shares)
    weight = share * tokens.sum() / tokens
    first["__w"], first["__p"], first["__e"] = weight, calibrate(tokens, weight, keep * tokens.sum()), raking_error(codes, share, shares)
    rows = first[["__source", "__lang", "__topic", "__w", "__p", "__e"]]
    return F.broadcast(spark.createDataFrame(rows, SCHEMA))


def _shares(values: list[str], tokens: np.ndarray, target: dict[str, float] | None, power: float) -> np.ndarray:
    target = target or smoothed(dict(zip(values, tokens.tolist(), strict=True)), power)
    share = np.array([float(target.get(v, 0.0)) for v in values])
    return share / max(share.sum(), 1e-300)


def _rake_by_spark(cells: DataFrame, targets: dict[str, dict[str, float]], power: float, keep: float, rounds: int = PATIENCE, tolerance: float = TOLERANCE) -> DataFrame:
    """The same for any number of cells. The dimension with the most values stays in the table, one row for each of its values
    with its cells as lists; a round is one pass over that table with the factors of the pairs sent along. The cells that are
    drawn in full are found by bisection, the common factor of the others follows from them."""
    spark = cells.sparkSession
    cells = settle(cells, "cells")
    counts = [cells.agg(F.count_distinct(f"__{d}")).first()[0] for d in DIMS]
    order = sorted(range(3), key=lambda d: -counts[d])
    if counts[order[1]] * counts[order[2]] > MOST_PAIRS:
        raise ValueError(f"two dimensions have more than {MOST_PAIRS} combinations: {counts} values")
    main, (left, right) = f"__{DIMS[order[0]]}", (f"__{DIMS[d]}" for d in order[1:])
    total = float(cells.agg(F.sum("tokens")).first()[0])

    places, wanted = [], []
    for key in (left, right):
        found = sorted((r[0], float(r[1])) for r in cells.groupBy(key).agg(F.sum("tokens")).collect())
        wanted.append(_shares([v for v, _ in found], np.array([n for _, n in found]), targets.get(key[2:]), power))
        places.append(spark.createDataFrame([(v, i) for i, (v, _) in enumerate(found)], f"{key} string, at_{key[2:]} int"))
    size = [len(t) for t in wanted]
    sums = cells.groupBy(main).agg(F.sum("tokens").alias("n"))
    if given := targets.get(main[2:]):
        goal = sums.join(spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{main} string, t double"), main, "left").select(main, F.coalesce("t", F.lit(0.0)).alias("t"))
    else:
        goal = sums.select(main, F.pow(F.col("n").cast("double"), F.lit(power)).alias("t"))
    whole = goal.agg(F.sum("t")).first()[0] or 1.0
    placed = cells.join(F.broadcast(places[0]), left).join(F.broadcast(places[1]), right).withColumn("pair", F.col(f"at_{left[2:]}") * size[1] + F.col(f"at_{right[2:]}"))
    lists = placed.groupBy(main).agg(F.collect_list(F.struct("pair", F.col("tokens").cast("double").alias("tokens"))).alias("c"))
    rows = settle(lists.join(goal, main).select(main, (F.col("t") / F.lit(whole)).alias("t"), F.col("c.pair").alias("pair"), F.col("c.tokens").alias("tokens")), "values")

    def summed(pairs: np.ndarray) -> np.ndarray:
        held = spark.sparkContext.broadcast(pairs.ravel())

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(size[0] * size[1])
            for batch in batches:
                pair, tokens, factor = _scaled_rows(batch, held.value)
                np.add.at(out, pair, tokens * factor)
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["pair", "n"])

        out = np.zeros(size[0] * size[1])
        for pair, n in rows.drop(main).mapInArrow(add, "pair long, n double").groupBy("pair").agg(F.sum("n")).collect():
            out[pair] = n
        held.unpersist()
        return out.reshape(size)

    pairs, error = fit_factors(summed, wanted, rounds, tolerance)
    held = spark.sparkContext.broadcast(pairs.ravel())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, tokens, factor = _scaled_rows(batch, held.value)
            n = np.diff(batch.column("pair").offsets.to_numpy())
            name = batch.column(main).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([name, pa.array(pair.astype(np.int32)), pa.array(tokens), pa.array(total * factor * held.value[pair])], names=[main, "pair", "tokens", "__w"])

    rated = rows.mapInArrow(weigh, f"{main} string, pair int, tokens double, __w double")
    whole = rated.agg(F.sum(F.col("tokens") * F.col("__w"))).first()[0] or 1.0
    rated = rated.withColumn("__w", F.col("__w") * F.lit(total / whole))
    names = [p.withColumnRenamed(f"at_{k[2:]}", "at") for p, k in zip(places, (left, right), strict=True)]
    rated = rated.withColumn("at", F.floor(F.col("pair") / size[1]).cast("int")).join(F.broadcast(names[0]), "at").drop("at")
    rated = rated.withColumn("at", F.col("pair") % size[1]).join(F.broadcast(names[1]), "at").drop("at")
    rated = settle(rated.select(*[f"__{d}" for d in DIMS], "tokens", "__w"), "rated")
    discard(cells, rows)
    keys = [F.col(f"__{d}") for d in DIMS]
    weighed = rated.where(F.col("__w") > 0)
    most, product, least = weighed.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("__w")), F.min("__w")).first()
    budget = keep * total
    if budget >= (most or 0):
        return rated.select(*keys, "__w", F.when(F.col("__w") > 0, 1.0).otherwise(0.0).alias("__p"), F.lit(error).alias("__e"))

    def drawn(c: float) -> tuple[int, float, float]:
        """With the factor c: number and tokens of the cells that are drawn in full, sum of tokens times weight of the others."""
        full = F.lit(c) * F.col("__w") >= 1
        return tuple(weighed.agg(F.count_if(full), F.sum(F.when(full, F.col("tokens")).otherwise(0)).cast("double"), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("__w")))).first())

    low, high = budget / product, 1 / least
    few, many = drawn(low), drawn(high)
    while few[0] != many[0] and low < (mid := low**0.5 * high**0.5) < high:
        now_drawn = drawn(mid)
        if now_drawn[1] + mid * now_drawn[2] < budget:
            low, few = mid, now_drawn
        else:
            high, many = mid, now_drawn
    c = (budget - few[1]) / few[2] if few[2] > 0 else high
    return rated.select(*keys, "__w", F.least(F.lit(1.0), F.lit(c) * F.col("__w")).alias("__p"), F.lit(error).alias("__e"))


def _scaled_rows(batch: pa.RecordBatch, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs and tokens of the cells of a batch, and the factor that scales each cell's row to the row's target."""
    pair = batch.column("pair").flatten().to_numpy()
    tokens = batch.column("tokens").flatten().to_numpy()
    n = np.diff(batch.column("pair").offsets.to_numpy())
    row = np.repeat(np.arange(len(n)), n)
    now = np.bincount(row, tokens * pairs[pair], len(n))
    return pair, tokens, np.divide(batch.column("t").to_numpy(), now, out=np.zeros_like(now), where=now > 0)[row]
