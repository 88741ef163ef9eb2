"""Hard-negative mining over a GNAT-style tree: multiway hyperplane splits with distance ranges between siblings.

Vectors are lifted by one coordinate to one common norm, so that a larger inner product is a smaller Euclidean distance to the
(unlifted) query, and a window of scores is an annulus about it. Each node of the tree has some split points; a row goes to the
subtree of the nearest. Split points come from a bounded sample, but every row is routed, and each split point stores the
range of its distances to all rows of every sibling subtree. A query's annulus is moved by its distance to a split point;
siblings whose range it doesn't meet are out. What is left is compared exactly with the rows of the leaf.

Leaves are dealt in blocks of bounded size by a hash of the row, queries in blocks of bounded size too; a task holds one of
each. A hot vector is many blocks of one leaf. Only the tree, its ranges and the sizes of its leaves are sent to all: they
are bounded by ``fanout`` and ``sample``. No row is dropped by the index: results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle

#: Rows of a leaf, and queries, that meet in one task.
BLOCK, QUERIES = 20_000, 8_000
#: Distances are doubles; ranges are widened by so much of the common norm.
SLACK = 1e-6


@dataclass
class Tree:
    """Two levels of split points: ``roots`` (k x d + 1) and, for each, ``leaves[i]``; ``lift`` is the squared common norm."""

    roots: np.ndarray
    leaves: list[np.ndarray]
    lift: float

    @property
    def first(self) -> np.ndarray:
        """Number of each root's first leaf."""
        return np.concatenate([[0], np.cumsum([len(x) for x in self.leaves])]).astype(np.int64)


def quantised(rows: DataFrame, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Rows that take part: id, label and vector present, no component null, infinite or not a number; components become floor(scale * x)."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).where(fine)
    scaled = F.transform(vector, lambda x: F.lit(scale) * x.cast("double"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), scaled.alias("vec"))
    # floor() gives longs; doubles from 2**53 on are whole anyway.
    return rows.withColumn("vec", F.transform("vec", lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow list column as rows; shorter ones are filled up by zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()]
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def lifted(x: np.ndarray, lift: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(lift - (x * x).sum(1), 0))])


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(square, 0))


def _spread(points: np.ndarray, k: int) -> np.ndarray:
    """At most k split points, each the farthest from those before it."""
    chosen, far = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def fit(rows: DataFrame, fanout: int, sample: int) -> tuple[Tree | None, int]:
    """The tree, from at most ``sample`` rows (those of least hash), and the number of dimensions; None if there are no rows."""
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    lift, dims = rows.agg(F.max(norm), F.max(F.size("vec"))).first()
    if lift is None:
        return None, 0
    held = rows.orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(sample).select("vec").toArrow().column(0).combine_chunks()
    points = lifted(matrix(held, dims), lift)
    roots = _spread(points, fanout)
    near = distances(points, roots).argmin(1)
    return Tree(roots, [_spread(points[near == i], fanout) if (near == i).any() else roots[i : i + 1] for i in range(len(roots))], lift), dims


def _route(tree: Tree, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Root and leaf (numbered across roots) of each lifted row."""
    root = distances(x, tree.roots).argmin(1)
    leaf = np.zeros(len(x), np.int64)
    for i in np.unique(root).tolist():
        at = root == i
        leaf[at] = tree.first[i] + distances(x[at], tree.leaves[i]).argmin(1)
    return root, leaf


def index(rows: DataFrame, tree: Tree, dims: int) -> DataFrame:
    """Every row with its leaf and a mark of its vector."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, leaf = _route(shared.value, lifted(matrix(batch.column("vec"), dims), shared.value.lift))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf.astype(np.int32))], names=[*batch.schema.names, "leaf"])

    marked = rows.select("vec_id", "label", "vec", F.xxhash64("vec").alias("mark"))
    return marked.mapInArrow(run, "vec_id long, label long, vec array<double>, mark long, leaf int")


@dataclass
class Ranges:
    """[i, j]: least and greatest distance of split point i to the rows of sibling j, for the roots and within each root; no
    rows give (inf, -inf)."""

    roots: np.ndarray
    leaves: list[np.ndarray]


def ranges(rows: DataFrame, tree: Tree, dims: int) -> Ranges:
    """Over all rows: a task keeps one table of distances for each node, and these meet by node."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def empty(k: int) -> np.ndarray:
        return np.stack([np.full((k, k), np.inf), np.full((k, k), -np.inf)])

    def widen(table: np.ndarray, far: np.ndarray, child: np.ndarray) -> None:
        np.minimum.at(table[0].T, child, far)
        np.maximum.at(table[1].T, child, far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        held = {-1: empty(len(t.roots))}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, leaf = lifted(matrix(batch.column("vec"), dims), t.lift), batch.column("leaf").to_numpy()
            root = np.searchsorted(t.first, leaf, "right") - 1
            widen(held[-1], distances(x, t.roots), root)
            for i in np.unique(root).tolist():
                at = root == i
                widen(held.setdefault(i, empty(len(t.leaves[i]))), distances(x[at], t.leaves[i]), leaf[at] - t.first[i])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["node", "table"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for node, table in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(table).reshape(2, -1)
                held[node] = np.stack([np.minimum(held[node][0], x[0]), np.maximum(held[node][1], x[1])]) if node in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["node", "table"])

    tables = rows.mapInArrow(run, "node int, table binary").repartition("node").mapInArrow(meet, "node int, table binary").collect()
    found = {r["node"]: np.frombuffer(r["table"]) for r in tables}
    shape = lambda node, k: found[node].reshape(2, k, k) if node in found else empty(k)
    return Ranges(shape(-1, len(tree.roots)), [shape(i, len(x)) for i, x in enumerate(tree.leaves)])


def survivors(tree: Tree, known: Ranges, query: np.ndarray, low: float, high: float) -> list[int]:
    """Leaves that may hold rows at a distance in [low, high] of the query. By a split point at distance d of the query, rows of a
    sibling at distances [m, M] of it are between max(d - M, m - d) and d + M."""
    slack = SLACK * (1 + tree.lift**0.5)

    def left(points: np.ndarray, table: np.ndarray) -> np.ndarray:
        d = distances(query[None], points)[0][:, None]
        nearest, farthest = np.maximum(d - table[1], table[0] - d), d + table[1]
        return np.nonzero(((nearest <= high + slack) & (farthest >= low - slack)).all(0))[0]

    return [int(tree.first[i] + j) for i in left(tree.roots, known.roots) for j in left(tree.leaves[i], known.leaves[i])]


def _visits(queries: DataFrame, tree: Tree, known: Ranges, dims: int) -> DataFrame:
    """queries(..., vec, worst, best: scores, null worst for any) once for each leaf that they must look into."""
    shared = queries.sparkSession.sparkContext.broadcast((tree, known))
    names = queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, k = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("vec"), dims)
            at, leaves = [], []
            for i, (q, worst, best) in enumerate(zip(x, batch.column("worst").to_pylist(), batch.column("best").to_pylist(), strict=True)):
                away = lambda score: max(q @ q + t.lift - 2 * score, 0) ** 0.5  # noqa: B023, E731
                # A range that isn't there (an empty sibling) is never met.
                found = survivors(t, k, np.append(q, 0.0), 0.0 if best is None else away(best), np.inf if worst is None else away(worst))
                at += [i] * len(found)
                leaves += found
            for lo in range(0, len(at), 4096):
                piece = batch.take(pa.array(at[lo : lo + 4096], pa.int32()))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(leaves[lo : lo + 4096], pa.int32())], names=[*names, "leaf"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{kinds}, leaf int")


def _meet(queries: DataFrame, rows: DataFrame, sizes: DataFrame, look, schema: str) -> DataFrame:
    """Blocks of a leaf beside blocks of the queries that visit it; ``look`` gets a table of each. queries(leaf, group, ...)."""
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    asked = queries.select("leaf", F.col("group").alias("part")).distinct().withColumnRenamed("part", "group")
    left = rows.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id", "mark"), F.col("blocks")).cast("int")).drop("blocks").join(asked, "leaf")
    right = queries.join(F.broadcast(sizes), "leaf").select(*queries.columns, blocks)
    keys = ["leaf", "block", "group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(look, schema)


def _distinct(t: pa.Table) -> pa.Table:
    """Rows equal in id, label and vector are one."""
    return t.take(pa.array(np.unique(np.column_stack([t.column(c).to_numpy() for c in ("vec_id", "label", "mark")]), axis=0, return_index=True)[1]))


def _best(score: np.ndarray, ids: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Of the places ``at`` the first ``most`` by score, then id."""
    if len(at) > 8 * most:
        at = at[score[at] >= np.partition(score[at], len(at) - most)[len(at) - most]]
    return at[np.lexsort((ids[at], -score[at]))[:most]]


_PAIR = "anchor_id long, anchor_mark long, score long, vec_id long"


def _looker(dims: int, most: int, low: int, high: int, negatives: bool):
    """Positives: rows (anchor, score, id) of the best of the same label. Negatives: also the positive's score that they stand under."""
    names = ["anchor_id", "anchor_mark", "score", "vec_id", *(["under"] if negatives else [])]

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        if left.num_rows and right.num_rows:
            left = _distinct(left)
            ids, labels, marks = (left.column(c).to_numpy() for c in ("vec_id", "label", "mark"))
            x = matrix(left.column("vec").combine_chunks(), dims)
            anchors = right.select([c for c in right.column_names if c != "vec"]).to_pylist()
            for lo in range(0, len(anchors), 512):
                scores = np.rint(matrix(right.column("vec").slice(lo, 512).combine_chunks(), dims) @ x.T)
                for a, score in zip(anchors[lo : lo + 512], scores, strict=True):
                    if negatives:
                        fits = np.nonzero((labels != a["label"]) & (score <= a["best"]) & (score >= a["worst"]))[0]
                        for under in sorted(set(a["unders"])):
                            keep = _best(score, ids, fits[(score[fits] <= under) & (high * score[fits] >= low * under)], most)
                            for values, new in zip(out, ([a["vec_id"]] * len(keep), [a["mark"]] * len(keep), score[keep].astype(np.int64).tolist(), ids[keep].tolist(), [under] * len(keep)), strict=True):
                                values += new
                    else:
                        fits = labels == a["label"]
                        fits &= (ids != a["vec_id"]) | (marks != a["mark"])
                        fits = np.nonzero(fits & (score >= a["worst"]) if a["worst"] is not None else fits)[0]
                        keep = _best(score, ids, fits, most)
                        for values, new in zip(out, ([a["vec_id"]] * len(keep), [a["mark"]] * len(keep), score[keep].astype(np.int64).tolist(), ids[keep].tolist()), strict=True):
                            values += new
        return pa.Table.from_arrays([pa.array(v, pa.int64()) for v in out], names=names)

    return look


def _ranked(pairs: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first ``most`` of each key by score, then id; each block has sent that many at most."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))), 1, most)
    pairs = pairs.groupBy(*keys).agg(best.alias("best")).select(*keys, F.posexplode("best").alias("place", "b"))
    return pairs.select(*keys, (F.col("place") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.low")).alias("score"))


def hard_negatives(rows: DataFrame, anchors: Column, vector: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, fanout: int = 32, sample: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows(vec_id, label, vector) that ``anchors`` holds of.

    The first ``positives`` other rows of the anchor's label by inner product; for each, the first ``negatives`` rows of another label
    with low * positive <= high * score <= high * positive. Ties go to the smaller id. Rows with a null id, label, vector or
    component, or one that isn't finite, take no part; rows that repeat in id, label and vector count once; shorter vectors are
    filled up by zeros; other columns are ignored. Scores are exact as long as they are below 2**53.
    """
    base = quantised(rows, vector)
    tree, dims = fit(base, fanout, sample)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    if tree is None:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    held = settle(index(base, tree, dims), "vectors")
    known = ranges(held, tree, dims)
    sizes = held.groupBy("leaf").count().select("leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    sizes = settle(sizes, "leaves")  # at most fanout ** 2 rows

    chosen = held.where(anchors).select("vec_id", "label", "vec", "mark", "leaf").dropDuplicates(["vec_id", "label", "mark"])
    groups = max(1, -(-chosen.count() // QUERIES))
    chosen = settle(chosen.withColumn("group", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(groups)).cast("int")), "anchors")
    none = F.lit(None).cast("long")
    key = ["anchor_id", "anchor_mark"]
    found = lambda q: _meet(q, held, sizes, _looker(dims, positives, low, high, False), _PAIR)

    # Home leaves first: their last positive bounds the search, where there are enough of them.
    home = _ranked(found(chosen.withColumn("worst", none)), key, positives).where(F.col("rank") == positives)
    home = home.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_mark").alias("mark"), F.col("score").alias("worst"))
    asked = chosen.drop("leaf").join(home, ["vec_id", "mark"], "left").withColumn("best", none)
    near = settle(_ranked(found(_visits(asked, tree, known, dims)), key, positives), "positives")

    # Then the annulus between the window of the last positive and the first.
    window = near.groupBy(*key).agg(F.collect_set("score").alias("unders"), F.max("score").alias("best"), F.min("score").alias("least"))
    floor = F.ceil(F.lit(low) * F.col("least") / F.lit(high)).cast("long") - 1
    window = window.select(F.col("anchor_id").alias("vec_id"), F.col("anchor_mark").alias("mark"), "unders", "best", floor.alias("worst"))
    asked = chosen.drop("leaf").join(window, ["vec_id", "mark"])
    far = _meet(_visits(asked, tree, known, dims), held, sizes, _looker(dims, negatives, low, high, True), _PAIR + ", under long")
    far = _ranked(far, [*key, "under"], negatives).select(*key, F.col("under").alias("positive_score"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.select(*key, F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(far, [*key, "positive_score"]).select(*names)
