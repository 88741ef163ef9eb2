"""N-gram Jaccard join with multiple global orders.

A text is its set of k-word shingles. If two sets reach the similarity, then under *any* total order of all shingles their
prefixes (the first ``size - ceil(t * size) + 1``) share one. Every order is a filter, and a pair has to pass all of them
before a text moves: the first order, rarest shingles first, makes the join, with room for the overlap judged by sizes and
places; the prefixes under the further orders (other permutations inside each class of rarity) and a parity sketch of the
set are held by node, and pairs that share nothing under one of them go. What is left is verified on the whole sets.

Equal sets are one node from the start, so copies cost one row per task. Groups of a token are worked off in two steps,
never as all pairs: each node is first held against hubs, the nodes with the fewest rare shingles among those that share
a token with it; then, in each token's group, only the nodes outside its largest component are tried against the nodes of
other components. Pairs inside one component can't change the result, so no link between components is lost. Bitmaps of
bounded size drop rows early that the joins would drop anyway. Rarity comes from a table of fixed size (``DF_BITS``), counted
over all documents; it only steers the order, results don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel as K
from .common import Bitmap, discard, no_text, pieces, settle, sliced, summed
from .components import components

U = np.uint64
#: In groups of a token over this size, a pair is made at its first common token alone; below, repeats are merged later.
SMALL = 32
#: A node is held against the hubs of so many of its tokens.
HUBS = 3
#: So often, at most, nodes outside the largest component of a group are held against so many of it.
TURNS, FEW = 6, 8
#: The table of shingle frequencies has 2**DF_BITS counters, 4 bytes each: 16 MB in a task and 4 MB as classes, whatever the input.
DF_BITS = 22
#: Parities of the numbers of shingles in so many classes.
SKETCH = 256
SIGNS = [f"s{i}" for i in range(SKETCH // 64)]


def shingle_sets(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle values) of each row; a text of fewer words is one shingle, a text without words none."""
    for w in K.words(col, K.BLANK_WORDS_LOWER):
        whole = K.windows(w.value, k)
        for r in range(w.hi - w.lo):
            a, b = int(w.ptr[r]), int(w.ptr[r + 1])
            if b - a >= k:
                v = np.sort(whole[a : b - k + 1])
                yield w.lo + r, v[np.append(True, v[1:] != v[:-1])]
            elif b > a:
                yield w.lo + r, K.windows(w.value[a:b], b - a)
            else:
                yield w.lo + r, np.zeros(0, U)


_MASK = (1 << 64) - 1


def node_of(values: np.ndarray) -> int:
    """One signed 64-bit value for a set."""
    if not len(values):
        return 0
    x = (int(K.mix(values + U(K.SECOND)).sum(dtype=U)) + len(values) * K.BASE) & _MASK
    x = ((x ^ x >> 32) * K.SECOND) & _MASK
    x ^= x >> 29
    return x - (1 << 64) if x >> 63 else x


def frequency_classes(rows: DataFrame, k: int) -> np.ndarray:
    """Class of rarity of each of 2**DF_BITS hashed shingles, counted over all documents, repeats too: half doublings over the
    mean counter, so noise of shared counters doesn't decide."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << DF_BITS, np.uint32)
        for batch in batches:
            for w in K.words(batch.column("text"), K.BLANK_WORDS_LOWER):
                at, _ = K.starts(w.ptr, k)
                np.add.at(table, (K.windows(w.value, k)[at] >> U(64 - DF_BITS)).astype(np.int64), 1)
        yield sliced(table)

    steps = summed(rows.mapInArrow(count, "part int, table binary"), np.uint32, 1 << DF_BITS, np.uint64, _steps)
    mean = max(1.0, float(np.exp2(steps / 2.0).mean()))
    return np.maximum(steps.astype(np.int64) - int(2 * np.log2(mean)), 0).astype(np.uint8)


def _steps(count: np.ndarray) -> np.ndarray:
    return (2 * np.log2(np.maximum(count, 1))).astype(np.uint8)


def _first(values: np.ndarray, rarity: np.ndarray, order: int, n: int) -> np.ndarray:
    """The first n of a sorted set in the given global order: by class of rarity, then by a permutation of that order, then by value."""
    kind = rarity[(values >> U(64 - DF_BITS)).astype(np.int64)].astype(U)
    key = kind << U(56) | K.mix(values + U(order * K.SECOND % (1 << 64))) >> U(8)
    return values[np.argsort(key, kind="stable")[:n]]


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def sketch(values: np.ndarray) -> np.ndarray:
    """Parities of the numbers of members in SKETCH classes, as signed 64-bit words: two sketches differ in no more bits than
    the sets do in members."""
    odd = np.bincount((K.mix(values) >> U(64 - 8)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def row_mark(text: Column) -> Column:
    """A 64-bit value of a text; null is not the empty text."""
    return F.xxhash64(text, text.isNull())


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values), kind))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, orders: int = 3, by_row: bool = False) -> DataFrame:
    """(id, n_shingles long, component_id): groups of documents that are linked, directly or over others, by
    ``100 * intersection >= percent * union`` of their shingle sets.

    component_id is the smallest id of the group; a document without words is alone. A null id is the largest: it takes
    the smallest other id of its group, and stays null alone. Repeated rows are links like any others.

    by_row: also mark (``row_mark`` of the text, which with the id tells rows of unlike texts apart) and root, a value of the
    group itself (null for documents without words), as several groups may have one id or none.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), no_text(F.col(text_col)).alias("text"))
    shared_rarity = spark.sparkContext.broadcast(frequency_classes(rows.select("text"), k))

    def nodes(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = [(node_of(v), len(v)) for _, v in shingle_sets(part.column("text"), k)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), *(part.column(c) for c in more)], names=["id", "node", "n_shingles", *more])

    if by_row:
        marked = docs.select(F.col(id_col).cast("long").alias("id"), no_text(F.col(text_col)).alias("text"), row_mark(F.col(text_col)).alias("mark"))
        members = settle(marked.mapInArrow(lambda b: nodes(b, ("mark",)), "id long, node long, n_shingles long, mark long"), "members")
    else:
        members = settle(rows.mapInArrow(nodes, "id long, node long, n_shingles long"), "members")

    def tokens(batches: Iterator[pa.RecordBatch], wanted: Bitmap | None) -> Iterator[pa.RecordBatch]:
        """Prefix tokens of each set that is new to the task; with ``wanted``, one row for each set that has some of those."""
        rare, seen = shared_rarity.value, set()
        for batch in batches:
            for part in pieces(batch):
                token, node, size, place, further, signs = [], [], [], [], [[] for _ in range(1, orders)], []
                for _, v in shingle_sets(part.column("text"), k):
                    if not len(v) or (me := node_of(v)) in seen:
                        continue
                    seen.add(me)
                    p = prefix_length(len(v), percent)
                    mine = _first(v, rare, 0, p)
                    if wanted is None:
                        token.append(mine)
                        continue
                    at = np.flatnonzero(wanted.may_have(mine)).astype(np.int32)
                    if len(at):
                        token.append(mine[at].view(np.int64))
                        node.append(me)
                        size.append(len(v))
                        place.append(at)
                        signs.append(sketch(v))
                        for o, held in enumerate(further, 1):
                            held.append((_first(v, rare, o, p) >> U(32)).astype(np.uint32).view(np.int32))
                if token and wanted is None:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).view(np.int64))], names=["token"])
                elif token:
                    found = [pa.array(node, pa.int64()), pa.array(size, pa.int32()), _lists(token, pa.int64()), _lists(place, pa.int32())]
                    found += [_lists(x, pa.int32()) for x in further] + [pa.array(x) for x in np.array(signs).T.copy()]
                    yield pa.RecordBatch.from_arrays(found, names=[x.split()[0] for x in sets_of])

    sets_of = ["node long", "n int", "tokens array<long>", "places array<int>", *[f"f{o} array<int>" for o in range(1, orders)], *[f"{s} long" for s in SIGNS]]
    # Tokens that more than one node, or more than one task, has: all others can't link anything.
    repeated = settle(rows.select("text").mapInArrow(lambda b: tokens(b, None), "token long").groupBy("token").count().where("count > 1").select("token"), "repeated")
    mask = Bitmap(repeated, repeated.count())
    sets = settle(rows.select("text").mapInArrow(lambda b: tokens(b, mask), ", ".join(sets_of)), "sets")
    mask.drop()
    each = sets.select("node", "n", F.explode(F.arrays_zip("tokens", "places")).alias("t")).select("node", "n", F.col("t.tokens").alias("token"), F.col("t.places").alias("p"))
    prefixes = settle(each.join(repeated, "token", "left_semi").distinct(), "prefixes")
    discard(repeated)

    # Room for the overlap: sizes near enough, and enough left after the shared place in either set.
    room = f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b) and (100 + {percent}) * least(n_a - p_a, n_b - p_b) >= {percent} * (n_a + n_b)"
    # Sets that are near enough differ in few members, and their sketches in no more bits.
    like = " + ".join(f"bit_count({s}_a ^ {s}_b)" for s in SIGNS)
    like = f"(100 + {percent}) * ({like}) <= (100 - {percent}) * (n_a + n_b)"

    def side(table: DataFrame, s: str, *same: str) -> DataFrame:
        return table.select(*same, *[F.col(c).alias(f"{c}_{s}") for c in table.columns if c not in same])

    def texts(batches: Iterator[pa.RecordBatch], wanted: Bitmap) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch):
                at, node = [], []
                for i, v in shingle_sets(part.column("text"), k):
                    if len(v) and (me := node_of(v)) not in seen:
                        seen.add(me)
                        at.append(i)
                        node.append(me)
                ids = np.array(node, np.int64)
                use = wanted.may_have(ids)
                if use.any():
                    yield pa.RecordBatch.from_arrays([pa.array(ids[use]), part.column("text").take(pa.array(np.array(at)[use]))], names=["node", "text"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for part in pieces(batch):
                a = part.column("a").to_numpy()
                ok = np.zeros(len(a), bool)
                first = np.append(True, a[1:] != a[:-1])
                sets_a = shingle_sets(part.column("t_a").filter(pa.array(first)), k)
                for i, ((_, y), new) in enumerate(zip(shingle_sets(part.column("t_b"), k), first, strict=True)):
                    if new:
                        held = next(sets_a)[1]
                    both = len(np.intersect1d(held, y, assume_unique=True))
                    ok[i] = 100 * both >= percent * (len(held) + len(y) - both)
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(keep), part.column("b").filter(keep)], names=["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs(a, b) those that are linked: prefixes under every further order meet, then the whole sets are compared."""
        further = [f"f{o}" for o in range(1, orders)]
        held = sets.select("node", *further).dropDuplicates(["node"])
        both = pairs.join(side(held, "a").withColumnRenamed("node_a", "a"), "a").join(side(held, "b").withColumnRenamed("node_b", "b"), "b")
        for f in further:
            both = both.where(F.arrays_overlap(f"{f}_a", f"{f}_b"))
        passed = settle(both.select("a", "b"), "passed")
        wanted = settle(passed.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "wanted")
        mask = Bitmap(wanted, wanted.count())
        got = rows.select("text").mapInArrow(lambda b: texts(b, mask), "node long, text string").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
        store = settle(got, "texts")
        text = [store.select(F.col("node").alias(s), F.col("text").alias(f"t_{s}")) for s in "ab"]
        whole = passed.join(text[1], "b").join(text[0], "a").select("a", "b", "t_a", "t_b")
        out = settle(whole.mapInArrow(check, "a long, b long"), "verified")
        discard(passed, wanted, store)
        mask.drop()
        return out

    # Each node meets the hubs of a few of its tokens, the nodes whose first shared token comes earliest.
    keys = [F.min(F.struct(F.xxhash64("token", F.lit(o)).alias("h"), "token"))["token"].alias(f"k{o}") for o in range(HUBS)]
    own = prefixes.groupBy("node").agg(F.first("n").alias("n"), F.min("p").alias("p"), *keys)
    own = settle(own.select("node", "n", "p", F.explode(F.array_distinct(F.array(*[f"k{o}" for o in range(HUBS)]))).alias("token")), "own")
    hub = own.groupBy("token").agg(F.min(F.struct("p", "node", "n")).alias("h")).select("token", F.col("h.node").alias("node_b"), F.col("h.n").alias("n_b"), F.col("h.p").alias("p_b"))
    stars = side(own, "a", "token").join(hub, "token").where(f"node_a <> node_b and {room}").select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))
    stars = settle(stars.distinct(), "pairs")
    links = verified(stars)
    discard(stars, own)
    label = components(links)

    # In each group the nodes outside its largest component are tried against those of other components: first, as long as
    # that still joins many, each against a few of the largest component; what is then left, against all of them.
    signs = sets.select("node", *SIGNS).dropDuplicates(["node"])
    nodes_in_all = sets.count()
    for turn in range(TURNS):
        placed = prefixes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        parts = placed.groupBy("token", "component").agg(F.count("*").alias("size"))
        parts = parts.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("size"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        apart = settle(placed.join(parts, "token").join(signs, "node"), "apart")
        work, outside = apart.where(f"size > {SMALL} and component <> main").agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_distinct("node")).first()
        if turn == TURNS - 1 or work <= FEW * SMALL * outside:
            break
        large = apart.where(F.col("size") > SMALL)
        order = F.row_number().over(Window.partitionBy("token").orderBy(F.xxhash64("node", F.lit(turn))))
        some = large.where("component = main").withColumn("__rank", order).where(F.col("__rank") <= FEW).drop("__rank")
        mine = large.where("component <> main").groupBy("node").agg(F.min(F.struct(F.xxhash64("token", F.lit(turn)).alias("h"), "token"))["token"].alias("token"))
        asked = large.where("component <> main").join(mine, ["node", "token"])
        tried = side(asked, "a", "token").join(side(some, "b", "token"), "token").where(like).select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))
        tried = settle(tried.distinct(), "pairs")
        # By the share of the few that are like a node: how many pairs would be left to verify. A turn reads all texts once more, so
        # it pays if those are more than all nodes.
        if tried.count() * asked.agg(F.sum("size")).first()[0] <= 2 * nodes_in_all * FEW * outside:
            discard(tried)
            break
        links = settle(links.union(verified(tried)), "links")
        label = components(links)
        discard(apart, tried)
    discard(prefixes)
    made = f"component_a <> component_b and (component_b = main_a or node_a < node_b) and {room} and {like}"
    pair = [F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b")]
    small = apart.where(F.col("size") <= SMALL)
    close = side(small.where("component <> main"), "a", "token").join(side(small, "b", "token"), "token").where(made).select(*pair)
    # A pair of a large group is made at its first common token alone: there the room is judged, and no copy follows.
    large = apart.where(F.col("size") > SMALL)
    inside = F.transform(F.sort_array(F.collect_list(F.struct("p", "token"))), lambda x: x["token"])
    large = settle(large.join(large.groupBy("node").agg(inside.alias("large")), "node"), "large")
    far = side(large.where("component <> main"), "a", "token").join(side(large, "b", "token"), "token").where(f"{made} and token = array_intersect(large_a, large_b)[0]").select(*pair)
    more = settle(close.union(far).distinct(), "pairs")
    discard(apart, large)
    if not more.isEmpty():
        label = components(links.union(verified(more)))
    discard(sets, more)
    named = members.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.where("n_shingles > 0").groupBy("component").agg(F.min("id").alias("least"))
    more = ["mark", F.col("component").alias("root")] if by_row else []
    full = named.where("n_shingles > 0").join(least, "component").select("id", "n_shingles", F.col("least").alias("component_id"), *more)
    more = ["mark", F.lit(None).cast("long").alias("root")] if by_row else []
    alone = named.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"), *more)
    return full.union(alone).withColumnRenamed("id", id_col)
