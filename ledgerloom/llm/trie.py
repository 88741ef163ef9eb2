"""Prefix trie of conversations: a z-fast trie that is built in batches and expanded to one row per node.

Turns are strings' symbols, and a prefix is named by a 128-bit chained digest, so equal prefixes have equal names. The
compacted trie is a table of segments (a, b] of inserted paths; each is filed under the digest at its two-fattest depth, its
handle. A pending conversation finds its exit by fat binary search: about log2(longest) joins with the handles, then one with
the first digests of the segments. All that leave the trie at one place by one symbol draw a representative, the least digest;
representatives are inserted as new paths and cut the segments that they leave, the others search on from there. As a
representative is a random member of its group, the number of batches is logarithmic in the number of conversations.

Counts go back up batch by batch: what hangs on a path is summed by (path, depth) before it meets its path, so a hot first turn
is a few rows, and each node is made once. A conversation is one value of 24 bytes a turn, whatever its texts; texts are read
once and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, no_text, settle, sized_rows

#: Name of the root's path, and bytes of joined ids that one row may hold before they are hashed.
ROOT, CHUNK = bytes(16), 1 << 18
#: Turns shared with the head of a family of conversations are at most so many less one.
SPAN, FAMILY = 9, 5


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, key, bytes): turns in their order, null turn first; rows of one turn are ordered by the digest of role
    and text. Null role or text counts as empty; rows without conv_id belong to no conversation. Other columns are ignored."""
    role, text = no_text(F.col("role")), no_text(F.col("text"))
    key = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), F.substring(F.unhex("key"), 1, 16).alias("key"), "bytes")


def rebuild(own: DataFrame) -> DataFrame:
    """Turns of the rebuilt conversations: the first h of the head of the family, then the own ones after the first h; with a
    marker row (part -1) for each, as some have no turn left."""
    shared = lambda c: (F.crc32(c.cast("string").cast("binary")) % SPAN).cast("int")
    c = F.col("conv_id")
    first = own.where("pos = 1").select("conv_id", (c - c % FAMILY).alias("head"), shared(c).alias("h"))
    heads = own.where(F.col("pos") < SPAN).select(F.col("conv_id").alias("head"), "pos", "key", "bytes")
    return (
        heads.join(first, "head")
        .where("pos <= h")
        .select("conv_id", F.lit(0).alias("part"), "pos", "key", "bytes")
        .union(own.where(F.col("pos") > shared(c)).select("conv_id", F.lit(1), "pos", "key", "bytes"))
        .union(first.select("conv_id", F.lit(-1), F.lit(0), F.lit(None).cast("binary"), F.lit(0).cast("long")))
    )


def sequences(parts: DataFrame) -> DataFrame:
    """(conv_id, sid, path, sizes) of each conversation: digests of its prefixes by depth, bytes of its texts; sid is the last digest."""
    rows = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "key", "bytes"))).alias("t"))
    rows = rows.select("conv_id", F.expr("transform(filter(t, x -> x.part >= 0), x -> struct(x.key, x.bytes))").alias("t"))
    schema = pa.schema([("conv_id", pa.int64()), ("sid", pa.binary()), ("path", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64()))])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for conv, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    flat, at, path = found.values, ROOT, []
                    for key in flat.field(0).to_pylist():
                        at = hashlib.blake2b(at + key, digest_size=16).digest()
                        path.append(at)
                    yield conv, at, path, flat.field(1).to_pylist()

        yield from sized_rows(each(), schema, lambda r: 32 * len(r[2]))

    return rows.mapInArrow(chain, "conv_id long, sid binary, path array<binary>, sizes array<long>")


def id_digests(ids: DataFrame) -> DataFrame:
    """(sid, sha) of rows (sid, conv_id): SHA-256 of the ids in ascending order, joined by commas. Ranges of (sid, id) become pieces of
    text, and only pieces meet by sid, one after another: no task holds the ids of a hot sid."""
    schema = pa.schema([("sid", pa.binary()), ("first", pa.int64()), ("piece", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            sid, first, held, size = None, 0, [], 0
            for batch in batches:
                for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if held and (s != sid or size > CHUNK):
                        yield sid, first, ",".join(held).encode()
                        held, size = [], 0
                    if not held:
                        sid, first = s, c
                    held.append(str(c))
                    size += len(held[-1]) + 1
            if held:
                yield sid, first, ",".join(held).encode()

        yield from sized_rows(each(), schema, lambda r: len(r[2]))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            sid, sha = None, None
            for batch in batches:
                for s, piece in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    if s != sid:
                        if sid is not None:
                            yield sid, sha.hexdigest()
                        sid, sha = s, hashlib.sha256(piece)
                    else:
                        sha.update(b"," + piece)
            if sid is not None:
                yield sid, sha.hexdigest()

        yield from sized_rows(each(), pa.schema([("sid", pa.binary()), ("sha", pa.string())]), lambda r: 80)

    pieces = ids.repartitionByRange("sid", "conv_id").sortWithinPartitions("sid", "conv_id").mapInArrow(cut, "sid binary, first long, piece binary")
    return pieces.repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(fold, "sid binary, sha string")


def fattest(a: str, b: str) -> Column:
    """The number in (a, b] that is divisible by the highest power of two."""
    return F.expr(f"{b} & shiftleft(-1, length(bin({a} ^ {b})) - 1)").cast("int")


def segments(paths: DataFrame, cuts: DataFrame) -> DataFrame:
    """The compacted nodes: each path (depths p to its length) in pieces (a, b] at its cuts, with the digests at the handle, at the
    first depth and at the last."""
    held = cuts.groupBy(F.col("owner").alias("sid")).agg(F.collect_set("q").alias("qs"))
    rows = paths.join(held, "sid", "left").withColumn("size", F.size("path"))
    rows = rows.withColumn("qs", F.array_sort(F.array_distinct(F.concat(F.coalesce(F.filter("qs", lambda q: q > F.col("p")), F.array().cast("array<int>")), F.array("size")))))
    rows = rows.select("sid", "layer", "path", "p", "qs", F.posexplode("qs").alias("i", "b"))
    rows = rows.withColumn("a", F.when(F.col("i") > 0, F.get("qs", F.col("i") - 1)).otherwise(F.col("p"))).withColumn("f", fattest("a", "b"))
    at = lambda d: F.get("path", F.col(d) - 1)
    return rows.select(F.col("sid").alias("owner"), "layer", "a", "b", at("f").alias("handle"), F.get("path", F.col("a")).alias("child"), at("b").alias("ext"), F.slice("path", F.col("a") + 1, F.col("b") - F.col("a")).alias("edge"))


def locate(pending: DataFrame, nodes: DataFrame, steps: int) -> DataFrame:
    """pending(sid, path, sizes, owner, layer, lo): where each leaves the trie, as (owner, layer, p) in place of lo. A node with extent
    lo on the path of owner is known to be a prefix."""
    size = F.size("path")
    rows = pending.withColumns({"hi": size, "door": F.lit(None).cast("binary")})
    handles = nodes.select(F.col("handle").alias("_k"), F.col("owner").alias("_o"), F.col("layer").alias("_l"), F.col("b").alias("_b"), F.col("child").alias("_c"), F.col("ext").alias("_e"))
    for _ in range(steps):
        rows = rows.withColumn("f", F.when(F.col("lo") < F.col("hi"), fattest("lo", "hi")))
        # A search that has ended looks for its own digest with a mark, which no node has, so that ended ones don't meet on null.
        rows = rows.withColumn("_k", F.when(F.col("f").isNotNull(), F.get("path", F.col("f") - 1)).otherwise(F.concat("sid", F.lit(b"-"))))
        rows = rows.join(handles, "_k", "left")
        hit = F.col("_o").isNotNull()
        deeper = hit & (F.col("_b") <= size) & (F.get("path", F.col("_b") - 1) == F.col("_e"))
        rows = rows.select(
            "sid", "path", "sizes",
            F.when(deeper, F.col("_o")).otherwise(F.col("owner")).alias("owner"),
            F.when(deeper, F.col("_l")).otherwise(F.col("layer")).alias("layer"),
            F.when(deeper, F.col("_b")).otherwise(F.col("lo")).alias("lo"),
            F.when(F.col("f").isNull() | deeper, F.col("hi")).when(hit, F.lit(-1)).otherwise(F.col("f") - 1).alias("hi"),
            F.when(hit & ~deeper, F.col("_c")).otherwise(F.col("door")).alias("door"),
        )
    doors = nodes.select(F.col("child").alias("_k"), F.col("owner").alias("_o"), F.col("layer").alias("_l"), "a", "edge")
    door = F.coalesce("door", F.get("path", F.col("lo")), F.concat("sid", F.lit(b"-")))
    rows = rows.withColumn("_k", door).join(doors, "_k", "left")
    along = F.expr("size(filter(zip_with(edge, slice(path, a + 1, size(edge)), (x, y) -> x <=> y), x -> x))")
    inside = F.col("_o").isNotNull()
    return rows.select(
        "sid", "path", "sizes",
        F.when(inside, F.col("_o")).otherwise(F.col("owner")).alias("owner"),
        F.when(inside, F.col("_l")).otherwise(F.col("layer")).alias("layer"),
        F.when(inside, F.col("a") + along).otherwise(F.col("lo")).cast("int").alias("p"),
    )


_NODE = "sid binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, parent long, owner binary, p int"


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sid, owner, p, sizes, hung: what hangs at each depth) to the nodes of depths p + 1 to the last, from the deepest up."""
    types = [pa.binary(), pa.int32(), *[pa.int64()] * 6, pa.binary(), pa.int32()]
    schema = pa.schema(list(zip((x.split()[0] for x in _NODE.split(", ")), types, strict=True)))

    def each() -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                hung = {h["q"]: h for h in r["hung"]}
                p, sizes = r["p"], r["sizes"]
                last = len(sizes)
                found, n, low, leaves, saved = [], 0, None, 0, 0
                for d in range(last, p, -1):
                    h = hung.get(d)
                    kids = int(d < last)
                    if h:
                        n, kids, leaves, saved = n + h["n"], kids + h["kids"], leaves + h["leaves"], saved + h["saved"]
                        low = h["low"] if low is None else min(low, h["low"])
                    leaves = leaves if kids else 1
                    saved += (n - 1) * sizes[d - 1] if d else 0
                    found.append((d, low, n, kids, leaves, saved))
                for i, (d, low, n, kids, leaves, saved) in enumerate(found):
                    top = i + 1 == len(found)
                    yield r["sid"], d, low, n, kids, leaves, saved, None if top else found[i + 1][1], r["owner"] if top else None, p if top else None

    yield from sized_rows(each(), schema, lambda r: 96)


def conversation_trie(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) to the nodes of the trie of rebuilt conversations: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    An empty table has no node, not even the root. Equal conversations are members of the same nodes; rows that repeat count as
    turns of their own. See ``turns`` for nulls and ties.
    """
    spark = rows.sparkSession
    own = settle(turns(rows), "turns")
    convs = settle(sequences(rebuild(own)), "sequences")
    discard(own)
    ends = convs.groupBy("sid").agg(F.count("*").alias("n"), F.min("conv_id").alias("low")).join(id_digests(convs.select("sid", "conv_id")), "sid")
    ends = settle(ends, "ends")
    longest = convs.agg(F.max(F.size("path"))).first()[0]
    steps = int(longest or 0).bit_length() + 1
    root = F.lit(ROOT)
    # Every distinct sequence once, by the conversation of smallest id; at first all leave the trie at the root.
    at = convs.join(ends.select(F.col("low").alias("conv_id")), "conv_id", "left_semi").select("sid", "path", "sizes", root.alias("owner"), F.lit(0).alias("layer"), F.lit(0).alias("p"))
    layers, stops, used = [], [], []
    located = settle(at, "located")
    while True:
        used.append(located)
        number = len(layers) + 1
        rest = located.where(F.col("p") < F.size("path"))
        heads = rest.groupBy("owner", "p", F.get("path", F.col("p")).alias("next")).agg(F.min("sid").alias("sid")).select("sid")
        paths = settle(rest.join(heads, "sid", "left_semi").select("sid", "owner", F.col("layer").alias("above"), "p", "path", "sizes", F.lit(number).alias("layer")), "paths")
        stops.append(located.where(F.col("p") == F.size("path")).select("sid", "owner", "layer", F.col("p").alias("q")))
        if paths.isEmpty():
            break
        layers.append(paths)
        pending = rest.join(paths.select("sid"), "sid", "left_anti").withColumnRenamed("p", "lo")
        known = _all(layers)
        cuts = known.select("owner", F.col("p").alias("q")).union(_all(stops).select("owner", "q")).distinct()
        nodes = settle(segments(known.select("sid", "layer", "p", "path"), cuts), "segments")
        located = settle(locate(pending, nodes, steps), "located")
        discard(nodes)

    # Ends: a conversation ends at the last depth of its own path, or where it was located.
    own_ends = [x.select("sid", F.col("sid").alias("owner"), "layer", F.size("path").alias("q")) for x in layers]
    ended = settle(_all([*own_ends, *stops]).join(ends, "sid").select("owner", "layer", "q", "n", "low", "sha"), "ended")
    none = F.lit(0).cast("long")
    hanging = [ended.select("owner", "layer", "q", "n", "low", none.alias("kids"), none.alias("leaves"), none.alias("saved"))]
    made = []
    top = spark.range(1).select(root.alias("sid"), F.lit(None).cast("binary").alias("owner"), F.lit(-1).alias("p"), F.array().cast("array<long>").alias("sizes"), F.lit(-1).alias("above"))
    for number, paths in reversed(list(enumerate([top, *layers]))):
        hung = _all(hanging).where(F.col("layer") == number).groupBy("owner", "q")
        hung = hung.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("kids").alias("kids"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        hung = hung.groupBy(F.col("owner").alias("sid")).agg(F.collect_list(F.struct("q", "n", "low", "kids", "leaves", "saved")).alias("hung"))
        each = paths.select("sid", "owner", "p", "sizes", "above").join(hung, "sid")
        out = settle(each.select("sid", "owner", "p", "sizes", "hung").mapInArrow(_nodes, _NODE), "nodes")
        made.append(out)
        if number:
            above = paths.select("sid", "above")
            tops = out.where("owner is not null").join(above, "sid")
            hanging.append(tops.select("owner", F.col("above").alias("layer"), F.col("p").alias("q"), F.col("n_convs").alias("n"), F.col("conv_id").alias("low"), F.lit(1).cast("long").alias("kids"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")))
    nodes = _all(made)
    parents = nodes.select(F.col("sid").alias("owner"), F.col("depth").alias("p"), F.col("conv_id").alias("up"))
    tops = nodes.where("owner is not null").join(parents, ["owner", "p"]).withColumn("parent", F.col("up")).select(*nodes.columns)
    whole = tops.union(nodes.where("owner is null"))
    sha = ended.select(F.col("owner").alias("sid"), F.col("q").alias("depth"), "sha")
    return whole.join(sha, ["sid", "depth"], "left").select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _all(tables: list[DataFrame]) -> DataFrame:
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole
