"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by key, then digest. The bounds of the shards come from exact byte counts: ranges of keys that hold
more than a shard's bytes are counted again in finer ranges, down to single keys, and within a key by ranges of the digest. So
the same table gives the same files whatever the cluster, and no outlying or hot key makes a shard large. Each task writes one
shard under temporary names and rolls to a new file before the compressed size would pass ``roll_bytes``; headers and digests are made anew from the payload. A manifest, written
by Spark's own committer, names the one attempt of each file that counts; only those get their final names, and readers see
only what the final manifest lists. Everything lies in one folder that all executors share.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, settle

LAST = (1 << 63) - 1
#: A range that is too large is counted again in about so many ranges for each shard that it holds.
FINER = 16
MANIFEST = "shard long, seq long, temporary string, name string, records long, bytes long, sha256 string"
#: Pages have no time of capture; one fixed date keeps the files the same in every run.
DATE = "2024-01-01T00:00:00Z"
#: Characters of URLs that stay; all others are percent-encoded.
URL_CHARS = "!#$%&'()*+,/:;=?@[]~-._"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(key: int | None, payload_digest: str, nth: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{key}/{payload_digest}/{nth}')}>"


def _headers(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(key: int | None, url: str | None, payload: bytes, first: int | None, nth: int) -> bytes:
    """One record; ``first`` is the key of the record with the same payload that this one revisits, or -1 for a null key."""
    name = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if first is None else http
    fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", _record_id(key, name, nth)), ("WARC-Date", DATE)]
    fields.append(("WARC-Target-URI", quote(url or "", safe=URL_CHARS) or "urn:none"))
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(first, name, 0)), ("X-Refers-To-Key", str(first))]
    fields += [("X-Key", "" if key is None else str(key)), ("WARC-Payload-Digest", f"sha1:{name}"), ("WARC-Block-Digest", f"sha1:{digest(block)}")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _headers(fields) + block + b"\r\n\r\n"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Roller:
    """Writes one shard: gzip members, a new file before ``roll_bytes`` would be passed."""

    def __init__(self, out: str, shard: int, roll_bytes: int, level: int):
        self.out, self.shard, self.roll_bytes, self.level = out, shard, roll_bytes, level
        self.store, self.root = _store(out)
        self.seq, self.stream = 0, None

    def add(self, data: bytes) -> Iterator[tuple]:
        member = gzip.compress(data, self.level, mtime=0)
        if self.stream is not None and self.size + len(member) > self.roll_bytes:
            yield self.close()
        if self.stream is None:
            self.name = f"records-{self.shard:08d}-{self.seq:05d}.warc.gz"
            self.temporary = f"_temporary/{self.name}.{uuid.uuid4().hex}"
            self.store.create_dir(f"{self.root}/_temporary", recursive=True)
            self.stream = self.store.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.size, self.records, self.hash = 0, 0, hashlib.sha256()
            info = b"software: ledgerloom\r\nformat: WARC File Format 1.1\r\n"
            fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id(None, self.name, 0)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))]
            self._put(gzip.compress(_headers(fields) + info + b"\r\n\r\n", self.level, mtime=0))
        self._put(member)
        self.records += 1

    def _put(self, member: bytes) -> None:
        self.stream.write(member)
        self.hash.update(member)
        self.size += len(member)

    def close(self) -> tuple:
        self.stream.close()
        self.stream = None
        self.seq += 1
        return self.shard, self.seq - 1, self.temporary, self.name, self.records, self.size, self.hash.hexdigest()


def _counted(narrow: DataFrame, edges: np.ndarray) -> np.ndarray:
    """Bytes at or after each (key, digest) edge and before the next; edges are sorted and the first is the least of all."""
    held = narrow.sparkSession.sparkContext.broadcast(edges)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(held.value), np.int64)
        for batch in batches:
            np.add.at(total, _place(held.value, *(batch.column(c).to_numpy() for c in ("ord", "fine"))), batch.column("n").to_numpy())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["at", "n"])

    out = np.zeros(len(edges), np.int64)
    for at, n in narrow.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n")).collect():
        out[at] = n
    held.unpersist()
    return out


def _place(edges: np.ndarray, key: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """Index of the last edge that is not after (key, fine); keys of equal value are told apart by ``fine``."""
    ask = np.empty(len(key), EDGE)
    ask["key"], ask["fine"] = key, fine
    return np.searchsorted(edges, ask, side="right") - 1


#: A key and a range of 31 bits of the digest.
EDGE = np.dtype([("key", np.int64), ("fine", np.int64)])
FINE = 1 << 31


def shard_edges(narrow: DataFrame, shard_bytes: int) -> np.ndarray:
    """First (key, digest) of every shard, from narrow(ord, fine, n). Ranges over ``shard_bytes`` are split until they are under it or
    are one key and one value of the digest; neighbours then share a shard up to that size. Each round is one aggregate over the
    table; the edges are some for each shard and are all that the driver holds."""
    low, high = narrow.agg(F.min("ord"), F.max("ord")).first()
    edges = np.array([(low or 0, 0)], EDGE)
    while True:
        size = _counted(narrow, edges)
        finer = []
        for i in np.flatnonzero(size > shard_bytes).tolist():
            (a, fa), (b, fb) = edges[i].tolist(), edges[i + 1].tolist() if i + 1 < len(edges) else ((high or 0) + 1, 0)
            parts = FINER * int(-(-size[i] // shard_bytes))
            if a == b or b == a + 1 and fb == 0:
                step = max(1, ((fb if a == b else FINE) - fa) // parts)
                finer += [(a, f) for f in range(fa + step, fb if a == b else FINE, step)]
            else:
                step = max(1, (b - a) // parts)
                finer += [(k, 0) for k in range(a + step, b if fb == 0 else b + 1, step)]
                finer += [] if fa == 0 else [(a + 1, 0)]
        if not finer:
            break
        # Ranges without rows need no edge of their own.
        kept = edges[(size > 0) | (np.arange(len(edges)) == 0)]
        edges = np.unique(np.concatenate((kept, np.array(finer, EDGE))))
    first, run = [], shard_bytes
    for i in range(len(edges)):
        if run and run + size[i] > shard_bytes:
            first.append(i)
            run = 0
        run += int(size[i])
    return edges[first or [0]]


def write_warc(pages: DataFrame, out: str, key: str = "page_id", url: str = "url", body: str = "html", min_bytes: int = 0, shard_bytes: int = 256 << 20, roll_bytes: int = 1 << 30, level: int = 6) -> DataFrame:
    """Write every row as a record under the new folder ``out``; gives the manifest (shard, seq, name, records, bytes, sha256).

    Payload: the body in UTF-8, null as empty. Of the records with equal payloads of at least ``min_bytes``, the one with the
    smallest key is a response and the others revisit it; smaller payloads are all responses. Rows that repeat key and
    payload are one response and revisits of it. A null key comes last. Characters that a URL may not hold are percent-encoded.
    An empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    rows = pages.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("ord"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body), F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    narrow = settle(rows.select("ord", "sha", F.octet_length("payload").alias("n")), "digests")
    fine = F.shiftright(F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long"), 1)
    held = spark.sparkContext.broadcast(shard_edges(narrow.select("ord", fine.alias("fine"), (F.col("n") + 512).cast("long").alias("n")), shard_bytes))
    shards = len(held.value)
    firsts = narrow.where(F.col("n") >= min_bytes).groupBy("sha").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).where("first < last").select("sha", "first")
    revisits = narrow.select("ord", "sha").join(firsts, "sha").where("ord > first").distinct()
    notes = revisits.select("ord", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha", "first", F.lit(0).alias("kind"))
    dealt = notes.union(rows.select("ord", "url", "payload", "sha", F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind")))

    @F.pandas_udf("int")
    def shard(key: pd.Series, fine: pd.Series) -> pd.Series:
        return pd.Series(_place(held.value, key.to_numpy(), fine.to_numpy()).astype(np.int32))

    dealt = dealt.withColumn("shard", shard("ord", fine))
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "ord", "sha", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        roller, same, first, nth = None, None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("shard", "ord", "sha", "kind", "first")}
                if roller is None or r["shard"] != roller.shard:
                    if roller is not None and roller.stream is not None:
                        done.append(roller.close())
                    roller = _Roller(out, r["shard"], roll_bytes, level)
                if (r["ord"], r["sha"]) != same:
                    same, first, nth = (r["ord"], r["sha"]), None, 0
                if r["kind"] == 0:
                    first = r["first"]
                    continue
                payload = batch.column("payload")[i].as_py()
                of = first if first is not None else (r["ord"] if nth and len(payload) >= min_bytes else None)
                own = None if r["ord"] == LAST else r["ord"]
                done += roller.add(record(own, batch.column("url")[i].as_py(), payload, -1 if of == LAST else of, nth))
                nth += 1
        if roller is not None and roller.stream is not None:
            done.append(roller.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[f.split()[0] for f in MANIFEST.split(", ")])

    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{out}/_attempts")
    discard(narrow)
    attempts = spark.read.schema(MANIFEST).parquet(f"{out}/_attempts")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out)
        for batch in batches:
            for temporary, final, size in zip(*(batch.column(c).to_pylist() for c in ("temporary", "name", "bytes")), strict=True):
                have = store.get_file_info(f"{root}/{final}")
                if have.type == fs.FileType.NotFound or have.size != size:
                    store.move(f"{root}/{temporary}", f"{root}/{final}")
            yield batch

    attempts.mapInArrow(name, MANIFEST).drop("temporary").write.parquet(f"{out}/_manifest")

    def tidy(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out)
        if store.get_file_info(f"{root}/_temporary").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_temporary")
        yield pa.RecordBatch.from_arrays([pa.array([True])], names=["done"])

    spark.range(1).coalesce(1).mapInArrow(tidy, "done boolean").collect()
    return spark.read.parquet(f"{out}/_manifest")


READ = "key long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, refers_to_null boolean, record_id string, payload binary"


def read_warc(spark: SparkSession, out: str, with_payload: bool = True) -> DataFrame:
    """One row per response or revisit of the archives that the manifest in ``out`` lists. Payload length and digest of a
    revisit are those that it records of the full payload; those of a response are computed, and must match its header.
    Its payload is null for revisits, and for all if ``with_payload`` is false."""
    files = spark.read.parquet(f"{out}/_manifest").select("name", "bytes")
    n = max(1, min(files.count(), 4096))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(out)
        names = [f.split()[0] for f in READ.split(", ")]
        for batch in batches:
            for name in batch.column("name").to_pylist():
                with store.open_input_stream(f"{root}/{name}", compression=None, buffer_size=1 << 20) as raw, gzip.GzipFile(fileobj=raw) as f:
                    held, size = [], 0
                    for row in _records(f):
                        held.append(row if with_payload else (*row[:-1], None))
                        size += 200 + len(row[-1] or b"") * with_payload
                        if size > 8 << 20:
                            yield _table(held, names)
                            held, size = [], 0
                    if held:
                        yield _table(held, names)

    return files.repartition(n, "name").mapInArrow(read, READ)


def _table(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _records(f: gzip.GzipFile) -> Iterator[tuple]:
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while (line := f.readline().rstrip(b"\r\n")):
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        block = f.read(int(head["content-length"]))
        kind = head["warc-type"]
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        name = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-block-digest"] != f"sha1:{digest(block)}" or kind == "response" and (digest(payload) != name or len(payload) != length):
            raise ValueError(f"a digest differs in {head['warc-record-id']}")
        of = head.get("x-refers-to-key")
        yield int(head["x-key"]) if head["x-key"] else None, head["warc-target-uri"], kind, length, name, None if of in (None, "-1") else int(of), of == "-1", head["warc-record-id"], payload if kind == "response" else None
