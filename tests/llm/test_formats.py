"""TIFF, WARC and chat formatting: round trips, brute force and damaged input."""

import base64
import gzip
import hashlib
import json
import os
import random
import struct
import uuid
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat, tiff, warc
from ledgerloom.llm.common import scratch
from ledgerloom.llm.queries import _TRICKY, op9_chat_format


@pytest.mark.parametrize("scheme", ["none", "packbits", "lzw", "deflate"])
@pytest.mark.parametrize("tile", [0, 16, 64])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(scheme, tile, predictor):
    rng = random.Random(1)
    for payload in (bytes(64), os.urandom(64 * 300), bytes(rng.choice(b"the and of") for _ in range(64 * 1200))):
        rows = list(tiff._rows(tiff.encode(payload, 64, scheme, predictor, tile)))
        assert len(rows) == 1 and rows[0][7] == payload and rows[0][9] is None


def big_endian_pages(pages):
    """A chain of big-endian 16-bit pages with horizontal predictor, plain strips of one row."""
    out = b"MM" + struct.pack(">HI", 42, 0)
    link = 4
    for image in pages:
        h, w = image.shape
        diff = np.diff(image.astype(">u2"), axis=1, prepend=np.zeros((h, 1), ">u2")).astype(">u2")
        data = b"".join(r.tobytes() for r in diff)
        at = len(out)
        out += data
        lists = len(out)
        out += struct.pack(f">{h}I", *[at + 2 * w * i for i in range(h)]) + struct.pack(f">{h}I", *[2 * w] * h)
        tags = [(256, 4, 1, struct.pack(">I", w)), (257, 4, 1, struct.pack(">I", h)), (258, 3, 1, struct.pack(">HH", 16, 0)), (259, 3, 1, struct.pack(">HH", 1, 0))]
        tags += [(273, 4, h, struct.pack(">I", lists)), (278, 4, 1, struct.pack(">I", 1)), (279, 4, h, struct.pack(">I", lists + 4 * h)), (317, 3, 1, struct.pack(">HH", 2, 0))]
        here = len(out)
        out = out[:link] + struct.pack(">I", here) + out[link + 4 :]
        out += struct.pack(">H", len(tags)) + b"".join(struct.pack(">HHI", t, k, n) + v for t, k, n, v in tags)
        link = len(out)
        out += struct.pack(">I", 0)
    return out, link


def test_tiff_pages_and_damage(spark):
    images = [np.arange(12, dtype=np.uint16).reshape(3, 4) * 999, np.full((2, 5), 7, np.uint16)]
    good, link = big_endian_pages(images)
    loop = good[:link] + good[4:8]
    cut = tiff.encode(bytes(64 * 50), 64, "deflate")
    rows = [(1, good, 9), (2, loop, 9), (3, None, 9), (4, b"", 9), (5, b"junk", 9), (6, cut[:8] + b"\0" * 40 + cut[48:], 9)]
    out = tiff.tiff_pages(spark.createDataFrame(rows, "id int, media binary, page int")).orderBy("id", "page").collect()
    one = [r for r in out if r.id == 1]
    assert [(r.page, r.width, r.height) for r in one] == [(0, 4, 3), (1, 5, 2)]
    assert np.array_equal(np.frombuffer(one[0].pixels, ">u2").reshape(3, 4), images[0])
    assert [r.error is None for r in out if r.id == 2] == [True, True, False]
    assert {r.id for r in out} == {1, 2, 5, 6} and all(r.error for r in out if r.id in (5, 6))


def test_tiff_pages_after_one_that_cannot_be_decoded():
    images = [np.full((2, 5), i, np.uint16) for i in range(4)]
    good, _ = big_endian_pages(images)
    at, places = struct.unpack(">I", good[4:8])[0], []
    while at:
        places.append(at)
        (n,) = struct.unpack_from(">H", good, at)
        (at,) = struct.unpack_from(">I", good, at + 2 + 12 * n)

    def entry(page: int, tag: int) -> int:
        (n,) = struct.unpack_from(">H", good, places[page])
        return next(places[page] + 2 + 12 * i for i in range(n) if struct.unpack_from(">H", good, places[page] + 2 + 12 * i)[0] == tag)

    bad = bytearray(good)
    struct.pack_into(">H", bad, entry(1, tiff.COMPRESSION) + 8, 7)
    struct.pack_into(">II", bad, entry(2, tiff.STRIP_OFFSETS) + 4, 9, 1 << 30)
    rows = list(tiff._rows(bytes(bad)))
    assert [r[0] for r in rows] == [0, 1, 2, 3] and [r[-1] is None for r in rows] == [True, False, False, True]
    assert np.array_equal(np.frombuffer(rows[3][7], ">u2").reshape(2, 5), images[3])


def small_page(bits, width, height, samples, raw, **change):
    """A little-endian page of one plain strip; ``change`` sets tags by name."""
    tags = {"WIDTH": width, "HEIGHT": height, "BITS": bits, "COMPRESSION": 1, "STRIP_OFFSETS": 8, "SAMPLES": samples, "ROWS_PER_STRIP": height, "STRIP_BYTES": len(raw)} | change
    entries = sorted((getattr(tiff, k), 4, 1, v) for k, v in tags.items() if v is not None)
    raw += b"\0" * (len(raw) % 2)
    return struct.pack("<2sHI", b"II", 42, 8 + len(raw)) + raw + struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + bytes(4)


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("samples", [1, 3])
def test_tiff_samples_of_less_than_a_byte(bits, samples):
    image = np.random.default_rng(bits).integers(0, 1 << bits, (5, 7 * samples)).astype(np.uint8)
    row_bits = (image[:, :, None] >> np.arange(bits - 1, -1, -1) & 1).reshape(5, -1).astype(np.uint8)
    raw = np.packbits(row_bits, axis=1).tobytes()
    for code, data in ((1, raw), (32773, tiff.packbits_encode(raw)), (5, tiff.lzw_encode(raw)), (8, zlib.compress(raw))):
        (row,) = tiff._rows(small_page(bits, 7, 5, samples, data, COMPRESSION=code))
        assert row[-1] is None and row[7] == image.tobytes() and row[3:5] == (bits, samples)


def test_tiff_malformed_files_are_error_rows():
    raw = bytes(range(35))
    assert next(tiff._rows(small_page(8, 7, 5, 1, raw)))[7] == raw
    tiles = {"TILE_OFFSETS": 8, "TILE_BYTES": 35, "TILE_WIDTH": 0, "TILE_HEIGHT": 16}
    for change in ({"ROWS_PER_STRIP": 0}, {"SAMPLES": 0}, {"SAMPLES": 0, "PLANAR": 2}, {"WIDTH": 1 << 31, "HEIGHT": 1 << 31}, {"BITS": 3}, {"BITS": 4, "PREDICTOR": 2}, tiles, {"STRIP_BYTES": 0}, {"COMPRESSION": 8}, {"STRIP_OFFSETS": None}, {"SAMPLES": 1 << 31}):
        (row,) = tiff._rows(small_page(8, 7, 5, 1, raw, **change))
        assert row[0] == 0 and row[-1] and row[7] is None, change
    bomb = zlib.compress(bytes(1 << 26), 9)
    assert len(tiff.unpack(bomb, "deflate", 100)) == 100
    assert len(tiff.packbits_decode(b"\x81\0" * 10_000, 200)) < 400


def test_tiff_floating_predictor():
    x = np.random.default_rng(0).random((3, 5)).astype("<f4")
    planes = np.swapaxes(x.astype(">f4").view(np.uint8).reshape(3, 5, 4), 1, 2).reshape(3, -1)
    diff = np.diff(planes, axis=1, prepend=np.zeros((3, 1), np.uint8))
    assert (tiff.undo_predictor(diff.reshape(3, 5, 4), 3, 32, "<") == x.view(np.uint8).reshape(3, 5, 4)).all()


def test_stored_texts_come_back(spark):
    texts = ["", None, "é" * 31, "a" * 64, "b" * 65, "long " * 30000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    pages = {r.doc_id: r for r in tiff.tiff_pages(tiff.store_texts(docs)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        want = data + b"\0" * (-len(data) % 64 or (not data) * 64)
        assert pages[i].pixels == want and pages[i].n_bytes == len(data)
        assert zlib.crc32(pages[i].pixels[-64:]) == zlib.crc32(want[-64:])


PAGES = [(3, "http://a/ b", "<p>x</p>"), (1, "http://a", "<p>x</p>"), (2, None, "é"), (9, "u", None), (8, "u", ""), (7, "u\r\nX: y", "<p>x</p>"), (7, "u", "<p>x</p>"), (None, "u", "é"), (5, "u", "big " * 40000)]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    out = scratch(spark, "warc")
    manifest = warc.write_warc(pages, out, shard_bytes=2000, roll_bytes=900)
    assert manifest.count() > 2 and manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    rows = warc.read_warc(spark, out).collect()
    got = sorted((str(r.key), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in rows)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    x, e = sha("<p>x</p>"), sha("é")
    want = [("1", 8, x, "response", "None"), ("2", 2, e, "response", "None"), ("3", 8, x, "revisit", "1"), ("5", 160000, sha("big " * 40000), "response", "None"), ("7", 8, x, "revisit", "1"), ("7", 8, x, "revisit", "1")]
    want += [("8", 0, sha(""), "response", "None"), ("9", 0, sha(""), "revisit", "8"), ("None", 2, e, "revisit", "2")]
    assert got == sorted(want)
    folder = out.removeprefix("file://")
    assert not os.path.exists(f"{folder}/_temporary")
    for r in manifest.collect():
        data = open(f"{folder}/{r['name']}", "rb").read()
        assert len(data) == r["bytes"] and hashlib.sha256(data).hexdigest() == r["sha256"] and gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_warc_is_deterministic(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i % 7}</p>") for i in range(200)], "page_id long, url string, html string")
    stamp = lambda df, out: sorted(map(tuple, warc.write_warc(df, out, shard_bytes=30000, roll_bytes=9000).select("name", "bytes", "sha256").collect()))
    assert stamp(pages.repartition(5), scratch(spark, "warc")) == stamp(pages.orderBy(F.desc("page_id")).coalesce(1), scratch(spark, "warc"))


def test_warc_small_payloads_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    out = scratch(spark, "warc")
    warc.write_warc(pages, out, min_bytes=3)
    assert {r.key: r.record_type for r in warc.read_warc(spark, out).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}
    out = scratch(spark, "warc")
    assert warc.write_warc(pages.limit(0), out).count() == 0
    assert warc.read_warc(spark, out).count() == 0


def test_warc_outlying_and_hot_keys_leave_shards_even(spark):
    """One key far off, and one key (then none) of a third of the rows: no shard holds more than its share."""
    rows = [(i, "u", f"page {i} " * 40) for i in range(400)] + [(10**9, "u", "far off")] + [(k, "u", f"hot {j} {k} " * 40) for k in (77, None) for j in range(200)]
    out = scratch(spark, "warc")
    manifest = warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), out, shard_bytes=20_000, roll_bytes=1 << 20).toPandas()
    most = manifest.groupby("shard").records.sum()
    assert most.sum() == len(rows) and len(most) > 20 and most.max() < 60
    got = warc.read_warc(spark, out).collect()
    assert sorted(str(r.key) for r in got) == sorted(str(r[0]) for r in rows) and all(r.record_type == "response" for r in got)


def test_warc_urls_are_percent_encoded(spark):
    out = scratch(spark, "warc")
    warc.write_warc(spark.createDataFrame([(1, "http://é.org/a b?q=1&r=%20#x\r\nX: y", "t"), (2, "", "s")], "page_id long, url string, html string"), out)
    assert {r.key: r.url for r in warc.read_warc(spark, out).collect()} == {1: "http://%C3%A9.org/a%20b?q=1&r=%20#x%0D%0AX:%20y", 2: "urn:none"}


def test_chat_escapes_are_reversible(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("<|\\>turn\n end") for _ in range(rng.randrange(30))) for _ in range(300)] + ["<|turn|>", "<|end|>\n", "\\<|body|>", "", "<", "<\\|", _TRICKY]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = {r.id: (r.e, r.u) for r in rows.select("id", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()}
    assert all(got[i][1] == t and "<|" not in got[i][0] for i, t in enumerate(texts))


def test_chat_query_against_brute_force(spark, tmp_path):
    rows = [(1, 1, "assistant", "b<|end|>\n"), (1, 0, "user", "a"), (2, 0, None, None), (2, None, "assistant", "é\\"), (None, 5, "assistant", "x"), (3, 0, "assistant", "s"), (3, 0, "assistant", "s"), (4, 0, "assi<|stant", "t" * 100000)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op9_chat_format(spark, str(tmp_path)).collect()}
    rows += [(-7, 0, "user", _TRICKY), (-7, 1, "assistant", _TRICKY)]
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        sha = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_mask_is_read_by_position(spark):
    turns = "array(named_struct('role', 'user', 'text', 'hé <|turn|>'), named_struct('role', 'assistant', 'text', 'yes'), named_struct('role', 'assistant', 'text', 'more'))"
    made = chat.format_turns(spark.range(1).select(F.expr(turns).alias("turns")))
    right = chat.parse_formatted(made).first()
    assert [t.learn for t in right.read] == [False, True, True]
    under = "".join(chat_part for chat_part in masked(right.formatted, right.loss))
    assert under == "yesmore"
    # A run that is one longer, and a later one that is one shorter: lengths agree, places don't.
    moved = F.transform("loss", lambda r, i: F.struct((r["chars"] + F.when(i == 3, 1).when(i == 5, -1).otherwise(0)).alias("chars"), r["learn"].alias("learn")))
    assert [t.learn for t in chat.parse_formatted(made.withColumn("loss", moved)).first().read] == [False, False, True]


def masked(text, runs):
    at = 0
    for r in runs:
        if r.learn:
            yield text[at : at + r.chars]
        at += r.chars


def test_chat_layouts(spark):
    rows = [
        (1, json.dumps({"prompt": "p", "response": "r"})), (2, json.dumps({"instruction": "i", "input": "", "output": "o"})), (3, json.dumps({"instruction": "i", "input": "more", "output": "o"})),
        (4, json.dumps({"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]})), (5, json.dumps({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]})),
        (6, "{not json"), (7, None), (8, json.dumps({"other": 1})), (9, json.dumps({"response": "r2", "prompt": None})),
    ]
    out = {r.id: r.turns and [(t.role, t.text) for t in r.turns] for r in chat.turns_of_json(spark.createDataFrame(rows, "id int, j string"), "j").collect()}
    assert out[1] == [("user", "p"), ("assistant", "r")] and out[2] == [("user", "i"), ("assistant", "o")] and out[3][0] == ("user", "i\n\nmore")
    assert out[4] == [("user", "u"), ("assistant", "a")] and out[5] == [("user", "h"), ("assistant", "g")]
    assert out[6] is None and out[7] is None and out[8] is None and out[9] == [("user", ""), ("assistant", "r2")]
    table = spark.createDataFrame([(1, "p", "c")], "id int, prompt string, completion string")
    assert chat.turns_of_table(table, ["id"]).first().turns[1].text == "c"
    with pytest.raises(ValueError):
        chat.turns_of_table(spark.createDataFrame([(1, 2)], "id int, q int"), ["id"])
    assert chat.format_turns(chat.turns_of_table(table.limit(0), ["id"])).count() == 0


def test_queries_have_distinct_record_ids():
    assert len({warc._record_id(k, "d", n) for k in (1, 2, None) for n in (0, 1)}) == 6 and uuid.UUID(warc._record_id(1, "d", 0)[10:-1])
