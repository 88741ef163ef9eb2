"""TIFF media columns: one row per page, decoded to plain samples, and a small writer for lossless storage.

The reader walks the chain of image directories (either byte order), reads strips or tiles that are stored plain or by
PackBits, LZW or deflate, undoes the horizontal and the floating-point predictor, and crops tiles to the image. Samples have
1, 2, 4, 8, 16, 32 or 64 bits. What a page may take is bounded by ``MOST_BYTES``, and no strip is unpacked beyond its size.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import OUT_BYTES, without

PAGE = [
    T.StructField("page", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("bits", T.IntegerType()),
    T.StructField("samples", T.IntegerType()),
    T.StructField("compression", T.StringType()),
    T.StructField("predictor", T.IntegerType()),
    T.StructField("pixels", T.BinaryType()),
    T.StructField("look", T.StringType()),
    T.StructField("error", T.StringType()),
]
#: Fixed values of the TIFF 6.0 format: tags, compression schemes and field sizes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
#: A page of more sample bytes than this is an error row.
MOST_BYTES = 1 << 29
SCHEME = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
FIELD = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


def packbits_decode(data: bytes, need: int = 1 << 62) -> bytes:
    """Stops once there are ``need`` bytes."""
    out, i, size = [], 0, 0
    while i < len(data) and size < need:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
            size += n + 1
        else:
            if n > 128:
                out.append(data[i + 1 : i + 2] * (257 - n))
                size += 257 - n
            i += 2 if n > 128 else 1
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.S)


def packbits_encode(data: bytes) -> bytes:
    out, at = [], 0

    def literal(part: bytes) -> None:
        for i in range(0, len(part), 128):
            piece = part[i : i + 128]
            out.append(bytes([len(piece) - 1]) + piece)

    for m in _RUN.finditer(data):
        literal(data[at : m.start()])
        out.append(bytes([257 - (m.end() - m.start()), m.group()[0]]))
        at = m.end()
    literal(data[at:])
    return b"".join(out)


CLEAR, STOP = 256, 257
_SINGLE = [bytes([i]) for i in range(256)] + [b"", b""]


def lzw_decode(data: bytes, need: int = 1 << 62) -> bytes:
    """Most significant bit first, codes widen one entry early, as TIFF has it. Stops once there are ``need`` bytes."""
    out: list[bytes] = []
    table = list(_SINGLE)
    width, limit, held, have, last = 9, 511, 0, 0, None
    for byte in data:
        held = held << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = held >> have
        held &= (1 << have) - 1
        if code == CLEAR:
            table = list(_SINGLE)
            width, limit, last = 9, 511, None
            continue
        if code == STOP:
            break
        if last is None:
            last = table[code]
        else:
            n = len(table)
            now = table[code] if code < n else last + last[:1]
            if code > n:
                raise ValueError("LZW code out of range")
            table.append(last + now[:1])
            last = now
            if n + 1 >= limit and width < 12:
                width += 1
                limit = (1 << width) - 1
        out.append(last)
        need -= len(last)
        if need <= 0:
            break
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = [(CLEAR, 9)]
    table: dict[bytes, int] = {s: i for i, s in enumerate(_SINGLE[:256])}
    width, nxt, held = 9, 258, b""
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if longer in table:
            held = longer
            continue
        codes.append((table[held], width))
        table[longer] = nxt
        nxt += 1
        held = longer[-1:]
        if nxt == 1 << width and width < 12:
            width += 1
        if nxt == 4094:
            codes.append((CLEAR, width))
            table = {s: j for j, s in enumerate(_SINGLE[:256])}
            width, nxt = 9, 258
    if held:
        codes.append((table[held], width))
        nxt += 1
        if nxt == 1 << width and width < 12:
            width += 1
    codes.append((STOP, width))
    out, acc, have = bytearray(), 0, 0
    for code, w in codes:
        acc = acc << w | code
        have += w
        while have >= 8:
            have -= 8
            out.append(acc >> have & 255)
            acc &= (1 << have) - 1
    if have:
        out.append(acc << (8 - have) & 255)
    return bytes(out)


def unpack(data: bytes, scheme: str, need: int) -> bytes:
    """The first ``need`` bytes, or some more, of a strip or tile."""
    if scheme == "none":
        return data
    if scheme == "packbits":
        return packbits_decode(data, need)
    return lzw_decode(data, need) if scheme == "lzw" else zlib.decompressobj().decompress(data, need)


def widened(raw: bytes, rows: int, across: int, bits: int) -> np.ndarray:
    """Samples of under 8 bits as bytes, rows x ``across``; every row begins at a new byte."""
    size = -(-across * bits // 8)
    each = np.unpackbits(np.frombuffer(raw, np.uint8, rows * size).reshape(rows, size), axis=1)[:, : across * bits]
    return each.reshape(rows, across, bits) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8))


def undo_predictor(block: np.ndarray, predictor: int, bits: int, order: str) -> np.ndarray:
    """block: rows x bytes of pixels of ``samples`` bytes or numbers; shape (rows, width, samples * bits / 8)."""
    rows, width, size = block.shape
    wide = bits // 8
    if predictor == 2:
        numbers = block.reshape(rows, width, -1).view(np.dtype(f"{order}u{wide}"))
        total = np.cumsum(numbers.astype(f"u{wide}"), axis=1, dtype=f"u{wide}")
        return total.astype(np.dtype(f"{order}u{wide}")).view(np.uint8).reshape(rows, width, size)
    if predictor == 3:
        per = size // wide
        flat = block.reshape(rows, -1, per)
        flat = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, wide, width * per)
        numbers = np.swapaxes(flat, 1, 2)
        return np.ascontiguousarray(numbers if order == ">" else numbers[:, :, ::-1]).reshape(rows, width, size)
    return block


@dataclass
class Page:
    width: int
    height: int
    bits: int
    samples: int
    compression: str
    predictor: int
    pixels: bytes


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple | None]]]:
    """(byte order, tags; None where a value is out of range) of each image directory; a chain that turns back on itself ends
    with an error."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF header")
    at, seen = struct.unpack(f"{order}I", data[4:8])[0], set()
    while at:
        if at in seen:
            raise ValueError("image directories form a loop")
        seen.add(at)
        if at + 2 > len(data):
            raise ValueError("image directory out of range")
        (n,) = struct.unpack_from(f"{order}H", data, at)
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
            if kind in FIELD:
                code = f"{order}{count}{FIELD[kind]}"
                where = at + 10 + 12 * i
                try:
                    if struct.calcsize(code) > 4:
                        (where,) = struct.unpack_from(f"{order}I", data, where)
                    tags[tag] = struct.unpack_from(code, data, where)
                except struct.error:
                    tags[tag] = None
        yield order, tags
        (at,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)


USED = [WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES]


def decode(data: bytes, order: str, tags: dict[int, tuple | None]) -> Page:
    if lost := [tag for tag in USED if tag in tags and not tags[tag]]:
        raise ValueError(f"no value of tag {lost[0]}")
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, predictor = one(BITS, 1), one(PREDICTOR, 1)
    scheme = SCHEME.get(one(COMPRESSION, 1))
    if not width or not height:
        raise ValueError("no image size")
    if scheme is None:
        raise ValueError(f"unsupported compression {one(COMPRESSION)}")
    if bits not in (1, 2, 4, 8, 16, 32, 64) or set(tags.get(BITS, (bits,))) != {bits} or predictor not in ((1, 2, 3) if bits >= 8 else (1,)):
        raise ValueError(f"unsupported samples: {bits} bits, predictor {predictor}")
    if not samples or samples < 1:
        raise ValueError("no samples")
    planes = samples if one(PLANAR, 1) == 2 else 1
    size = max(1, bits // 8) * samples // planes
    if width * height * size * planes > MOST_BYTES:
        raise ValueError(f"page of {width * height * size * planes} bytes")
    if TILE_OFFSETS in tags:
        wide, high = one(TILE_WIDTH), one(TILE_HEIGHT)
        offsets, counts = tags[TILE_OFFSETS], tags[TILE_BYTES]
    else:
        wide, high = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, counts = tags[STRIP_OFFSETS], tags[STRIP_BYTES]
    if not wide or not high or wide < 1 or high < 1 or wide * high * size > MOST_BYTES:
        raise ValueError("no size of strips or tiles, or one out of bounds")
    across, down = -(-width // wide), -(-height // high)
    if len(offsets) < across * down * planes or len(counts) < len(offsets):
        raise ValueError("too few strips or tiles")
    out = np.zeros((planes, height, width, size), np.uint8)
    for i in range(across * down * planes):
        plane, y, x = i // (across * down), i // across % down * high, i % across * wide
        rows = high if TILE_OFFSETS in tags else min(high, height - y)
        need = rows * (-(-wide * (samples // planes) * bits // 8))
        raw = unpack(data[offsets[i] : offsets[i] + counts[i]], scheme, need)
        if len(raw) < need:
            raise ValueError("a strip or tile is too short")
        if bits < 8:
            block = widened(raw, rows, wide * size, bits).reshape(rows, wide, size)
        else:
            block = undo_predictor(np.frombuffer(raw, np.uint8, need).reshape(rows, wide, size), predictor, bits, order)
        h, w = min(rows, height - y), min(wide, width - x)
        out[plane, y : y + h, x : x + w] = block[:h, :w]
    pixels = out[0] if planes == 1 else np.moveaxis(out, 0, 2)
    return Page(width, height, bits, samples, scheme, predictor, pixels.tobytes())


def encode(payload: bytes, width: int = 64, scheme: str = "deflate", predictor: int = 1, tile: int = 0, strip_bytes: int = 8192) -> bytes:
    """One 8-bit grey page of ``width`` columns; len(payload) must be a positive multiple of width. tile: height and width of
    tiles (a multiple of 16), or 0 for strips."""
    height = len(payload) // width
    image = np.frombuffer(payload, np.uint8).reshape(height, width)
    blocks = []
    if tile:
        for y in range(0, height, tile):
            for x in range(0, width, tile):
                part = image[y : y + tile, x : x + tile]
                block = np.zeros((tile, tile), np.uint8)
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(block)
    else:
        rows = max(1, strip_bytes // width)
        blocks = [image[y : y + rows] for y in range(0, height, rows)]
    if predictor == 2:
        blocks = [np.diff(b, axis=1, prepend=np.zeros((len(b), 1), np.uint8)) for b in blocks]
    pack = {"none": bytes, "packbits": packbits_encode, "lzw": lzw_encode, "deflate": lambda b: zlib.compress(b, 6)}[scheme]
    stored = [pack(b.tobytes()) for b in blocks]
    code = {name: c for c, name in reversed(SCHEME.items())}[scheme]
    sizes = [len(b) for b in stored]
    starts = [8 + x for x in np.cumsum([0, *sizes[:-1]]).tolist()]
    body = b"".join(stored)
    body += b"\0" * (len(body) % 2)
    extra = 8 + len(body)
    lists = struct.pack(f"<{len(starts)}I", *starts) + struct.pack(f"<{len(sizes)}I", *sizes) if len(sizes) > 1 else b""
    many = lambda i, value: extra + 4 * len(sizes) * i if len(sizes) > 1 else value
    entries = [(WIDTH, 4, 1, width), (HEIGHT, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, code), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
    if tile:
        entries += [(TILE_WIDTH, 4, 1, tile), (TILE_HEIGHT, 4, 1, tile), (TILE_OFFSETS, 4, len(sizes), many(0, starts[0])), (TILE_BYTES, 4, len(sizes), many(1, sizes[0]))]
    else:
        entries += [(STRIP_OFFSETS, 4, len(sizes), many(0, starts[0])), (ROWS_PER_STRIP, 4, 1, max(1, strip_bytes // width)), (STRIP_BYTES, 4, len(sizes), many(1, sizes[0]))]
    entries.sort()
    directory = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", *e) for e in entries) + struct.pack("<I", 0)
    return struct.pack("<2sHI", b"II", 42, extra + len(lists)) + body + lists + directory


def look_of(page: Page) -> str:
    """Mean of the bytes and a 64-bit hash of which of 64 equal runs lie above it."""
    x = np.frombuffer(page.pixels, np.uint8)
    edges = np.linspace(0, len(x), 65).astype(int)
    total = np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    mean = total[-1] / max(1, len(x))
    cells = np.diff(total[edges]) / np.maximum(1, np.diff(edges))
    bits = int("".join("1" if c > mean else "0" for c in cells), 2)
    return f"{mean:.6f}:{bits:016x}"


def tiff_pages(media: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per page: the other columns of ``media``, then page (from 0), width, height, bits, samples, compression,
    predictor, pixels (samples in row order, interleaved, in the file's byte order; those of under 8 bits take a byte each), look
    and error.

    Null or empty media give no row. A page that can't be decoded gives its row with the error in place of the pixels, and the
    pages after it are read; a broken chain of directories ends the file with such a row. Columns with the names of the new ones are replaced.
    """
    kept = without(media, [f.name for f in PAGE if f.name.lower() != media_col.lower()])
    rest = [c for c in kept.columns if c != media_col]
    schema = T.StructType([kept.schema[c] for c in rest] + PAGE)
    kinds = [to_arrow_type(f.dataType) for f in PAGE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source = batch.select(rest)
            rows, index, size = [], [], 0

            def close() -> pa.RecordBatch:
                taken = [c.take(pa.array(index, pa.int64())) for c in source.columns]
                return pa.RecordBatch.from_arrays([*taken, *(pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*rest, *(f.name for f in PAGE)])

            for i, value in enumerate(batch.column(media_col)):
                data = value.as_py()
                if not data:
                    continue
                for row in _rows(data):
                    rows.append(row)
                    index.append(i)
                    size += len(row[7] or b"")
                    if size >= OUT_BYTES:
                        yield close()
                        rows, index, size = [], [], 0
            if rows:
                yield close()

    return kept.mapInArrow(run, schema)


FAILURES = (ValueError, ArithmeticError, KeyError, IndexError, TypeError, MemoryError, struct.error, zlib.error)


def _rows(data: bytes) -> Iterator[tuple]:
    n = 0
    try:
        for order, tags in directories(data):
            try:
                p = decode(data, order, tags)
                row = p.width, p.height, p.bits, p.samples, p.compression, p.predictor, p.pixels, look_of(p), None
            except FAILURES as e:
                row = *[None] * 8, f"{type(e).__name__}: {e}"
            yield n, *row
            n += 1
    except FAILURES as e:
        yield n, *[None] * 8, f"{type(e).__name__}: {e}"


#: How a payload is stored, by its crc32 modulo 4: (scheme, predictor, tile).
LAYOUTS = [("packbits", 1, 0), ("lzw", 1, 0), ("deflate", 2, 0), ("deflate", 1, 64)]


def store_texts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds media: each text's UTF-8 bytes (null: none), padded with bytes 0 to a positive multiple of 64, as one grey TIFF page."""
    kept = without(docs, ["n_bytes", "media"])
    names = [*kept.columns, "n_bytes", "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, sizes, lo, size = [], [], 0, 0
            for i, value in enumerate(batch.column(text_col)):
                data = (value.as_py() or "").encode()
                payload = data + b"\0" * (-len(data) % 64 or (not data) * 64)
                scheme, predictor, tile = LAYOUTS[zlib.crc32(payload) % 4]
                media.append(encode(payload, 64, scheme, predictor, tile))
                sizes.append(len(data))
                size += len(media[-1])
                if size >= OUT_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(media)).columns, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=names)
                    media, sizes, lo, size = [], [], i + 1, 0

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))
