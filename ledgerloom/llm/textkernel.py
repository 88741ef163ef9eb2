"""Vectorised word splitting and hashing over Arrow string columns.

Works on the UTF-8 bytes in place: a word is a maximal run of word bytes inside one row. A word's 64-bit value is a
polynomial in its bytes, taken from one running sum over the chunk: ``(S[end] - S[start]) * B**-start`` modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15
SECOND = 0xC2B2AE3D27D4EB4F
#: Bytes of text that one step works on (one row at least).
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_VALUES = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, U)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


@dataclass(frozen=True)
class Alphabet:
    """fold: byte to byte (case); kind: byte to kind, 0 between words; a word is a run of bytes of one kind."""

    fold: np.ndarray
    kind: np.ndarray


def _fold_ascii() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def _kinds(blank: list[int]) -> np.ndarray:
    t = np.ones(256, np.uint8)
    t[blank] = 0
    return t


SPACES = [0x20, *range(0x09, 0x0E)]
#: ``[^\x20\x09-\x0D]+`` unchanged, and with A-Z lower-cased.
BLANK_WORDS = Alphabet(np.arange(256, dtype=np.uint8), _kinds(SPACES))
BLANK_WORDS_LOWER = Alphabet(_fold_ascii(), _kinds(SPACES))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z: digits, letters and every byte over 0x7F.
LETTER_WORDS = Alphabet(_fold_ascii(), _kinds([i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122)]))
#: Runs of letters (lower-cased, with every byte over 0x7F), of digits, and of other visible characters.
TYPED_RUNS = Alphabet(_fold_ascii(), np.array([0 if i in SPACES else 1 if i > 127 or 65 <= i <= 90 or 97 <= i <= 122 else 2 if 48 <= i <= 57 else 3 for i in range(256)], np.uint8))


@dataclass
class Words:
    """Words of the rows lo..hi of a column. ptr: row to its first word; start and end: bytes in data (folded)."""

    lo: int
    hi: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    value: np.ndarray
    ptr: np.ndarray

    def text(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()

    def texts(self, a: int, b: int) -> list[bytes]:
        return [self.text(i) for i in range(a, b)]


def rows_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, at


def chunks(at: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows whose bytes are at most ``most``, one row at least."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(col: pa.Array, alphabet: Alphabet) -> Iterator[Words]:
    raw, at = rows_of(col)
    for lo, hi in chunks(at):
        data = alphabet.fold[raw[at[lo] : at[hi]]]
        ptr_bytes = at[lo : hi + 1] - at[lo]
        kind = alphabet.kind[data]
        inside = kind > 0
        n = len(data)
        first, last = inside.copy(), inside.copy()
        if n:
            other = kind[1:] != kind[:-1]
            first[1:] &= other
            last[:-1] &= other
            edge = ptr_bytes[:-1][ptr_bytes[:-1] < n]
            first[edge] = inside[edge]
            edge = edge[edge > 0] - 1
            last[edge] = inside[edge]
        start = np.flatnonzero(first)
        end = np.flatnonzero(last) + 1
        up, down = _powers(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(_VALUES[data] * up[:n], out=total[1:])
        value = mix((total[end] - total[start]) * down[start] + (end - start).astype(U))
        yield Words(lo, hi, data, start, end, value, np.searchsorted(start, ptr_bytes))


def windows(value: np.ndarray, k: int, base: int = BASE) -> np.ndarray:
    """One value for each run of k neighbouring words, also across rows (``starts`` says which to use)."""
    n = len(value) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = value[:n].copy()
    for j in range(1, k):
        out *= U(base)
        out += value[j : j + n]
    return mix(out + U(k))


def starts(ptr: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which k words of one row begin, and the row of each."""
    n = np.maximum(np.diff(ptr) - k + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ptr[:-1], n), row
