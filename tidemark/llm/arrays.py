"""Arrow string columns as flat byte arrays, and polynomial hashes over them.

Used inside tasks only: a batch of texts is one array of UTF-8 bytes plus row offsets, so that work on
characters, words and lines runs over the whole batch at once instead of text by text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SLICE_BYTES = 8 << 20  # bytes of text worked on at once; bounds a task's memory


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string or binary column; a null is an empty row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if where is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    width = np.int64 if big else np.int32
    at = np.frombuffer(where, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the machine at the end of a task: Python workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text; a longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + most, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
    give_back()


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE ** 0 .. BASE ** (n - 1) modulo 2**64, or of its inverse; kept for the next call."""
    key, base = ("-", BASE_INVERSE) if inverse else ("+", BASE)
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _POWERS[key] = np.multiply.accumulate(have)
    return have[:n]


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of (values[j] + 1) * BASE ** j over j < i; one longer than `values`."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span [start, end), the same wherever the span lies."""
    return (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]


# Hashes modulo a prime: no pair of texts collides for every base, as Thue-Morse strings do modulo 2**64.
MOD = np.uint64((1 << 61) - 1)
MOD_BASE = 0x0B5D1F3A9C86E247  # drawn at random once
_LOW, _31, _30, _61 = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64(30), np.uint64(61)
SPAN_BYTES = 1 << 18  # bytes of spans hashed at once


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo MOD."""
    x = (x & MOD) + (x >> _61)
    return np.where(x >= MOD, x - MOD, x)


def _up31(x: np.ndarray) -> np.ndarray:
    """x * 2**31 modulo MOD for x < 2**61: a turn of 61 bits."""
    return ((x << _31) & MOD) + (x >> _30)


def mod_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo MOD for a, b < MOD."""
    a1, a0, b1, b0 = a >> _31, a & _LOW, b >> _31, b & _LOW
    middle = a1 * b0 + a0 * b1
    return _fold(np.uint64(2) * a1 * b1 + (middle >> _30) + ((middle & np.uint64((1 << 30) - 1)) << _31) + _fold(a0 * b0))


_MOD_POWERS: dict[int, np.ndarray] = {}


def mod_powers(n: int, inverse: bool = False) -> np.ndarray:
    """MOD_BASE ** 0 .. MOD_BASE ** (n - 1) modulo MOD, or of its inverse. Kept up to SPAN_BYTES of them."""
    base = pow(MOD_BASE, -1, int(MOD)) if inverse else MOD_BASE
    have = _MOD_POWERS.get(base, np.ones(1, np.uint64))
    while len(have) < n:
        step = np.full(len(have), pow(base, len(have), int(MOD)), np.uint64)
        have = np.concatenate((have, mod_product(have, step)))
    _MOD_POWERS[base] = have if len(have) <= SPAN_BYTES else have[:SPAN_BYTES].copy()
    return have[:n]


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash modulo MOD of each span [start, end) of bytes, with its length; spans are in order and do not overlap.

    A span's powers begin with itself, so tables are as long as the longest span and not as the text.
    """
    out = np.zeros(len(start), np.uint64)
    first = 0
    while first < len(start):
        last = max(first + 1, int(np.searchsorted(end, start[first] + SPAN_BYTES, side="right")))
        a, b = int(start[first]), int(end[last - 1])
        s, e = start[first:last] - a, end[first:last] - a
        begin = np.zeros(b - a + 1, np.int64)
        begin[s] = s
        within = np.arange(b - a + 1) - np.maximum.accumulate(begin)
        power = mod_powers(int((e - s).max()) + 1)
        power = power[np.minimum(within, len(power) - 1)]
        value = np.zeros(b - a + 1, np.uint64)
        value[:-1] = raw[a:b]
        value += np.uint64(1)
        bounds = np.column_stack((s, e)).ravel()
        high = np.add.reduceat(value * (power >> _31), bounds)[::2]
        low = np.add.reduceat(value * (power & _LOW), bounds)[::2]
        out[first:last] = np.where(e > s, _fold(_up31(_fold(high)) + _fold(low)), 0)
        first = last
    return mix(out + mix((end - start).astype(np.uint64)))


def mod_prefix(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of values[j] * MOD_BASE ** j over j < i modulo MOD, for any 64-bit values."""
    terms = mod_product(_fold(values), mod_powers(len(values)))
    out = np.zeros(len(values) + 1, np.uint64)
    high, low = np.cumsum(terms >> _31, dtype=np.uint64), np.cumsum(terms & _LOW, dtype=np.uint64)
    out[1:] = _fold(_up31(_fold(high)) + _fold(low))
    return out


def mod_spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash modulo MOD of each span [start, end) of the values of `prefix`, the same wherever it lies."""
    gap = prefix[end] + MOD - prefix[start]
    return mod_product(_fold(gap), mod_powers(len(prefix), inverse=True)[start])


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (finaliser of a 64-bit mixer)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word ``[^\\x20\\x09-\\x0D]+``; words end with their row."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[at] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | cut[1:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | cut[1:-1]
    start = np.flatnonzero(opens)
    return start, np.flatnonzero(closes) + 1, np.searchsorted(at, start, side="right") - 1


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[raw]


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
