"""Vectorised text kernels over Arrow string columns.

A word is a run of ``[^\\x20\\x09-\\x0D]``. All separators are ASCII, so words are
found on the UTF-8 bytes of a whole Arrow column at once, without a Python
object per word. Memory is a small multiple of ``CHUNK`` or of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 18
LONG = 1 << 16  # spans over this many bytes are hashed by xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_U = np.uint64
_rng = np.random.RandomState(20240229)
_BYTE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(_U) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base % 2**64, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _table(name: str) -> np.ndarray:
    if name not in _tables:
        base = _BASE if name == "up" else pow(_BASE, -1, 2**64)
        _tables[name] = _powers(base, CHUNK + LONG + 1)
    return _tables[name]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def columns(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (from 0) of a string column; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    ends = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8, ends[-1] - ends[0], ends[0]), ends - ends[0]


def pieces(array: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive rows of at most ``limit`` bytes (or one row): first row, row
    after the last, bytes, offsets."""
    data, offsets = columns(array)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of words before each row's start."""
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the ``\\n``-split lines, and the number of lines before each row's start."""
    breaks = np.flatnonzero(data == 0x0A)
    row_starts, row_ends = offsets[:-1], offsets[1:]
    starts = np.sort(np.concatenate([row_starts, breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([row_ends, breaks]), kind="stable")
    before = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    return starts, ends, before


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and don't overlap."""
    out = np.zeros(len(starts), _U)
    size = ends - starts
    lo = 0
    up, down = _table("up"), _table("down")
    while lo < len(starts):
        hi = max(int(np.searchsorted(ends, starts[lo] + CHUNK, "right")), lo + 1)
        a, b = int(starts[lo]), int(ends[hi - 1])
        if b - a <= CHUNK + LONG:
            total = np.zeros(b - a + 1, _U)
            np.cumsum(_BYTE[data[a:b]] * up[: b - a], out=total[1:])
            out[lo:hi] = (total[ends[lo:hi] - a] - total[starts[lo:hi] - a]) * down[starts[lo:hi] - a]
        lo = hi
    out = mix(out + size.astype(_U) * _U(0x2545F4914F6CDD1D))
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return out


def grams(h: np.ndarray, n: int, multiplier: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of every ``n`` neighbours of ``h`` (rows are not told apart)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = h[:m].copy()
    for k in range(1, n):
        out *= _U(multiplier)
        out += h[k : k + m]
    return mix(out)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring ``bounds``."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[bounds])
