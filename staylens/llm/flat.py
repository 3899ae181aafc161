"""Arrow string columns as flat byte arrays, for numpy code inside tasks."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; longer texts form a piece of their own.
PIECE_BYTES = 1 << 21

SPACE_TABLE = np.zeros(256, dtype=bool)
SPACE_TABLE[[0x20, 9, 10, 11, 12, 13]] = True


def strings(column: pa.Array) -> pa.Array:
    """The column as large strings, null as the empty text."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (one row at least)."""
    ends = offsets(column)[1:]
    first, base = 0, ends[0] * 0 if len(ends) else 0
    base = offsets(column)[0] if len(column) else 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, last
        first, base = last, ends[last - 1]


def offsets(column: pa.Array) -> np.ndarray:
    """Byte offsets of a large string column, one more than rows."""
    return np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]


def spaced(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): all texts with a space before the first and after each; starts has one more entry than rows."""
    joined = pc.binary_join_element_wise(column, pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())) if len(column) else column
    at = offsets(joined) if len(joined) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[at[0] : at[-1]] if len(joined) and joined.buffers()[2] else np.zeros(0, np.uint8)
    return np.concatenate([np.array([32], dtype=np.uint8), raw]), at - at[0] + 1


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of True; the first and last entry must be False."""
    change = np.flatnonzero(mask[1:] != mask[:-1]) + 1
    return change[0::2], change[1::2]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Odd base of the polynomial word hash, its inverse modulo 2^64, and a random 64-bit value per byte.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.ones(size, dtype=np.uint64)
        have[1:] = np.uint64(base)
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, from one running sum over all bytes."""
    values = BYTES[raw]
    values *= powers(BASE, len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    got = sums[ends] - sums[starts]
    got *= powers(INVERSE, len(raw))[starts]
    return mix(got + (ends - starts).astype(np.uint64))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of spans, one span after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def release() -> None:
    """Gives memory that is free in this process back to the system (with the GNU C library); a worker kept for later tasks would hold it."""
    with contextlib.suppress(OSError, AttributeError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)
