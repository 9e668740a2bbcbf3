"""Vectorised word scanning over the UTF-8 bytes of an Arrow string column.

A batch is cut into slices of SLICE_BYTES (never inside a row), so the numpy
temporaries stay small whatever the batch size.  Words are byte runs; both word
rules used here are decided per byte, because every byte of a non-ASCII
character is >= 0x80.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Some ten times as much are the temporaries, which a worker's heap keeps and which should fit the caches.
SLICE_BYTES = 1 << 18

_B = np.arange(256)
#: A-Z to a-z, all else as it is.
LOWER = np.where((_B >= 65) & (_B <= 90), _B + 32, _B).astype(np.uint8)
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: 0-9, a-z, and all non-ASCII.
ALNUM = (((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_B >= 128))
#: ``[^\x20\x09-\x0D]``.
NONSPACE = ~((_B == 32) | ((_B >= 9) & (_B <= 13)))
#: bytes.translate tables: lower-case, and separators to a blank.
ALNUM_TABLE = bytes(int(LOWER[b]) if ALNUM[b] else 32 for b in range(256))
NONSPACE_TABLE = bytes(int(LOWER[b]) if NONSPACE[b] else 32 for b in range(256))

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


_kept: dict[str, tuple[int | None, object]] = {}


def _stage() -> int | None:
    task = TaskContext.get()
    return task.stageId() if task else None


def let_go() -> None:
    """Free what tasks of other stages kept in this worker: Spark hands its workers on, idle ones too, to all later stages."""
    stage = _stage()
    if old := [k for k, (of, _) in _kept.items() if of != stage]:
        for k in old:
            del _kept[k]
        pa.system_memory_pool().release_unused()


def kept(key: str, make: Callable[[], object]):
    """What ``make`` gives, once for all tasks of a stage in this worker; the next text step of another stage frees it."""
    let_go()
    if key not in _kept:
        _kept[key] = _stage(), make()
    return _kept[key][1]


def binary(column: pa.Array) -> pa.Array:
    """The column's UTF-8 bytes with nulls as empty texts."""
    return pc.fill_null(column, "").cast(pa.large_binary())


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets from 0) for runs of rows of about ``limit`` bytes."""
    let_go()
    if not len(column):
        return
    col = binary(column)
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi
    # Workers are reused by later stages: what this batch no longer needs goes back to the system.
    pa.default_memory_pool().release_unused()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (_BASE, _BASE_INV):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers = out[0], out[1]
    return _powers


def words(buf: np.ndarray, offs: np.ndarray, rule: np.ndarray,
          cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, row) of every word of a slice; ``cut``: bytes that start a word anew."""
    if not len(buf):
        z = np.empty(0, np.int64)
        return z, z, z
    inside = rule[buf]
    edge = offs[(offs > 0) & (offs < len(buf))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    if cut is not None:
        first[cut] = True
        last[cut - 1] = True
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, "right") - 1


def byte_sums(buf: np.ndarray, lower: bool = True) -> np.ndarray:
    """Prefix sums of a polynomial over the (lower-cased) bytes, for ``span_hashes``."""
    p, _ = _power(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(((LOWER[buf] if lower else buf).astype(np.uint64) + np.uint64(1)) * p[:len(buf)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of the bytes behind ``sums``."""
    return mix((sums[ends] - sums[starts]) * _power(len(sums))[1][starts])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of each (lower-cased) word, from prefix sums of a polynomial over the bytes."""
    if not len(starts):
        return np.empty(0, np.uint64)
    return span_hashes(byte_sums(buf, lower), starts, ends)


def shingle_hashes(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of k consecutive words, index of their first word); runs do not cross rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s = h[:n].copy()
    for j in range(1, k):
        s *= _BASE
        s += h[j:j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1:k - 1 + n])
    return mix(s[at] + np.uint64(k)), at
