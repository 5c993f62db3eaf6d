"""Vectorised numpy work on the bytes of Arrow string columns.

A *block* is a run of rows whose texts lie one behind the other in one byte
buffer. Blocks are kept near a megabyte, so that every temporary array fits the
processor's cache and memory does not follow the size of an Arrow batch.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

U = np.uint64
BLOCK_BYTES = 1 << 20

#: Space, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


#: Rows of an Arrow batch: texts are long, and a batch lies in memory several times over, on either side.
ARROW_ROWS = 1000
#: Memories that outlive a worker's tasks, as they are dear to fill: modules add theirs.
KEPT: list[dict] = []


def _give_back() -> None:
    """Return memory that is free to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # of the C library on Linux
        ctypes.CDLL(None).malloc_trim(0)


def _forget() -> None:
    """Empty what earlier tasks of this worker have kept."""
    if any(KEPT):
        for memory in KEPT:
            memory.clear()
        _give_back()


def frugal(run, keeps: bool = False):
    """``run``, a function for mapInArrow, with bounded memory.

    At the end of a task it gives back what it no longer needs, since workers
    live on. A task first empties the memories in KEPT, which else would stay
    beside its own, unless ``keeps`` says that its operator fills them. The
    session's limit of rows of a batch is lowered to ARROW_ROWS if it is
    higher, and stays so: Spark reads it when a plan runs.
    """
    spark, key = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark and not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _forget()
        yield from run(batches)
        _give_back()

    return wrapped


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the total) of the runs of non-space bytes within rows."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~IS_SPACE[data]
    starts, ends = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[inner] = solid[inner + 1]
    ends[inner - 1] = solid[inner]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# -- polynomial hashes of any byte range, by prefix sums modulo 2**64 -----------------------------

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), U)
    filled, step = 1, base
    while filled < n:
        take = min(filled, n - filled)
        out[filled : filled + take] = out[:take] * U(step)
        filled, step = filled + take, step * step % (1 << 64)
    return out


_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 16, 1 << (n - 1).bit_length()) if n else 1 << 16
    if size not in _cache:
        tables = _powers(_P, size + 1), _powers(_P_INV, size + 1)
        if size > 4 * BLOCK_BYTES:
            return tables
        _cache.clear()
        _cache[size] = tables
    return _cache[size]


#: One 64-bit value for each byte, from a fixed rule (the mixing function of splitmix64).
def mix(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, U) + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256))


class RangeHash:
    """64-bit hashes of byte ranges of one buffer; equal bytes give equal hashes in any buffer."""

    def __init__(self, data: np.ndarray):
        forth, self.back = _tables(len(data))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * forth[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U))


# -- XXH64 ----------------------------------------------------------------------------------------

_P1, _P2, _P3, _P4, _P5 = (U(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each byte range of ``data``."""
    with np.errstate(over="ignore"):
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
        n = (ends - starts).astype(np.int64)
        at = starts.astype(np.int64).copy()
        acc = np.full(len(n), U(seed) + _P5, U)
        if (big := np.flatnonzero(n >= 32)).size:
            lanes = [np.full(big.size, U((seed + k) % (1 << 64)), U) for k in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
            live, pos, left = np.arange(big.size), at[big].copy(), n[big] // 32
            while live.size:
                for k in range(4):
                    lanes[k][live] = _round(lanes[k][live], eight[pos[live] + 8 * k])
                pos[live] += 32
                left[live] -= 1
                live = live[left[live] > 0]
            out = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
            for v in lanes:
                out = (out ^ _round(np.zeros_like(v), v)) * _P1 + _P4
            acc[big] = out
            at[big] = pos
        acc += n.astype(U)
        for k in range(3):
            on = np.flatnonzero(ends - at >= 8)
            if on.size:
                acc[on] = _rotl(acc[on] ^ _round(np.zeros(on.size, U), eight[at[on]]), 27) * _P1 + _P4
                at[on] += 8
        on = np.flatnonzero(ends - at >= 4)
        if on.size:
            acc[on] = _rotl(acc[on] ^ ((eight[at[on]] & U(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
            at[on] += 4
        for k in range(3):
            on = np.flatnonzero(ends - at >= 1)
            if on.size:
                acc[on] = _rotl(acc[on] ^ ((eight[at[on]] & U(0xFF)) * _P5), 11) * _P1
                at[on] += 1
        acc = (acc ^ (acc >> U(33))) * _P2
        acc = (acc ^ (acc >> U(29))) * _P3
        return acc ^ (acc >> U(32))
