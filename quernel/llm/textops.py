"""Vectorised text primitives over Arrow string buffers.

Words are maximal runs of ``[0-9a-z]`` and non-ASCII code points after A-Z is lower-cased, that is
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  In UTF-8 every byte of a non-ASCII code point is >= 0x80,
so one 256-entry table decides per byte; a whole Arrow batch is hashed by a few numpy passes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64


def trim() -> None:
    """Give freed memory back to the system: workers live on from task to task, and others need it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(run: Callable) -> Callable:
    """A mapInArrow function that trims its worker's memory at its end."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return trimmed


def bounded_batches(spark) -> None:
    """Cut Arrow batches by size, too: with long texts, thousands of rows are more than a worker should hold."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # Spark's default
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
#: bytes of text that are hashed at once; bounds the working memory of a task whatever the batch.
SLICE = 1 << 19

LOWER = np.zeros(256, np.uint8)
LOWER[0x30:0x3A] = np.arange(0x30, 0x3A)
LOWER[0x61:0x7B] = np.arange(0x61, 0x7B)
LOWER[0x41:0x5B] = np.arange(0x61, 0x7B)
LOWER[0x80:] = np.arange(0x80, 0x100)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {"n": np.zeros(0, U64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables["n"]) < n:
        size = max(n, SLICE + 4096)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, U64)
            down = np.full(size, _INVERSE, U64)
            up[0] = down[0] = 1
            _tables["n"], _tables["inv"] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _tables["n"], _tables["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(30))
        h = h * U64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> U64(27))
        h = h * U64(0x94D049BB133111EB)
        return h ^ (h >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (int64, n + 1, from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n, at = len(column), column.offset
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind, n + 1, at * kind().itemsize).astype(np.int64)
    data = column.buffers()[2]
    size = int(offsets[-1] - offsets[0])
    raw = np.frombuffer(data, np.uint8, size, int(offsets[0])) if size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run never crosses a row's start."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(inside)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = cuts[cuts > 0] - 1
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of symbols[start:end] of each span; spans ascend and don't overlap."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + SLICE, "right")), i + 1)
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _powers(b - a)
        with np.errstate(over="ignore"):
            total = np.zeros(b - a + 1, U64)
            np.cumsum(symbols[a:b].astype(U64) * up[: b - a], out=total[1:])
            out[i:j] = (total[ends[i:j] - a] - total[starts[i:j] - a]) * down[starts[i:j] - a] + (ends[i:j] - starts[i:j]).astype(U64)
        i = j
    return mix(out)


class Words:
    """The words of a range of rows: lower-cased bytes (0 between words), spans, hashes, row offsets."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        self.low = LOWER[raw]
        self.starts, self.ends = runs(self.low != 0, offsets)
        self.hashes = span_hashes(self.low, self.starts, self.ends)
        self.offsets = np.searchsorted(self.starts, offsets)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) over slices of a batch."""
    for i, j in slices(offsets):
        a, b = int(offsets[i]), int(offsets[j])
        yield i, j, Words(raw[a:b], offsets[i : j + 1] - a)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]], 0 for an empty range."""
    total = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def row_of(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
