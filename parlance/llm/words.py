"""Vectorised words of Arrow text columns: byte spans and 64-bit hashes of whole texts, about a megabyte at a time.

Words are runs of bytes other than space and tab to carriage return; A-Z count as a-z in hashes.  A hash is a polynomial over
random byte values modulo 2**64, read off prefix sums, so no word becomes a Python object.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
HALF_CHUNK = CHUNK_BYTES >> 1  # Where a worker's memory matters more: each byte of a chunk takes some 40 in arrays.
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables():
    byte = np.arange(256, dtype=np.uint64)
    values = mix(byte + np.uint64(0x1234567))
    values[65:91] = values[97:123]
    gap = np.zeros(256, bool)
    gap[[32, 9, 10, 11, 12, 13]] = True
    return values, gap


VALUES, GAP = _tables()
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept per worker and grown when a longer text comes."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = (1 << max(n - 2, 1).bit_length()) + 1  # a chunk's bytes and one more
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base & _MASK, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


@dataclass
class Words:
    """Words of some rows: ``doc`` is the row of each word, ``first`` the index of each row's first word (one more entry at the end)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the rows, first byte and end of each word, and the index of each row's first word (one more entry at the end)."""
    data, offsets = text_buffers(column)
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return data, none, none, np.zeros(len(offsets), np.int64)
    solid = ~GAP[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return data, start, end, np.searchsorted(start, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes' values times powers, from which ``span_hash`` reads the hash of any span."""
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * up[: len(data)], out=total[1:])
    return total


def span_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(total))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def find_words(column: pa.Array) -> Words:
    data, start, end, first = split_words(column)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return Words(data, start, end, doc, first, span_hash(prefix_sums(data), start, end))


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text each; a longer text is a slice of its own."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0)).astype(np.int64)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(size)
    if at < len(sizes):
        yield batch.slice(at)


def runs_hash(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``k`` words of one row, and the index of its first word."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += w.hash[j : j + n] * factor[j]
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    return mix(h[at]), at


def hand_back() -> None:
    """Hands this process's freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def tidy(task):
    """The task, after which its worker hands freed memory back to the system: workers are used again, by tasks that need other memory."""

    def run(batches):
        yield from task(batches)
        hand_back()

    return run


def commonest(counts: DataFrame, count: str, bound: int) -> tuple[DataFrame, int]:
    """Rows with the largest counts, at most ``bound``, as those above a count; and that count.

    The limit is read off how many rows have each count, so tasks never send ``bound`` rows each.
    """
    kept, limit = 0, 0
    for r in sorted(counts.groupBy(count).agg(F.count(F.lit(1)).alias("rows")).collect(), key=lambda r: -r[count]):
        if kept + r["rows"] > bound:
            limit = r[count]
            break
        kept += r["rows"]
    return counts.where(F.col(count) > limit), limit
