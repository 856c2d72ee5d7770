"""Vectorised helpers over Arrow string batches (numpy, bounded slices).

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which on
UTF-8 equals the code point class ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
WORD_RE = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
_WS = np.zeros(256, bool)
_WS[[32, *range(9, 14)]] = True
_BASE = U(0xD6E8FEB86659FD93)
_BASE_INV = U(pow(int(_BASE), -1, 1 << 64))
BYTE_HASH = np.random.default_rng(20240611).integers(0, 1 << 64, 256, dtype=np.uint64)
_pow = np.ones(1, np.uint64)
_ipow = np.ones(1, np.uint64)


def release() -> None:
    """Gives freed memory back to the system: workers stay between tasks, and an executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


@functools.cache
def hold() -> None:
    """Freed arrays of some megabytes stay for the next ones until release(), instead of being mapped and cleared anew each time."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 256 << 20)  # M_TRIM_THRESHOLD


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function over batches, with a release() when it has seen them all."""

    def out(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return out


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(col):
    """Number of words of a string column, in the JVM (null: 0)."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_RE)), F.lit(0)).cast("long")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U(31))) * U(0x9E3779B97F4A7C15)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _ipow
    if len(_pow) < n:
        n = max(n, SLICE_BYTES + 1)
        _pow = np.cumprod(np.concatenate([[U(1)], np.full(n, _BASE, np.uint64)]))
        _ipow = np.cumprod(np.concatenate([[U(1)], np.full(n, _BASE_INV, np.uint64)]))
    return _pow, _ipow


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and its len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


class Sums:
    """Hashes of any ranges of a sequence of 64-bit values; equal ranges have equal hashes."""

    def __init__(self, values: np.ndarray):
        pw, self.inverse = _powers(len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * pw[: len(values)], out=self.prefix[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


class Slice:
    """Words, hashes and per-row sums of consecutive rows."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self.n = len(off) - 1
        self.is_word = ~_WS[buf]
        full = off[1:] > off[:-1]
        first, last = off[:-1][full], off[1:][full] - 1
        before = np.zeros(len(buf), bool)
        before[1:] = self.is_word[:-1]
        before[first] = False
        after = np.zeros(len(buf), bool)
        after[:-1] = self.is_word[1:]
        after[last] = False
        self.start = np.flatnonzero(self.is_word & ~before)
        self.end = np.flatnonzero(self.is_word & ~after) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.words = np.bincount(self.doc, minlength=self.n)
        self.word_off = np.concatenate([[0], np.cumsum(self.words)])
        self._sums: Sums | None = None

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte ranges; equal ranges have equal hashes."""
        if self._sums is None:
            self._sums = Sums(BYTE_HASH[self.buf])
        return self._sums.hashes(start, end)

    def word_hashes(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    def per_row(self, flag: np.ndarray) -> np.ndarray:
        """Sum by row of a flag or count by byte."""
        c = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return c[self.off[1:]] - c[self.off[:-1]]


def windows(values: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every n consecutive values (len - n + 1 of them)."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    acc = np.full(m, U(salt))
    for j in range(n):
        acc = acc * U(0x9FB21C651E98DF25) + values[j : j + m]
    return mix(acc)


def within(doc: np.ndarray, n: int) -> np.ndarray:
    """Of every n consecutive units, whether they lie in one row."""
    m = len(doc) - n + 1
    return doc[:m] == doc[n - 1 :] if m > 0 else np.zeros(0, bool)


def cut(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Slice]]:
    """Slices of a column of texts: first row, row after the last, words."""
    buf, off = flat(column)
    for a, b in slices(off, limit):
        yield a, b, Slice(buf[off[a] : off[b]], off[a : b + 1] - off[a])
