"""Ragged numpy helpers shared by the text operators.

Operators read text as Arrow buffers inside ``mapInArrow`` tasks: one UTF-8 byte array plus
offsets per batch, cut into pieces of bounded size, so that no Python object per row or token
is needed on the hot path.  Null text counts as empty text everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Text bytes handled at once by the vectorised passes (a longer document is one piece).
PIECE_BYTES = 2 << 20
#: Rows and bytes per Arrow batch: keep a batch of very long texts, or of whole shards, small in the worker.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20

_RNG = np.random.default_rng(20240229)
#: Random 64-bit value of each byte, and the odd base, of the polynomial range hash.
_BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the rows per Arrow batch of this session to ``rows`` (never raise it), and bound its bytes.

    The bound stays with the session, because the plans that the operators return run later.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Rows per Arrow batch while the block's jobs run (rows of whole shards are megabytes each)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (uint8) and row offsets (int64, n + 1) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if "string" in str(column.type) else b"")
    offsets = np.frombuffer(column.buffers()[1] or b"", np.int64 if wide else np.int32)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes each (one longer row is a piece of its own)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ..., of all ranges, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (full avalanche), elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_KEPT_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling; kept up to two pieces' size."""
    kept = _KEPT_POWERS.get(base, np.ones(1, np.uint64))
    if len(kept) >= n:
        return kept[:n]
    size = max(n, PIECE_BYTES + 1)
    out = np.ones(size, np.uint64)
    done = 1
    while done < size:
        step = min(done, size - done)
        out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    if size <= 2 * PIECE_BYTES:
        _KEPT_POWERS[base] = out
    return out[:n]


class RangeHash:
    """64-bit content hash of any byte range of one piece, from prefix sums of
    value(byte) * base ** position; equal ranges hash alike wherever they stand."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[data] * _powers(_BASE, n), out=self.prefix[1:])
        self.inverse = _powers(_INVERSE, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        body = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mix(body + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_ranges(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of word bytes that never cross rows: starts, ends, words per row.

    ``is_word``: boolean table over the 256 byte values.
    """
    n = len(data)
    rows = len(offsets) - 1
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(rows, np.int64)
    inside = is_word[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    before[heads] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[heads[heads > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


#: ASCII white space of the word definitions: blank and 0x09 to 0x0D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: a-z, 0-9 and every byte of a multi-byte character.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return _LOWER[data]


def shingle_hashes(words: np.ndarray, per_row: np.ndarray, size: int
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words per row, and runs per row.

    A row of fewer words, but not none, has one run: all its words.
    """
    n = len(words)
    first = offsets_of(per_row)
    count = np.where(per_row >= size, per_row - size + 1, (per_row > 0).astype(np.int64))
    at = ragged_index(first[:-1], count)
    length = np.repeat(np.minimum(per_row, size), count)
    out = length.astype(np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for j in range(size):
        step = mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[at + j])
        out = step if not n or int(length.min(initial=size)) > j else np.where(length > j, step, out)
    return out, count
