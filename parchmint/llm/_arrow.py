"""Whole-batch text primitives on Arrow buffers, used inside ``mapInArrow`` operators.

A Spark string column arrives as one byte buffer plus offsets, so words, their hashes and their n-grams are computed
for many documents at once with numpy and no per-word Python objects. Slices of at most ``SLICE_BYTES`` of text (one
document at least) bound the working memory whatever the Arrow batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)

#: Bytes that separate words under the contract definition ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII lower-casing only; every other byte maps to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators for word-character tokens: everything in ASCII but letters and digits.
PUNCT = np.ones(256, bool)
PUNCT[128:] = False
PUNCT[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


class _Kept:
    """Arrays kept between slices; a copy that travels to a worker starts empty."""

    def __init__(self) -> None:
        self.pow = self.ipow = np.zeros(0, np.uint64)

    def __reduce__(self):
        return _Kept, ()


_kept = _Kept()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i mod 2**64 for i < n; grown on demand and kept for the next slice."""
    if len(_kept.pow) < n:
        size = max(n, SLICE_BYTES + (1 << 17))
        _kept.pow, _kept.ipow = _powers(_P, size), _powers(np.uint64(_inverse(int(_P))), size)
    return _kept.pow, _kept.ipow


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n+1 offsets of a string column; null reads as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``rows`` rows whose texts hold at most ``most`` bytes (or one row)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = min(i + rows, max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1))
        yield i, j
        i = j


@dataclass
class Words:
    """Words of consecutive documents: hash, byte range in ``data``, and where each document's words begin."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # n_docs + 1 offsets into hash

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(raw: np.ndarray, off: np.ndarray, separators: np.ndarray = SPACE) -> Words:
    """Words of documents ``raw[off[i]:off[i+1]]``, ASCII lower-cased, with 64-bit hashes of their bytes."""
    n = len(off) - 1
    # one separator after each document keeps words from running across the border
    data = np.full(len(raw) + n, 32, np.uint8)
    text = np.ones(len(data), bool)
    text[off[1:] + np.arange(n)] = False
    data[text] = LOWER[raw]
    inside = np.concatenate(([False], ~separators[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    p, ip = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    total[1:] = data
    total[1:] += np.uint64(1)
    total[1:] *= p[: len(data)]
    np.cumsum(total[1:], out=total[1:])
    h = mix((total[end] - total[start]) * ip[start] + (end - start).astype(np.uint64) * _Q)
    first = np.searchsorted(start, off + np.arange(n + 1))
    return Words(data, h, start, end, first)


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows within a document, and the index of each window's first word."""
    total = len(w.hash)
    if total < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(total - n + 1, np.uint64)
    for k in range(n):
        h = h * _Q + w.hash[k : total - n + 1 + k]
    left = np.repeat(w.first[1:], w.counts)[: total - n + 1] - np.arange(total - n + 1)
    at = np.flatnonzero(left >= n)
    return mix(h[at]), at


def batches(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for bounded slices of a batch's text column."""
    raw, off = strings(batch.column(batch.schema.get_field_index(column)))
    for i, j in slices(off):
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]


def small_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """Let Arrow batches hold ``most`` bytes at most in this session, so that a worker's memory doesn't depend on how long
    the texts are. A smaller limit that the session has stays. The plans that an operator returns run later and read the
    limit then, so it can't be taken back here."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(name, str(most))


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return h.view(np.int64)


def ddl(df, column: str, name: str | None = None) -> str:
    """``name type`` of a column, for the schema of a function on Arrow batches."""
    return f"`{name or column}` {df.schema[column].dataType.simpleString()}"
