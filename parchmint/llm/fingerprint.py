"""Document fingerprints by content-defined chunking.

A gear hash rolls over the text's UTF-8 bytes; a chunk ends where its masked bits vanish. Chunking is normalised: before
the normal size a stricter mask makes ends rarer, after it a looser one makes them likelier, between a least and a most
size. Boundaries depend on nearby bytes only, so an insertion moves the boundaries next to it and no others. The
fingerprint is the set of (digest, length) of the chunks; likeness is the share of one document's chunk bytes that the
other document holds too (containment, 0 to 1).
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.llm._arrow import _Q, ddl, mix, powers, slices, small_batches, strings

LEAST, NORMAL, MOST = 16, 48, 255
_WINDOW = 32
#: 48 is between 2**5 and 2**6: a stricter mask of 7 bits before it, a looser one of 4 bits after it.
_STRICT, _LOOSE = np.uint32(0xFE000000), np.uint32(0xF0000000)
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)


def ends(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of all chunks of the documents ``raw[off[i]:off[i+1]]``."""
    n = len(off) - 1
    # zero values between documents keep the window from reaching into the document before
    at = np.arange(len(raw)) + np.repeat(np.arange(n) * _WINDOW, np.diff(off))
    h = np.zeros(len(raw) + n * _WINDOW, np.uint32)
    h[at] = _GEAR[raw]
    width = 1
    while width < _WINDOW:  # h over 2k bytes from two of k bytes
        moved = h[:-width] << np.uint32(width)
        h[width:] += moved
        width *= 2
    h = h[at]
    strict = np.flatnonzero((h & _STRICT) == 0) + 1  # a chunk may end behind this byte
    loose = np.flatnonzero((h & _LOOSE) == 0) + 1
    s_next = np.searchsorted(strict, np.arange(0, len(raw) + 1, 64)).tolist()
    l_next = np.searchsorted(loose, np.arange(0, len(raw) + 1, 64)).tolist()
    strict, loose = [*strict.tolist(), 1 << 62], [*loose.tolist(), 1 << 62]
    starts, stops, doc = [], [], []
    for d, (a, z) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        while a < z:
            stop = z
            if z - a > LEAST:
                low, mid, high = a + LEAST, min(a + NORMAL, z), min(a + MOST, z)
                k = s_next[low >> 6]
                while strict[k] < low:
                    k += 1
                if strict[k] < mid:
                    stop = strict[k]
                else:
                    k = l_next[mid >> 6]
                    while loose[k] < mid:
                        k += 1
                    stop = min(loose[k], high)
            starts.append(a)
            stops.append(stop)
            doc.append(d)
            a = stop
    return np.array(starts, np.int64), np.array(stops, np.int64), np.array(doc, np.int64)


Chunks = tuple[np.ndarray, np.ndarray]


def chunk_sets(texts: list[str]) -> list[Chunks]:
    """Each text's distinct chunks by 64-bit digest: (sorted digests, lengths)."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    off = np.concatenate(([0], np.cumsum([len(x) for x in data]))).astype(np.int64)
    raw = np.frombuffer(b"".join(data), np.uint8)
    a, z, doc = ends(raw, off)
    p, ip = powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=total[1:])
    digest = mix((total[z] - total[a]) * ip[a] + (z - a).astype(np.uint64) * _Q)
    size = (z - a).astype(np.uint8)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        own, at = np.unique(digest[first[i] : first[i + 1]], return_index=True)
        out.append((own, size[first[i] : first[i + 1]][at]))
    return out


def show(chunks: Chunks) -> str:
    """18 hex digits for each chunk: digest, then length."""
    return b"".join(b"%016x%02x" % c for c in zip(chunks[0].tolist(), chunks[1].tolist(), strict=True)).decode()


def read(fingerprint: str) -> Chunks:
    parts = [fingerprint[i : i + 18] for i in range(0, len(fingerprint), 18)]
    return np.array([int(x[:16], 16) for x in parts], np.uint64), np.array([int(x[16:], 16) for x in parts], np.uint8)


def containment(a: Chunks, b: Chunks) -> float:
    """The share of ``a``'s chunk bytes that ``b`` holds; two empty sets are alike, an empty and a full one aren't."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    where = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    size = a[1].astype(np.int64)
    return float(size[b[0][where] == a[0]].sum() / size.sum())


def fingerprints(docs: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` in column ``to``. Null reads as the empty text, whose fingerprint is the
    empty string; equal texts have equal fingerprints; nothing is shuffled; an empty table stays empty."""
    rest = docs.drop(to)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            column = batch.column(batch.schema.get_field_index(text))
            _, off = strings(column)
            out: list[str] = []
            for i, j in slices(off):
                out += map(show, chunk_sets([t or "" for t in column.slice(i, j - i).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, to])

    return rest.mapInArrow(run, T.StructType([*rest.schema.fields, T.StructField(to, T.StringType())]))


#: Rows of one contiguous range of ids, which a task walks in order, and the most ranges.
RANGE_ROWS, MOST_RANGES = 512, 1 << 16
FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@functools.total_ordering
class Key:
    """A row's place in the order: ids descend, nulls come last; rows of one id stand by the hash of their texts."""

    __slots__ = ("h", "id")

    def __init__(self, id_, h: int):
        self.id, self.h = id_, h

    def __eq__(self, other) -> bool:
        return self.id == other.id and self.h == other.h

    def __lt__(self, other) -> bool:
        if self.id == other.id:
            return self.h < other.h
        return other.id is None or self.id is not None and self.id > other.id


def cuts(rows: DataFrame) -> list[Key]:
    """First key of each of the contiguous ranges that ``rows (id, h)`` fall into, about ``RANGE_ROWS`` rows each and
    ``MOST_RANGES`` at most: bounds of a range partitioning of ids and hashes, without the texts. An id that many rows
    share is divided by their texts."""
    n = rows.count()
    dealt = rows.repartitionByRange(max(1, min(MOST_RANGES, -(-n // RANGE_ROWS))), F.desc_nulls_last("id"), "h").sortWithinPartitions(F.desc_nulls_last("id"), "h")

    def first(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    return sorted(Key(r.id, r.h) for r in dealt.mapInArrow(first, dealt.schema).toLocalIterator())


def edited_pairs(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of ``docs``: ``row_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``; the edited text ends in the beginning of the next document by descending id (after the last, the first).

    Ids may be of any type that has an order. Null texts read as empty. Rows that share an id follow each other in the
    order of their texts' hashes, null ids come last; rows equal in id and text stand in one range. A table of one row
    follows itself; an empty table gives an empty table; other columns, whatever their names, are left out. Texts are
    shuffled once: every range also gets the row that follows its last one.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(row_id).alias("id"), F.coalesce(text, F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    heads = cuts(rows.select("id", "h"))
    kind = ddl(rows, "id")

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {x.h: k for k, x in enumerate(heads)}
        for batch in it:
            own, h = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            part = [bisect.bisect_right(heads, Key(i, x)) - 1 for i, x in zip(own, h, strict=True)]
            names = ["id", "text", "h", "part", "ghost"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32()), pa.array([False] * len(own))], names)
            again = [k for k, x in enumerate(h) if x in known and heads[part[k]] == Key(own[k], x)]
            if again:
                took = batch.take(pa.array(again, pa.int64()))
                before = [(part[k] - 1) % len(heads) for k in again]
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(before, pa.int32()), pa.array([True] * len(again))], names)

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []  # the row that waits for its successor
        for batch in it:
            columns = [batch.column(k).to_pylist() for k in (0, 1, 4)]
            _, off = strings(batch.column(1))
            for i, j in slices(off):
                texts = columns[1][i:j]
                row = last + list(zip(columns[0][i:j], texts, columns[2][i:j], chunk_sets(texts), strict=True))
                last = row[-1:]
                yield from emit([(a, b) for a, b in zip(row[:-1], row[1:], strict=True) if not a[2]])

    def emit(pairs: list[tuple[tuple, tuple]]) -> Iterator[pa.RecordBatch]:
        if not pairs:
            return
        edited = [a[1][: len(a[1]) - len(a[1]) // 2] + b[1][: len(a[1]) // 2] for a, b in pairs]
        sets = chunk_sets(edited)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([a[0] for a, _ in pairs], id_type),
                pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([show(a[3]) for a, _ in pairs], pa.string()),
                pa.array([show(e) for e in sets], pa.string()),
                pa.array([containment(a[3], e) for (a, _), e in zip(pairs, sets, strict=True)], pa.float64()),
                pa.array([containment(a[3], b[3]) for a, b in pairs], pa.float64()),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    if not heads:
        return docs.sparkSession.createDataFrame([], f"{kind}, {FIELDS}").withColumnRenamed("id", row_id)
    id_type = rows.limit(0).toArrow().schema.field("id").type
    dealt = rows.mapInArrow(deal, f"{kind}, text string, h long, part int, ghost boolean").repartitionById(len(heads), "part")
    ordered = dealt.sortWithinPartitions("ghost", F.desc_nulls_last("id"), "h")
    return ordered.mapInArrow(walk, f"{kind}, {FIELDS}").withColumnRenamed("id", row_id)


def op7_chunk_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
