"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are cut into word n-grams. Rarity is counted in one pass over the whole corpus, for the n-grams of all items, in
*contexts*: the distinct pairs of words that stand before and behind an n-gram. A passage brings its n-grams the same
contexts however often it has been copied, so copies never make a leak's n-grams look common, while phrases of the
language stand in new contexts all the time. The rarer half of an item's n-grams (by contexts, ties included; those that the
corpus lacks hit nothing) are its rare seeds, whatever the corpus' size: no n-gram is dropped by an absolute count.

In a second pass, texts and items meet where a rare seed hits, or two other n-grams on neighbouring diagonals. A window
about the hits is aligned with the item unless it holds too few of the item's words for any alignment to count
(``possible``, an upper bound). Local alignment over words (match 2, mismatch and gap -1) finds verbatim, edited and partly
copied passages; for reordered ones further alignments of the rest of the item with the rest of the window are added, of
``PART_WORDS`` matches and more. The score is divided by that of the whole item.

Items of fewer words than an n-gram are found where all of their words stand in a row.

The items are a stated query set: they go to the executors in blocks of at most ``BLOCK_WORDS`` words, and each block
meets all rows in one pass. Documents are never shuffled or paired with each other; what the corpus gives back is the
matches and, by n-gram of the items, 64 bits for its contexts. What is found depends neither on the blocks nor on which
rows other items have taken out. Recall, measured on shipped items with words replaced at random: see the README.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm._arrow import PUNCT, Words, batches, ddl, mix, ngrams, signed, small_batches, strings, words

SEED_WORDS = 3
BLOCK_WORDS = 1 << 19
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of the item's full score, and least matching words' worth (an item of fewer words: all of them).
LEAST, LEAST_WORDS = 0.4, 8
#: Least matches of a further part of a reordered passage, and the most parts.
PART_WORDS, PARTS = 5, 4
MATCH_SCHEMA = "item_id {}, score double, first_word long, last_word long"


@dataclass
class Items:
    """A block of test items: word hashes of all, where each begins, and their n-grams. An item that is shorter than an
    n-gram has one ``gram``, of all its words."""

    ids: pa.Array
    hash: np.ndarray
    first: np.ndarray
    gram: np.ndarray  # sorted hashes
    gram_item: np.ndarray
    gram_at: np.ndarray  # word position within the item
    rare: np.ndarray  # of each gram


def _short(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``ngrams`` for fewer words; the hashes of different lengths don't meet."""
    gram, at = ngrams(w, n)
    return mix(gram ^ np.uint64(n)), at


def _items(ids: list, texts: list[str], kind: pa.DataType) -> Items:
    w = words(*strings(pa.array(texts, pa.string())), PUNCT)
    parts = [ngrams(w, SEED_WORDS)]
    for n in range(1, SEED_WORDS):
        gram, at = _short(w, n)
        whole = w.counts[w.doc[at]] == n
        parts.append((gram[whole], at[whole]))
    gram, at = (np.concatenate(x) for x in zip(*parts, strict=True))
    item = w.doc[at]
    order = np.argsort(gram, kind="stable")
    gram, item, at = gram[order], item[order], (at - w.first[:-1][item])[order]
    return Items(pa.array(ids, kind), w.hash, w.first, gram, item.astype(np.int32), at.astype(np.int32), np.ones(len(gram), bool))


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The items with an id and a word, in blocks that fit the driver and a broadcast."""
    ids, texts, size = [], [], 0
    kind = benchmark.select(item_id).limit(0).toArrow().schema.field(0).type
    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(item_id, text).orderBy(item_id, text)
    for r in rows.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1].split())
        if size >= BLOCK_WORDS:
            yield _items(ids, texts, kind)
            ids, texts, size = [], [], 0
    if ids:
        yield _items(ids, texts, kind)


def contexts(docs: DataFrame, items: list[Items], text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """(n-grams of the items that the corpus has, sorted; how many of 64 classes of contexts each stands in). One pass;
    tasks combine what they see, and classes are united by n-gram before anything reaches the driver."""
    sought = np.unique(np.concatenate([x.gram for x in items])) if items else np.zeros(0, np.uint64)
    if not len(sought):
        return sought, np.zeros(0, np.int64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(sought), np.uint64)
        for batch in it:
            for _, _, raw, off in batches(batch, text):
                w = words(raw, off, PUNCT)
                gram, at = ngrams(w, SEED_WORDS)
                k = np.searchsorted(sought, gram)
                k[k == len(sought)] = 0
                some = np.flatnonzero(sought[k] == gram)
                k, at = k[some], at[some]
                doc = w.doc[at]
                before = np.where(at > w.first[doc], w.hash[np.maximum(at - 1, 0)], np.uint64(1))
                behind = np.where(at + SEED_WORDS < w.first[doc + 1], w.hash[np.minimum(at + SEED_WORDS, len(w.hash) - 1)], np.uint64(2))
                np.bitwise_or.at(seen, k, np.uint64(1) << (mix(before * np.uint64(31) + behind) & np.uint64(63)))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(signed(sought[some])), pa.array(signed(seen[some]))], ["gram", "seen"])

    found = docs.select(text).mapInArrow(run, "gram long, seen long").groupBy("gram").agg(F.bit_count(F.bit_or("seen")).alias("n")).toArrow()
    gram, n = found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy().astype(np.int64)
    order = np.argsort(gram)
    return gram[order], n[order]


def rare(items: list[Items], found: tuple[np.ndarray, np.ndarray]) -> list[Items]:
    """The items with their rare seeds marked: the rarer half of what the corpus has of each, ties included."""
    gram, n = found
    out = []
    for x in items:
        k = np.searchsorted(gram, x.gram)
        k[k == len(gram)] = 0
        count = np.where(gram[k] == x.gram, n[k], 0) if len(gram) else np.zeros(len(x.gram), np.int64)
        here = np.flatnonzero(count > 0)
        order = here[np.lexsort((count[here], x.gram_item[here]))]
        item = x.gram_item[order]
        first, size = np.searchsorted(item, np.arange(len(x.first) - 1)), np.bincount(item, minlength=len(x.first) - 1)
        bound = np.zeros(len(x.first) - 1, np.int64)
        has = size > 0
        bound[has] = count[order[(first + (size - 1) // 2)[has]]]
        out.append(replace(x, rare=count <= bound[x.gram_item]))
    return out


def _hits(keys: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``gram``, index into ``keys``) of all equal pairs; ``keys`` is sorted and may repeat."""
    low = np.searchsorted(keys, gram, "left")
    low[low == len(keys)] = 0
    some = np.flatnonzero(keys[low] == gram) if len(keys) else np.zeros(0, np.int64)
    low = low[some]
    n = np.searchsorted(keys, gram[some], "right") - low
    return np.repeat(some, n), np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def possible(item: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether an alignment of ``item`` with each row of ``windows`` can count: the words that they share, repeats
    included, bound the matches of any alignment from above."""
    m = len(item)
    own, times = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(own, windows), len(own) - 1)
    row, column = np.nonzero(own[at] == windows)
    held = np.bincount(row * len(own) + at[row, column], minlength=len(windows) * len(own)).reshape(len(windows), len(own))
    most = MATCH * np.minimum(held, times).sum(1)
    return (most / (MATCH * m) >= LEAST) & (most >= MATCH * min(LEAST_WORDS, m))


def align(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of ``item`` (word hashes; one row for all windows, or a row for each) with each row of
    ``windows`` (0 where there is no word; a 0 in ``item`` matches nothing): score, first and last column, and first and
    last word of the item in the aligned part."""
    n, width = windows.shape
    each = np.broadcast_to(item, (n, item.shape[-1]))
    column = np.arange(width)
    h, start = np.zeros((n, width), np.int32), np.tile(column, (n, 1))
    top = np.zeros((n, width), np.int32)
    best, best_first, best_last = np.zeros(n, np.int32), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    item_first, item_last = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    rows = np.arange(n)
    for i in range(each.shape[1]):
        word = each[:, i : i + 1]
        t, s = np.where((windows == word) & (word != 0), MATCH, MISMATCH).astype(np.int32), np.tile(column, (n, 1))
        u = np.full((n, width), i, np.int32)
        t[:, 1:] += h[:, :-1]
        carried = h[:, :-1] > 0
        s[:, 1:][carried], u[:, 1:][carried] = start[:, :-1][carried], top[:, :-1][carried]
        up = h + GAP
        take = up > t
        t[take], s[take], u[take] = up[take], start[take], top[take]
        low = t <= 0
        t[low], s[low], u[low] = 0, np.broadcast_to(column, t.shape)[low], i
        # gaps in the item: the best value to the left, less one for each column in between
        lifted = t - GAP * column
        run = np.maximum.accumulate(lifted, 1)
        source = np.maximum.accumulate(np.where(lifted == run, column, 0), 1)
        h = run + GAP * column
        start, top = np.take_along_axis(s, source, 1), np.take_along_axis(u, source, 1)
        j = h.argmax(1)
        value = h[rows, j]
        better = value > best
        best[better], best_first[better], best_last[better] = value[better], start[rows, j][better], j[better]
        item_first[better], item_last[better] = top[rows, j][better], i
    return best, best_first, best_last, item_first, item_last


def align_parts(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, first and last column) of each window. Where one alignment isn't enough to count, what is left of the item
    is aligned with what is left of the window, and parts of ``PART_WORDS`` matches' worth and more are added."""
    total, first, last, a, z = align(item, windows)
    bound = max(LEAST * MATCH * len(item), MATCH * min(LEAST_WORDS, len(item)))
    open_ = np.flatnonzero((total >= MATCH * PART_WORDS) & (total < bound))
    if not len(open_):
        return total, first, last
    rest, own = windows[open_].copy(), np.tile(item, (len(open_), 1))
    column, row = np.arange(windows.shape[1]), np.arange(len(item))
    lo, hi, p, q = first[open_], last[open_], a[open_], z[open_]
    for _ in range(PARTS - 1):
        rest[(column >= lo[:, None]) & (column <= hi[:, None])] = 0
        own[(row >= p[:, None]) & (row <= q[:, None])] = 0
        more, lo, hi, p, q = align(own, rest)
        good = more >= MATCH * PART_WORDS
        if not good.any():
            break
        k = open_[good]
        total[k] += more[good]
        first[k], last[k] = np.minimum(first[k], lo[good]), np.maximum(last[k], hi[good])
        open_, rest, own, lo, hi, p, q = k, rest[good], own[good], lo[good], hi[good], p[good], q[good]
    return total, first, last


def find(w: Words, items: Items) -> list[tuple[int, int, float, int, int]]:
    """(document, item index, score, first and last word) of all contaminated documents of a slice; of several
    alignments of one item in one document, the best."""
    size = np.diff(items.first)
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for n in range(1, SEED_WORDS):  # items too short for a seed: all their words in a row
        if not (size == n).any():
            continue
        gram, at = _short(w, n)
        i, k = _hits(items.gram, gram)
        for x, y in zip(at[i].tolist(), items.gram_item[k].tolist(), strict=True):
            d = int(w.doc[x])
            if size[y] == n:
                best.setdefault((d, y), (1.0, x - int(w.first[d]), x - int(w.first[d]) + n - 1))
    gram, at = ngrams(w, SEED_WORDS)
    i, k = _hits(items.gram, gram)
    some = size[items.gram_item[k]] >= SEED_WORDS
    i, k = i[some], k[some]
    item, where, rare_ = items.gram_item[k], at[i], items.rare[k]
    doc, diagonal = w.doc[where], where - items.gram_at[k]
    order = np.lexsort((diagonal, item, doc))
    item, doc, diagonal, rare_ = item[order], doc[order], diagonal[order], rare_[order]
    pad = np.maximum(8, size // 3)
    # hits of one item in one document on neighbouring diagonals make one window
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (np.diff(diagonal) > pad[item[1:]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(item)) - 1 if len(first) else first
    # a window needs a rare seed, or two others
    held = np.concatenate(([0], np.cumsum(rare_)))
    good = (held[last + 1] - held[first] > 0) | (last > first)
    first, last = first[good], last[good]
    lowest, highest = diagonal[first], diagonal[last]
    # windows of one item and width are aligned together
    jobs: dict[int, list[int]] = {}
    for g in range(len(first)):
        jobs.setdefault(int(item[first[g]]), []).append(g)
    for k, groups in jobs.items():
        words_of = items.hash[items.first[k] : items.first[k + 1]]
        m, p = len(words_of), int(pad[k])
        spans = []
        for g in groups:
            d = int(doc[first[g]])
            # a long run of neighbouring diagonals is walked in overlapping windows of bounded width; the parts of a
            # reordered passage lie within an item's length of each other
            for low in range(int(lowest[g]) - p, int(highest[g]) + p + 1, 3 * p):
                spans.append((d, max(low, int(w.first[d])), min(low + m + 5 * p, int(w.first[d + 1]))))
        spans = [(d, max(a - m // 2, int(w.first[d])), min(b + m // 2, int(w.first[d + 1]))) for d, a, b in sorted(set(spans))]
        width = max(b - a for _, a, b in spans)
        for part in range(0, len(spans), 512):
            some = spans[part : part + 512]
            column = np.arange(width)
            begin = np.array([a for _, a, _ in some])[:, None]
            end = np.array([b for _, _, b in some])[:, None]
            index = begin + column
            windows = np.where(index < end, w.hash[np.minimum(index, len(w.hash) - 1)], np.uint64(0))
            able = np.flatnonzero(possible(words_of, windows))
            if not len(able):
                continue
            some = [some[x] for x in able.tolist()]
            value, lo, hi = align_parts(words_of, windows[able])
            least = MATCH * min(LEAST_WORDS, m)
            for (d, a, _), v, x, y in zip(some, value.tolist(), lo.tolist(), hi.tolist(), strict=True):
                score = v / (MATCH * m)
                if score >= LEAST and v >= least and score > best.get((d, k), (0.0,))[0]:
                    base = a - int(w.first[d])
                    best[d, k] = (score, base + x, base + y)
    return [(d, k, *x) for (d, k), x in sorted(best.items())]


def _seeded(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str) -> list[Items]:
    items = list(blocks(benchmark, item_id, item_text))
    return rare(items, contexts(docs, items, text))


def matches(docs: DataFrame, benchmark: DataFrame, row_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it holds: ``row_id, item_id, score`` (share of the item's full score),
    ``first_word, last_word`` of the aligned passage.

    Null and empty texts hold nothing. Items with null id or text, or without a word, can't be found. Ids may be of any
    type. Repeated documents are reported each; two items of the same text both. Other columns, whatever their names, are
    left out. Without documents or items the result is empty.
    """
    small_batches(docs.sparkSession)
    schema = f"{ddl(docs, row_id, '__id')}, {MATCH_SCHEMA.format(benchmark.schema[item_id].dataType.simpleString())}"
    out = None
    for items in _seeded(docs, benchmark, text, item_id, item_text):

        def run(it: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in it:
                own = batch.column(0)
                for i, _, raw, off in batches(batch, "__text"):
                    found = find(words(raw, off, PUNCT), items)
                    d, k, score, a, b = map(list, zip(*found, strict=True)) if found else ([], [], [], [], [])
                    yield pa.RecordBatch.from_arrays(
                        [own.take(pa.array([i + x for x in d], pa.int64())), items.ids.take(pa.array(k, pa.int64())), pa.array(score, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                        ["__id", "item_id", "score", "first_word", "last_word"],
                    )

        part = docs.select(F.col(row_id).alias("__id"), F.col(text).alias("__text")).mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return (docs.sparkSession.createDataFrame([], schema) if out is None else out).withColumnRenamed("__id", row_id)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows in which any item is found (see ``matches``, which has the same rules for nulls, empty
    and repeated texts); all columns, no shuffle. Rarity is counted over all of ``docs``, whatever the blocks."""
    small_batches(docs.sparkSession)
    for items in _seeded(docs, benchmark, text, item_id, item_text):

        def run(it: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in it:
                clean = np.ones(batch.num_rows, bool)
                for i, _, raw, off in batches(batch, text):
                    clean[[i + x[0] for x in find(words(raw, off, PUNCT), items)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
