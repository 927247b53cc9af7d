"""Exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence matrix with its transpose.

Two documents link when ``5 * |A & B| >= 4 * |A | B|`` for their sets of distinct 5-word shingles. The product is masked
by bounds that follow from the sizes alone. With |A| = a and |B| = b the overlap must reach ``ceil(4 (a + b) / 9)``; so
if every document's shingles are in one global order, a linked pair shares a shingle among the first
``a - ceil(4 (a + b) / 9) + 1`` of A and as many of B. Columns of the incidence matrix (blocks of shingle hashes) are
therefore multiplied over these prefixes only; rows that meet there, and whose sizes and positions still allow the
overlap, are accumulated in full and compared exactly.

* Order: shingles that many documents share (found by counting in every task) stand last, the others by hash. The order
  decides only how much is compared, never the result.
* Equal sets are one row of the matrix, whatever the number of copies. A row is named by a 64-bit signature of its set; a
  second one tells whether two sets share a name, and the few that do (by birthday, n**2 / 2**65) are named anew.
* Within a column, rows are first compared with the one that shares most of its prefix (near copies' common source, or
  the least changed of them), and links are closed to components. What lies in different components of a column is then
  compared in full: long columns by dense blocks of rows times rows, which give one link for each two components; short
  ones as pairs, of which those are discarded whose overlap over the prefixes and sizes rule a link out. So no link
  between components is missed, and a group of thousands of near copies is never spelled out as pairs.
* Columns of shared shingles are salted by their counts, so no task gets all rows of a hot group. A shingle is shared if
  some ``_WINDOW`` of a task's shingles holds it ``SHARED_LOCAL`` times; of one that is spread more thinly a column has at
  most ``SHARED_LOCAL - 1`` rows for each window (some 12 MB of text), and one beyond the ``SHARED_MOST`` most shared has no
  more than a ``SHARED_MOST``-th of all shared occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.llm._arrow import Words, batches, ddl, mix, ngrams, signed, small_batches, words
from parchmint.llm._scratch import discard, stage

SHINGLE = 5
#: Shingles that this many of a task's recent documents share are counted as shared; as many are kept at most. Both only
#: steer the order of comparison.
SHARED_LOCAL, SHARED_MOST = 4, 1 << 18
_WINDOW = 1 << 21
_RENAME = np.uint64(0x8EBC6AF09C88C6E3)
#: Sub-columns of a shared shingle: at least so many, and one more for so many occurrences.
SALTS, SALT_ROWS = 64, 50_000
#: Bits of the filter that tells which rows are compared in full, at most.
FILTER_BITS = 1 << 27
#: Tasks over which the links of one node are dealt, one bit of a long each.
SPREAD = 64
#: Columns of so many rows are multiplied in dense blocks of so many rows by as many.
BLOCK_ROWS, BLOCK = 400, 256


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, 52-bit shingle hash) of all distinct shingles of each document, sorted. Fewer words than a shingle are
    one shingle together; no words, none. At most 4,096 documents at once."""
    gram, at = ngrams(w, SHINGLE)
    doc = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    if len(short):
        whole = mix(np.array([_fold(w.hash[w.first[d] : w.first[d + 1]]) for d in short], np.uint64))
        gram, doc = np.append(gram, whole), np.append(doc, short)
    key = np.sort((doc.astype(np.uint64) << np.uint64(52)) | (gram >> np.uint64(12)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key >> np.uint64(52)).astype(np.int64), key & np.uint64((1 << 52) - 1)


def _fold(h: np.ndarray) -> int:
    out = 0x51ED270B7F4A7C15 * len(h)
    for x in h.tolist():
        out = (out * 0xC2B2AE3D27D4EB4F + x) & 0xFFFFFFFFFFFFFFFF
    return out


Clash = tuple[np.ndarray, np.ndarray]


def signatures(doc: np.ndarray, gram: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, name, second signature) of each document's set, 64 bits each."""
    first = np.searchsorted(doc, np.arange(n + 1))
    size = np.diff(first)

    def of(salt: int) -> np.ndarray:
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(gram ^ np.uint64(salt)))))
        return mix((total[first[1:]] - total[first[:-1]]) ^ size.astype(np.uint64))

    return size, of(0xA0761D6478BD642F), of(0xE7037ED1A0B428DB)


def _renamed(node: np.ndarray, check: np.ndarray, clash: np.ndarray) -> np.ndarray:
    """Names of sets; those whose name is in ``clash`` (sorted) get one of their second signature."""
    if not len(clash):
        return node
    k = np.minimum(np.searchsorted(clash, node), len(clash) - 1)
    return np.where(clash[k] == node, mix(check + _RENAME), node)


def _named(doc: np.ndarray, gram: np.ndarray, n: int, clash: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size, node, check = signatures(doc, gram, n)
    return size, _renamed(node, check, clash)


def _sets(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    """Rows ``id, n, node, sign`` for documents and ``gram, times`` for shingles that a task found shared by different
    sets."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        names = ["id", "n", "node", "sign", "gram", "times"]

        def shared() -> pa.RecordBatch:
            gram, times = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            some = times >= SHARED_LOCAL
            none = pa.nulls(int(some.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(none), kind), none, none, none, pa.array(signed(gram[some])), pa.array(times[some])], names)

        for batch in it:
            for i, j, raw, off in batches(batch, "text"):
                doc, gram = shingles(words(raw, off))
                size, node, check = signatures(doc, gram, j - i)
                held.append(gram[_fresh(node, seen)[doc]])
                none = pa.nulls(j - i, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size), pa.array(signed(node)), pa.array(signed(check)), none, none], names)
                if sum(map(len, held)) > _WINDOW:
                    yield shared()
        if held:
            yield shared()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    kind = rows.limit(0).toArrow().schema.field("id").type
    return rows.mapInArrow(run, f"{ddl(rows, 'id')}, n long, node long, sign long, gram long, times long")


def _clashes(rows: DataFrame) -> np.ndarray:
    """Names that different sets share, sorted: one aggregation; by birthday few at any size."""
    both = rows.where("n > 0").groupBy("node").agg(F.min("sign").alias("a"), F.max("sign").alias("z")).where("a <> z").select("node").toArrow()
    return np.sort(both["node"].to_numpy().view(np.uint64))


def _fresh(node: np.ndarray, seen: set[int]) -> np.ndarray:
    """Whether each set is new to this task; ``seen`` is forgotten when it grows long."""
    if len(seen) > 1 << 20:
        seen.clear()
    out = np.zeros(len(node), bool)
    for k, x in enumerate(node.tolist()):
        if x not in seen:
            seen.add(x)
            out[k] = True
    return out


def _prefixes(docs: DataFrame, text: str, shared: tuple[np.ndarray, np.ndarray], clash: np.ndarray) -> DataFrame:
    """``gram, node, size`` (``n << 32 | position << 1 | shared``) ``, salt`` for the longest prefix that any partner asks
    for."""
    keys, rank = shared
    salts = np.maximum(SALTS, -(-rank // SALT_ROWS)).astype(np.uint64)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # sets that this task has given; forgotten when it grows long
        for batch in it:
            for i, j, raw, off in batches(batch, text):
                doc, gram = shingles(words(raw, off))
                size, node = _named(doc, gram, j - i, clash)
                pick = _fresh(node, seen)[doc]
                doc, gram = doc[pick], gram[pick]
                k = np.searchsorted(keys, gram)
                k[k == len(keys)] = 0
                late = keys[k] == gram if len(keys) else np.zeros(len(gram), bool)
                # shingles that aren't shared come first, by hash, as they stand; then the shared ones by number
                n, first = size[doc], np.searchsorted(doc, doc)
                early = np.concatenate(([0], np.cumsum(~late)))
                at = early[:-1] - early[first]
                some = np.flatnonzero(late)
                if len(some):
                    some = some[np.lexsort((gram[some], rank[k[some]], doc[some]))]
                    end = np.searchsorted(doc, doc[some], "right")
                    at[some] = early[end] - early[first[some]] + np.arange(len(some)) - np.searchsorted(doc[some], doc[some])
                keep = at <= n - (4 * n + 4) // 5
                value = (n[keep].astype(np.int64) << 32) | (at[keep] << 1) | late[keep]
                salt = np.zeros(len(gram), np.uint64)
                salt[some] = mix(node[doc[some]]) % salts[k[some]]
                yield pa.RecordBatch.from_arrays([pa.array(signed(gram[keep])), pa.array(signed(node[doc[keep]])), pa.array(value), pa.array(salt[keep].astype(np.int32))], ["gram", "node", "size", "salt"])

    return docs.select(text).mapInArrow(run, "gram long, node long, size long, salt int")


def _may_link(a: str, b: str) -> str:
    """SQL: whether rows with sizes and positions ``na, pa`` and ``nb, pb`` in one column can still reach the overlap, and
    the column lies in both prefixes that this pair of sizes asks for."""
    need = f"((4 * (n{a} + n{b}) + 8) div 9)"
    return f"(p{a} <= n{a} - {need} AND p{b} <= n{b} - {need} AND 5 * least(n{a}, n{b}) >= 4 * greatest(n{a}, n{b}) AND least(p{a}, p{b}) + 1 + least(n{a} - 1 - p{a}, n{b} - 1 - p{b}) >= {need})"


class _Filter:
    """A Bloom filter of bounded size, made where the keys are."""

    def __init__(self, nodes: DataFrame, count: int):
        bits = 1 << int(np.clip(np.ceil(np.log2(16 * max(count, 1))), 16, np.log2(FILTER_BITS)))
        piece = 1 << 16

        def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            on = np.zeros(bits, bool)
            for batch in it:
                for at in _Filter.places(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits):
                    on[at] = True
            some = np.flatnonzero(on.reshape(-1, piece).any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([np.packbits(on[k * piece : (k + 1) * piece]).tobytes() for k in some], pa.binary())], ["piece", "bits"])

        def either(table: pa.Table) -> pa.Table:
            out = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()])
            return pa.table([table["piece"][:1], pa.array([out.tobytes()], pa.binary())], names=["piece", "bits"])

        found = nodes.select("node").mapInArrow(mark, "piece int, bits binary").groupBy("piece").applyInArrow(either, "piece int, bits binary").collect()
        self.on = np.zeros(bits // 8, np.uint8)
        for k, x in found:
            self.on[k * piece // 8 : (k + 1) * piece // 8] = np.frombuffer(x, np.uint8)
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
        return [(mix(keys + np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in (1, 2, 3)]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self.places(keys, self.bits):
            out &= (self.on[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return out


def _rows_of(docs: DataFrame, text: str, nodes: DataFrame, clash: np.ndarray) -> DataFrame:
    """``node, grams`` (the whole set) of the named rows of the matrix, once each."""
    wanted = _Filter(nodes, nodes.count())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in it:
            for i, j, raw, off in batches(batch, text):
                doc, gram = shingles(words(raw, off))
                size, node = _named(doc, gram, j - i, clash)
                d = np.flatnonzero(wanted.holds(node) & (size > 0))
                d = d[_fresh(node[d], seen)]
                first = np.searchsorted(doc, np.arange(j - i + 1))
                flat = np.concatenate([gram[first[x] : first[x + 1]] for x in d]) if len(d) else gram[:0]
                offsets = np.concatenate(([0], np.cumsum(size[d]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(signed(node[d])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(flat)))], ["node", "grams"])

    found = docs.select(text).mapInArrow(run, "node long, grams array<long>")
    return found.dropDuplicates(["node"])  # the filter's few strangers do no harm


def _verified(docs: DataFrame, text: str, pairs: DataFrame, clash: np.ndarray) -> DataFrame:
    """The pairs ``a, b`` that link, by their full overlap."""
    pairs = stage(pairs.select("a", "b"), "jaccard-chosen")
    nodes = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-nodes")
    rows = _rows_of(docs, text, nodes, clash)  # dealt by node once: both joins read the same exchange
    one = pairs.join(rows.select(F.col("node").alias("b"), F.col("grams").alias("gb")), "b")
    both = one.join(rows.select(F.col("node").alias("a"), F.col("grams").alias("ga")), "a")
    both = both.withColumn("same", F.size(F.array_intersect("ga", "gb"))).where("5 * same >= 4 * (size(ga) + size(gb) - same)")
    links = stage(both.select("a", "b"), "jaccard-links")
    discard(nodes, pairs)
    return links


def _least(edges: DataFrame) -> DataFrame:
    """``u, v, m``: each edge with the least ``v`` of its ``u``. The edges of one ``u`` are dealt over ``SPREAD`` tasks: a mask
    tells in which of them it stands, so the least goes there and nowhere else."""
    edges = edges.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SPREAD)).cast("int"))
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.bit_or(F.expr("shiftleft(1L, s)")).alias("mask"))
    places = F.expr(f"explode(filter(sequence(0, {SPREAD - 1}), x -> getbit(mask, x) = 1))")
    return edges.join(least.select("u", "m", places.alias("s")), ["u", "s"]).select("u", "v", "m")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for all nodes of ``links`` (a, b): the least node that links lead to. Alternating large and small
    stars; each round is written, so nothing of an earlier round is computed again. A node with many links, such as the
    source of a large group of near copies, is dealt over several tasks in every step."""
    edges = stage(links.where("a <> b").select("a", "b").distinct(), name)
    while True:
        both = _least(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a")))
        both = both.withColumn("m", F.least("u", "m"))
        large = stage(both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), name)
        down = _least(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = down.select(F.inline(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))))
        small = stage(small.where("a <> b").distinct(), name)
        discard(edges, large)
        edges = small
        # done when every node points straight at one root: none points at two, or is pointed at and points on
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out + into > 1 AND out > 0").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edges.select("b", "b").distinct())


def linked(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(rows ``id, n, node`` of all documents; ``node, component_id, main`` of every set that isn't empty; names that were
    given anew).

    Null and empty texts have the empty set. Rows of equal sets are one node, whatever their ids, which may be of any type
    that has an order; a component's id is the least id of its documents (null where none has one), ``main`` a set that has
    it. An empty table gives empty tables.
    """
    found = stage(_sets(docs, row_id, text), "jaccard-documents")
    rows = found.where("node IS NOT NULL").select("id", "n", "node", "sign")
    clash = _clashes(rows)
    if len(clash):

        def rename(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                node, sign = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (2, 3))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(signed(_renamed(node, sign, clash))), batch.column(3)], batch.schema.names)

        rows = rows.mapInArrow(rename, rows.schema)
    rows = rows.drop("sign")
    top = found.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "gram").limit(SHARED_MOST).toArrow()
    keys, times = top["gram"].to_numpy().view(np.uint64), top["times"].to_numpy()
    order = np.argsort(keys)
    entries = _prefixes(docs, text, (keys[order], times[order]), clash)
    # columns with more than one row; copies of a set that several tasks gave stand side by side
    column = Window.partitionBy("gram", "salt").orderBy("n", "node")
    entries = entries.withColumn("n", F.shiftright("size", 32).cast("int"))
    entries = entries.withColumns({"less": F.lag(F.struct("n", "node")).over(column), "more": F.lead(F.struct("n", "node")).over(column), "lo": F.min("node").over(Window.partitionBy("gram", "salt")), "hi": F.max("node").over(Window.partitionBy("gram", "salt"))})
    # rows stand by size: one whose neighbours are both out of its reach links with nothing in this column
    near = "lo < hi AND (5 * less.n >= 4 * n OR 5 * n >= 4 * more.n) OR size % 2 = 1"
    entries = entries.where(f"(less IS NULL OR less.node <> node) AND ({near})")
    entries = stage(entries.select("gram", "node", "n", F.expr("CAST((size & 4294967295L) >> 1 AS int)").alias("p"), F.expr("CAST(size & 1 AS boolean)").alias("shared"), "salt"), "jaccard-columns")
    roots = _closed(None, _verified(docs, text, _star(entries), clash))
    cells = entries.withColumn("root", F.col("node")) if roots is None else entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    cells = _open(cells)
    long = cells.where(F.col("rows") >= BLOCK_ROWS)
    if not long.isEmpty():
        long = stage(long, "jaccard-long")
        was, roots = roots, _closed(roots, _product(docs, text, long, clash))
        if roots is not None:
            # components that have become one
            old = roots.withColumnRenamed("root", "new")
            old = old.withColumn("root", F.col("node")) if was is None else old.join(was, "node", "left").withColumn("root", F.coalesce("root", "node"))
            moved = stage(old.where("root <> new").select("root", "new").distinct(), "jaccard-moved")
            cells = _open(cells.drop("rows", "main").join(moved, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new"))
        # what two rows share in the long columns is compared; here it only counts towards the bound
        done = stage(long.groupBy("node").agg(F.count("*").cast("int").alias("done")), "jaccard-done")
        cells = cells.join(done, "node", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    else:
        cells = cells.withColumn("done", F.lit(0))
    roots = _closed(roots, _verified(docs, text, _cross(cells.where(F.col("rows") < BLOCK_ROWS)), clash))

    classes = stage(rows.where("n > 0").groupBy("node").agg(F.min("id").alias("least")), "jaccard-classes")
    if roots is None:
        return rows, classes.select("node", F.col("least").alias("component_id"), F.col("node").alias("main")), clash
    joined = stage(classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-classes")
    # the least id, nulls last, and of the sets that have it the least name
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node"))
    least = stage(joined.groupBy("root").agg(first.alias("m")).select("root", F.col("m.least").alias("component_id"), F.col("m.node").alias("main")), "jaccard-least")
    out = stage(joined.join(least, "root").select("node", "component_id", "main"), "jaccard-components")
    discard(classes, joined, least, entries)
    return rows, out, clash


def _closed(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """Components of what is known already (as one star each) and new links."""
    if links.isEmpty():
        return roots
    known = links.select("a", "b")
    if roots is not None:
        known = known.unionAll(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    return stage(components(known), "jaccard-roots")


def _open(cells: DataFrame) -> DataFrame:
    """Cells (with their component's ``root``) of the columns in which more than one component is left, with the column's
    ``rows`` and its largest component ``main``."""
    size = cells.groupBy("gram", "root").count()
    left = size.groupBy("gram").agg(F.sum("count").alias("rows"), F.max(F.struct("count", "root")).alias("main"))
    left = stage(left.where("main.count < rows").select("gram", F.col("rows").cast("int").alias("rows"), F.col("main.root").alias("main")), "jaccard-open")
    out = stage(cells.join(left, "gram"), "jaccard-cells")
    discard(left)
    return out


def _star(cells: DataFrame) -> DataFrame:
    """Pairs of a leader and each other row in its column and size class. The row leads in whose order the column comes
    first: unshared shingles stand before, so it is the least changed one."""
    # sizes within a factor of 1.3 stand together
    kind = F.floor(F.log(1.3, F.col("n").cast("double"))).cast("int")
    cells = cells.withColumn("kind", kind)
    me, first = F.struct("node", "n", "p"), [F.col("p") / F.col("n"), "node"]
    led = lambda rows, *by: rows.withColumn("lead", F.first(me).over(Window.partitionBy(*by).orderBy(*first)))
    # leaders of a shared shingle's sub-columns are compared with the first of them
    heads = led(led(cells.where("shared"), "gram", "kind", "salt").where("lead.node = node"), "gram", "kind")
    pairs = led(cells, "gram", "kind", "salt").unionByName(heads).where("lead.node <> node")
    pairs = pairs.select(F.col("lead.node").alias("a"), F.col("node").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"), F.col("lead.p").alias("pa"), F.col("p").alias("pb"))
    # a row is compared with the one that leads it most often, if that is in a fair part of its prefix (a passage that
    # many documents share makes a leader of few columns); what this leaves out is compared later, like all the rest
    often = pairs.where(_may_link("a", "b")).groupBy("a", "b").agg(F.count("*").alias("c"), F.first("nb").alias("n")).where("33 * c >= n")
    best = often.groupBy("b").agg(F.max(F.struct("c", "a")).alias("m"))
    return best.select(F.least("m.a", "b").alias("a"), F.greatest("m.a", "b").alias("b")).distinct()


def _cross(cells: DataFrame) -> DataFrame:
    """All pairs of different components that share a column: rows outside the column's largest component with all
    others. Overlaps are counted over the prefixes, and pairs whose count and sizes rule the link out are discarded: to
    the columns that a pair shares here come at most those that are ``done``, and what isn't in both prefixes, which is
    at most the longer rest."""
    stray = cells.where("root <> main").select("gram", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("done").alias("da"), "main")
    other = cells.select("gram", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("done").alias("db"))
    met = stray.join(other, "gram").where("ra <> rb AND (rb = main OR a < b) AND 5 * least(na, nb) >= 4 * greatest(na, nb)")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.greatest("na", "nb").alias("n1"), F.least("na", "nb").alias("n2"), F.least("da", "db").alias("d"))
    c = met.groupBy("a", "b").agg(F.count("*").alias("c"), F.first("n1").alias("n1"), F.first("n2").alias("n2"), F.first("d").alias("d"))
    # a prefix has n - ceil(4 n / 5) + 1 shingles, so its rest has ceil(4 n / 5) - 1
    return c.where("c + d + ((4 * n1 + 4) div 5) - 1 >= ((4 * (n1 + n2) + 8) div 9)").select("a", "b")


def _product(docs: DataFrame, text: str, cells: DataFrame, clash: np.ndarray) -> DataFrame:
    """Links between components among rows that meet in long columns. Columns that share rows make a cluster; its rows
    outside their column's largest component are multiplied with all its rows of like size, ``BLOCK`` by ``BLOCK``, and every block's
    overlaps are accumulated over the whole sets. A task holds two blocks whatever the cluster's size, and gives one link
    for each two components that it finds linked."""
    cluster = components(cells.select(F.col("node").alias("a"), F.expr("-1L - gram").alias("b")), "jaccard-clusters").withColumnRenamed("root", "cluster")
    rows = cells.groupBy("node").agg(F.first("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("stray"), F.floor(F.log(1.25, F.first("n").cast("double"))).cast("int").alias("kind"))
    rows = stage(rows.join(cluster, "node"), "jaccard-members")
    # sizes that link differ by a factor of 1.25 at most, so a size class meets itself and its neighbours
    size = rows.groupBy("cluster", "kind").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_all"), F.ceil(F.count_if("stray") / BLOCK).cast("int").alias("n_stray"))
    size = stage(size, "jaccard-classes")
    grid = size.where("n_stray > 0").select("cluster", F.col("kind").alias("k"), "n_stray", F.explode(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1)).alias("t"))
    grid = stage(grid.join(size.select("cluster", F.col("kind").alias("t"), "n_all"), ["cluster", "t"]), "jaccard-grid")
    number = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    right = rows.withColumnRenamed("kind", "t").join(grid, ["cluster", "t"]).select("cluster", "k", "t", "node", "root", F.lit(False).alias("left"), number("n_all").alias("j"), every("n_stray").alias("i"))
    left = rows.where("stray").withColumnRenamed("kind", "k").join(grid, ["cluster", "k"]).select("cluster", "k", "t", "node", "root", F.lit(True).alias("left"), number("n_stray").alias("i"), every("n_all").alias("j"))
    sets = stage(_rows_of(docs, text, rows.select("node"), clash), "jaccard-sets")
    both = right.unionByName(left).join(sets, "node").select("cluster", "k", "t", "i", "j", "node", "root", "left", "grams")

    def multiply(table: pa.Table) -> pa.Table:
        side = table["left"].to_numpy()
        node, root = table["node"].to_numpy(), table["root"].to_numpy()
        part = table["grams"].combine_chunks()
        flat, at = part.flatten().to_numpy(), np.concatenate(([0], np.cumsum(np.diff(part.offsets.to_numpy()))))
        owner = np.repeat(np.arange(len(node)), np.diff(at))
        n = np.diff(at)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        place = np.empty(len(node), np.int64)
        place[one], place[two] = np.arange(len(one)), np.arange(len(two))
        order = np.argsort(flat, kind="stable")
        gram, who = flat[order], owner[order]
        overlap = np.zeros(len(one) * len(two), np.int64)
        edge = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1], [True])))
        # columns of the block, some at a time: each adds all its (left, right) pairs
        for k in range(0, len(edge) - 1, 2048):
            lo, hi = edge[k], edge[min(k + 2048, len(edge) - 1)]
            g, w = gram[lo:hi], who[lo:hi]
            l, r = np.flatnonzero(side[w]), np.flatnonzero(~side[w])
            first, last = np.searchsorted(g[r], g[l], "left"), np.searchsorted(g[r], g[l], "right")
            m = last - first
            a = np.repeat(place[w[l]], m)
            b = place[w[r[np.repeat(first - np.cumsum(m) + m, m) + np.arange(m.sum())]]]
            overlap += np.bincount(a * len(two) + b, minlength=len(overlap))
        c = overlap.reshape(len(one), len(two))
        hit = (5 * c >= 4 * (n[one][:, None] + n[two][None] - c)) & (c > 0) & (root[one][:, None] != root[two][None])
        a, b = np.nonzero(hit)
        seen: dict[tuple[int, int], tuple[int, int]] = {}
        for x, y in zip(one[a].tolist(), two[b].tolist(), strict=True):
            seen.setdefault((min(root[x], root[y]), max(root[x], root[y])), (node[x], node[y]))
        return pa.table([pa.array([x for x, _ in seen.values()], pa.int64()), pa.array([y for _, y in seen.values()], pa.int64())], names=["a", "b"])

    links = stage(both.groupBy("cluster", "k", "t", "i", "j").applyInArrow(multiply, "a long, b long"), "jaccard-links")
    discard(sets)
    return links


def with_components(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of ``docs``: ``row_id, n_shingles, component_id``; an empty set's component is its own id. Nulls,
    empty texts, repeated rows and empty tables as ``linked`` says; other columns, whatever their names, are left out."""
    rows, classes, _ = linked(docs, row_id, text)
    some = rows.where("n > 0").join(classes, "node").select("id", "n", "component_id")
    none = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return some.unionAll(none).select(F.col("id").alias(row_id), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with one document of each component: one that has the component's least id (a row without an
    id only if none of its component has one). Rows of different components stay whatever ids they share; empty texts,
    which link with nothing, all stay; of rows equal in id and shingles one stays."""
    rows, classes, clash = linked(docs, row_id, text)
    own = docs.select("*", F.col(row_id).alias("__id"), F.col(text).alias("__text")).drop("__node")

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, raw, off in batches(batch, "__text"):
                doc, gram = shingles(words(raw, off))
                size, node = _named(doc, gram, j - i, clash)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(signed(node), mask=size == 0)], schema.names)

    schema = T.StructType([*docs.schema.fields, T.StructField("__node", T.LongType())])
    named = own.mapInArrow(sign, schema)
    kept = stage(classes.where("node = main").select(F.col("node").alias("__node"), F.col("component_id").alias("__least")), "jaccard-kept")
    # sets of which one id has several rows: these, and no others, are cut to one
    again = rows.where("n > 0").groupBy("node", "id").count().where("count > 1").select(F.col("node").alias("__node"))
    again = stage(again.distinct(), "jaccard-repeated")
    # an inner join: what isn't kept has no partner (the texts are dealt by node once)
    full = named.where("__node IS NOT NULL").join(kept, "__node").where(F.col(row_id).eqNullSafe(F.col("__least"))).drop("__least")
    empty = docs.where(~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    if again.isEmpty():
        return full.select(*docs.columns).unionAll(empty)
    once = full.join(again, "__node", "left_semi").dropDuplicates(["__node"])
    return full.join(again, "__node", "left_anti").unionByName(once).select(*docs.columns).unionAll(empty)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_components(docs)


OP6_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, string_split_regex(trim(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), E' \\t\\n\\x0B\\f\\r'), '[\\x20\\x09-\\x0D]+') AS ws FROM documents),
w2 AS (SELECT doc_id, CASE WHEN len(ws) = 1 AND ws[1] = '' THEN [] ELSE ws END AS ws FROM w),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE unnested END AS g FROM (
  SELECT doc_id, ws, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS unnested FROM w2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS a, x AS b FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
