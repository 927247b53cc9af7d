"""Ranked lexical search by a threshold-seeded join.

An index holds for every document its length and how often it has each term that some item asks for; for every such term it
stores the ``k`` highest impacts (what one occurrence in the item adds to a document's score) with their documents. An item's
kth score is at least the greatest kth impact among its terms, and at least the kth score of the documents stored under
them, scored exactly: its threshold. An item's terms stand by their highest possible addition; those at the end of the list
that together can't reach the threshold are pruned, since a document that has no other term of the item can't be among its
``k`` best. What the remaining terms' postings add up to, with the pruned terms' bound, leaves the candidates, and these are
scored exactly.

Everything meets by term, by document or by (item, document). Postings are never gathered: the stored impacts are limited in
each task before they are shuffled, and candidates are summed in each task. What travels to all executors is a filter of
fixed size over the items' terms; a term that passes it by chance is left out by the join that follows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.llm._arrow import PUNCT, batches, signed, small_batches, words
from parchmint.llm._scratch import stage

#: Places of the filter over the items' terms: 128 KB, however many items there are.
SLOTS = 1 << 20


def _terms(rows: DataFrame, row_id: str, text: str, wanted: np.ndarray | None, name: str) -> DataFrame:
    """``row, id, n, t, f`` (number, id, terms with repeats, distinct terms as 64-bit hashes, occurrences), written once.
    ``wanted`` packs which hashes modulo ``SLOTS`` are kept; ``n`` counts all."""
    spark = rows.sparkSession
    small_batches(spark)
    own = rows.select(F.col(row_id).alias("id"), F.col(text).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    keep = None if wanted is None else np.packbits(wanted, bitorder="little")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i, j, raw, off in batches(batch):
                w = words(raw, off, PUNCT)
                order = np.lexsort((w.hash, w.doc))
                h, d = w.hash[order], w.doc[order]
                first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))) if len(h) else np.zeros(0, np.int64)
                f = np.diff(np.append(first, len(h)))
                h, d = h[first], d[first]
                if keep is not None:
                    at = (h % np.uint64(SLOTS)).astype(np.int64)
                    ok = (keep[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                    h, d, f = h[ok], d[ok], f[ok]
                ends = pa.array(np.searchsorted(d, np.arange(j - i + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(w.counts, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(signed(h))), pa.ListArray.from_arrays(ends, pa.array(f, pa.int64()))], ["id", "n", "t", "f"])

    found = own.mapInArrow(run, f"id {kind}, n long, t array<long>, f array<long>").where("n > 0")
    return stage(found.withColumn("row", F.monotonically_increasing_id()), name)


class Index:
    """Documents indexed for the terms of ``items``, and what is known of each term."""

    def __init__(self, documents: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text"):
        """Null and empty texts, and texts without a term, count for nothing: such documents are never found, such items find
        none. Repeated rows are documents (items) of their own. Further columns aren't read."""
        self.k = k
        self.items = _terms(items, item_id, text, None, "ranking-items")
        wanted = np.zeros(SLOTS, bool)
        asked = self.items.select(F.explode("t").alias("t"))
        # the remainder of the hash as an unsigned number: ``SLOTS`` is a power of two
        wanted[[r[0] for r in asked.select(F.col("t").bitwiseAND(F.lit(SLOTS - 1))).distinct().collect()]] = True
        self.documents = _terms(documents, doc_id, text, wanted, "ranking-documents")
        total = self.documents.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
        self.n, self.l = total.n, total.l or 1
        df = self.documents.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * self.n + 2)) / (F.lit(2) * F.col("df") + 1).cast("double"))).cast("long")
        self.weights = stage(df.join(asked.distinct(), "t").select("t", weight.alias("w")), "ranking-weights")
        by_impact = Window.partitionBy("t").orderBy(F.desc("impact"), "row")
        best = self.postings().withColumn("rn", F.row_number().over(by_impact)).where(F.col("rn") <= k)
        self.best = stage(best, "ranking-impacts")

    def _worth(self, weight: str, f: str) -> str:
        """What ``f`` occurrences in a document of ``n`` terms add, by the contract's whole numbers."""
        return f"{weight} * ((1000000000L * {f}) div (1000L * {f} + 12L * (75L + (25L * n * {self.n}L) div {self.l}L)))"

    def postings(self) -> DataFrame:
        """``t, row, impact`` of all documents for all terms of the items."""
        every = self.documents.select("row", "n", F.explode(F.arrays_zip("t", "f")).alias("x")).select("row", "n", "x.t", "x.f")
        return every.join(self.weights, "t").select("t", "row", F.expr(self._worth("w", "f")).alias("impact"))

    def asked(self) -> DataFrame:
        """``item, t, times, w`` of all items' terms that some document has."""
        every = self.items.select(F.col("row").alias("item"), F.explode(F.arrays_zip("t", "f")).alias("x")).select("item", "x.t", F.col("x.f").alias("times"))
        return every.join(self.weights, "t")

    def scored(self, pairs: DataFrame) -> DataFrame:
        """``item, row, id, score`` of the pairs (item, row): whole exact scores, from the document's own list of terms."""
        of_item = self.asked().groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("t", F.expr("times * w")))).alias("m"))
        both = pairs.join(self.documents, "row").join(of_item, "item")
        score = f"aggregate(arrays_zip(t, f), 0L, (s, x) -> s + coalesce({self._worth('m[x.t]', 'x.f')}, 0L))"
        return both.select("item", "row", "id", F.expr(score).alias("score"))

    def _first(self, scored: DataFrame) -> DataFrame:
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        return scored.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)

    def _kth(self, pairs: DataFrame) -> DataFrame:
        """``item, sure``: the kth exact score among the pairs, of items that have so many."""
        return self._first(self.scored(pairs)).where(F.col("rank") == self.k).select("item", F.col("score").alias("sure"))

    def thresholds(self) -> DataFrame:
        """``item, least``: no document of the item's ``k`` best scores less; 0 where fewer than ``k`` are known to score. Stored
        impacts alone bound it; the documents with the greatest sums of them are scored exactly to raise it."""
        asked = self.asked()
        stored = asked.join(self.best, "t").withColumn("part", F.expr("times * impact"))
        single = stored.groupBy("item").agg(F.max(F.when(F.col("rn") == self.k, F.col("part"))).alias("least"))
        likely = Window.partitionBy("item").orderBy(F.desc("got"), "row")
        seeds = stored.groupBy("item", "row").agg(F.sum("part").alias("got")).withColumn("rn", F.row_number().over(likely)).where(F.col("rn") <= self.k)
        return single.join(self._kth(seeds.select("item", "row")), "item", "left").select("item", F.greatest("least", "sure", F.lit(0).cast("long")).alias("least"))

    def needed(self) -> DataFrame:
        """``item, t, times, least, rest``: the terms that aren't pruned, with what the pruned ones add at most."""
        most = self.best.where("rn = 1").select("t", F.col("impact").alias("most"))
        own = self.asked().join(most, "t").withColumn("bound", F.expr("times * most")).join(self.thresholds(), "item")
        last = Window.partitionBy("item").orderBy("bound", F.desc("t"))
        own = own.withColumn("suffix", F.sum("bound").over(last.rowsBetween(Window.unboundedPreceding, 0)))
        pruned = F.col("suffix") < F.col("least")
        rest = F.coalesce(F.max(F.when(pruned, F.col("suffix"))).over(Window.partitionBy("item")), F.lit(0).cast("long"))
        return own.withColumn("rest", rest).where(~pruned).select("item", "t", "times", "least", "rest")

    def candidates(self) -> DataFrame:
        """``item, row`` of all documents that may be among an item's best. The documents that have most from the terms that
        aren't pruned are scored exactly first, which raises the threshold once more."""
        needed = stage(self.needed(), "ranking-needed")
        met = self.postings().join(needed.select("item", "t", "times"), "t").groupBy("item", "row").agg(F.sum(F.expr("times * impact")).alias("got"))
        bounds = needed.groupBy("item").agg(F.first("least").alias("least"), F.first("rest").alias("rest"))
        met = stage(met.join(bounds, "item").where("got + rest >= least"), "ranking-met")
        likely = Window.partitionBy("item").orderBy(F.desc("got"), "row")
        best = met.withColumn("rn", F.row_number().over(likely)).where(F.col("rn") <= self.k).select("item", "row")
        return met.join(self._kth(best), "item", "left").where("got + rest >= coalesce(sure, 0L)").select("item", "row")

    def ranked(self) -> DataFrame:
        """``item_id, rank, doc_id, score``: the ``k`` best documents of each item that score at all, equal scores by id (null
        ids last). Empty tables give no rows."""
        first = self._first(self.scored(stage(self.candidates(), "ranking-candidates")))
        names = self.items.select(F.col("row").alias("item"), F.col("id").alias("item_id"))
        return first.join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return Index(read("documents"), read("benchmark")).ranked()


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("text")} AS ts FROM documents),
n AS (SELECT r, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY t, n_docs),
q AS (SELECT i, item_id, t, count(*) AS times FROM (SELECT row_number() OVER () AS i, item_id, unnest({_TERMS.format("text")}) AS t FROM benchmark) GROUP BY ALL),
s AS (SELECT i, item_id, r, doc_id, sum(times * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN n USING (r), c GROUP BY ALL),
o AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""
