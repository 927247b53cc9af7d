"""Document catalogue: lists, statistics, links, key resolution, dedupe checks, composed views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import ids
from parchmint.operators.ordered import page


class DuplicateKey(ValueError):
    """A key or identifier that must be unique is held by two contents."""


def catalog_list(catalog: DataFrame, key: str, equal: dict[str, object | None]) -> DataFrame:
    """Rows that satisfy all given equalities (None: any), by key."""
    out = catalog
    for column, value in equal.items():
        if value is not None:
            out = out.where(F.col(column) == F.lit(value))
    return out.orderBy(key)


def catalog_stats(catalog: DataFrame, status: str, states: Sequence[str], doi: str) -> DataFrame:
    """One pass: all rows, rows by status, rows with an identifier."""
    counts = [F.count_if(F.col(status) == s).alias(f"n_{s}") for s in states]
    return catalog.agg(F.count("*").alias("total"), *counts, F.count(doi).alias("with_doi"))


def project_papers(links: DataFrame, documents: DataFrame, project: object) -> DataFrame:
    """Documents linked to a project, by key."""
    return documents.join(links.where(F.col("project_id") == F.lit(project)), "content_hash").orderBy("key")


def resolve_keys(tags: DataFrame, keys: Sequence[str] | None = None, key: str | None = None, any_tag: Sequence[str] | None = None) -> DataFrame | None:
    """Union of the named keys and those with any of the tags (``tags(key, tags array)``); None where nothing is asked.
    An empty answer stays empty: it never turns into no filter."""
    if key is None and not keys and not any_tag:
        return None
    spark, parts = tags.sparkSession, []
    named = [*(keys or ()), *((key,) if key is not None else ())]
    if named:
        parts.append(spark.createDataFrame([(k,) for k in named], "key string"))
    if any_tag:
        parts.append(tags.where(F.arrays_overlap("tags", F.array(*map(F.lit, any_tag)))).select("key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.distinct()


def library_list(papers: DataFrame, order: Sequence[str], number: int = 1, size: int = 50, tags: Sequence[str] = (), status: str | None = None) -> DataFrame:
    """Page ``number`` of ``papers (key, title, year, has_pdf, doi_status, tags)`` with any of the tags and that status: titles cut
    to 80 characters, ``related`` and ``parent`` where the key's suffix names a related document, ``retracted`` where a
    retraction of the paper is among the listed ones (on whatever page), and the ``total``.

    The page is a top-k of the listed papers; the retractions' parents then meet its few rows by key."""
    own = papers
    if tags:
        own = own.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    if status:
        own = own.where(F.col("doi_status") == status)
    part = lambda k: F.nullif(F.regexp_extract("key", ids.RELATED_SUFFIX, k), F.lit(""))
    own = own.select("key", F.left(F.coalesce("title", F.lit("")), F.lit(80)).alias("title"), "year", "has_pdf", "doi_status", "tags", part(2).alias("related"), part(1).alias("parent"), *(c for c in order if c not in papers.columns[:6]))
    shown = page(own, order, max(1, number), size).drop("rn")
    withdrawn = own.where("related = 'retraction'").select(F.col("parent").alias("key"), F.lit(True).alias("retracted")).distinct()
    return shown.join(withdrawn, "key", "left").withColumn("retracted", F.coalesce("retracted", F.lit(False)))


def duplicate_content(documents: DataFrame, row_id: str, text: str) -> DataFrame:
    """Documents whose content hash another document has too: hash, first id, copies."""
    h = documents.select(F.sha2(F.col(text).cast("binary"), 256).alias("content_hash"), row_id)
    return h.groupBy("content_hash").agg(F.min(row_id).alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def check_unique(catalog: DataFrame, columns: Sequence[str]) -> None:
    """Raise ``DuplicateKey`` if two contents share a non-null value of any of the columns."""
    for c in columns:
        clash = catalog.where(F.col(c).isNotNull()).groupBy(c).agg(F.countDistinct("content_hash").alias("n")).where("n > 1").limit(1).collect()
        if clash:
            raise DuplicateKey(f"{c} {clash[0][0]!r} belongs to {clash[0].n} documents")


def in_library(results: DataFrame, library: DataFrame, doi: str = "doi") -> DataFrame:
    """``results`` with ``in_library``, comparing identifiers without case on both sides."""
    own = library.select(F.lower(F.trim(doi)).alias("__doi")).where("__doi IS NOT NULL AND __doi <> ''").distinct()
    return results.withColumn("__doi", F.lower(F.trim(doi))).join(own.withColumn("__in", F.lit(True)), "__doi", "left").withColumn("in_library", F.coalesce("__in", F.lit(False))).drop("__doi", "__in")


def federated_merge(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """First source's rows (``ord, doi, title, is_oa``) enriched by the second's, then the second's unmatched rows."""
    a = first.select(F.col("ord").alias("ord_a"), "doi", "title", F.lower("doi").alias("k"))
    b = second.select(F.col("ord").alias("ord_b"), F.col("doi").alias("doi_b"), F.col("title").alias("title_b"), "is_oa", F.lower("doi").alias("k"))
    both = a.where("k IS NOT NULL").join(b.where("k IS NOT NULL"), "k", "full_outer")
    rows = both.select("ord_a", "ord_b", F.coalesce("doi", "doi_b").alias("doi"), F.coalesce("title", "title_b").alias("title"), "is_oa")
    rows = rows.unionByName(a.where("k IS NULL").select("ord_a", "doi", "title"), allowMissingColumns=True)
    rows = rows.unionByName(b.where("k IS NULL").select("ord_b", F.col("doi_b").alias("doi"), F.col("title_b").alias("title"), "is_oa"), allowMissingColumns=True)
    return rows.orderBy(F.asc_nulls_last("ord_a"), F.asc_nulls_last("ord_b"), "title").limit(limit).select("doi", "title", "is_oa", F.when(F.col("ord_a").isNotNull(), "first").otherwise("second").alias("origin"))


def sync_classify(current: DataFrame, indexed: DataFrame, key: str, stamp: str) -> DataFrame:
    """Added, changed, removed or unchanged, by comparing stamps of current and indexed files."""
    a, b = current.select(key, F.col(stamp).alias("now")), indexed.select(key, F.col(stamp).alias("was"), F.lit(True).alias("has"))
    both = a.withColumn("is", F.lit(True)).join(b, key, "full_outer")
    change = F.when(F.col("has").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("now").eqNullSafe(F.col("was")), "unchanged").otherwise("changed")
    return both.select(key, change.alias("change"))


def related(keys: DataFrame, pattern: str) -> DataFrame:
    """Keys with a related-document suffix joined to the parent that exists."""
    child = keys.select(F.col("key").alias("child"), F.regexp_extract("key", pattern, 1).alias("parent"), F.regexp_extract("key", pattern, 2).alias("kind")).where("parent <> ''")
    return child.join(keys.select(F.col("key").alias("parent")), "parent")


def prefer(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Rows of the first source that has the key."""
    out = None
    for rank, s in enumerate(sources):
        s = s.withColumn("__rank", F.lit(rank))
        out = s if out is None else out.unionByName(s)
    w = Window.partitionBy(*keys).orderBy("__rank")
    return out.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__rank")
