"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, source mix, shards.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``docs``; the last adds ``shard`` and ``slot``.

* quality: rows that the co-trained classifier rejects go; clean rows stay.
* near_duplicates: of every component of documents with a 5-word Jaccard similarity of 0.8 and more, one with the least id
  stays.
* decontaminate: rows that hold a benchmark item, verbatim, edited or reordered, go.
* mix: rows over a leaf's token budget go; every row is taken once at most.
* shard: a consistent-hash ring with bounded loads; counts differ by one at most.

Null and empty texts, null ids, repeated rows, empty tables and further columns pass through every stage; what each does
with them is said at its function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm import decontaminate, jaccard, mixing, quality, sharding
from parchmint.llm._scratch import stage

MIX = mixing.Mix(levels=("__domain", "lang", "source"), weights=mixing.WEIGHTS, share=(4, 5), max_epochs=1, seed=17)
SHARDS = 24


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier scores under one half go. Null and empty texts are scored as the empty text, null languages and
    sources as names of their own; equal rows share their fate. Without labels of both classes every row stays; columns
    whose names begin with two underscores may not clash. An empty table stays empty."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, prefix="__").where("__keep").select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays (see ``jaccard.one_of_each``): null and empty texts link with nothing and all stay; rows
    without ids go if their component has an id; different texts under one id are different documents; rows equal in id
    and text are cut to one. An empty table stays empty."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold an item go (see ``decontaminate.matches``): null and empty texts hold none and stay, repeated rows share
    their fate, items with null id or text are left out. Without items, or without rows, nothing changes."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are taken by budget, once at most (see ``mixing.mix_sources``): null names read as empty ones, texts without a word
    have no tokens, equal rows share their fate. A leaf all of whose rows have no tokens has nothing to give and goes. An
    empty table stays empty."""
    return mixing.mix_sources(docs.withColumn("__domain", F.expr(mixing.DOMAIN_SQL)), MIX, epoch="__epoch").select(*docs.columns)


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with ``shard`` and ``slot`` (columns of these names are replaced): null texts stand where the empty text does,
    null ids and repeated rows are dealt like any others. An empty table stays empty."""
    return sharding.assign(docs, SHARDS, F.coalesce("text", F.lit("")), F.col("doc_id"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontaminate", decontaminate_stage),
    ("mix", mix_stage),
    ("shard", shard_stage),
]
#: The classifier and the alignment can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
