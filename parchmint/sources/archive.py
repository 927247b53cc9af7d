"""The archive of ingested documents: three tables side by side, written once and patched by key.

``meta (key, content_hash, doi, title, doc_type, status, ...)``, ``pages (key, page, text)`` and ``chunks (key, page,
chunk_index, text, embedding, ...)`` lie in one folder each, partitioned by the shard of their key, so one document's rows are
found in one small folder and a patch rewrites the shards it touches and no others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions.ids import shard
from parchmint.operators.catalog import check_unique
from parchmint.sources import sinks
from parchmint.sources.staging import Rounds

TABLES = ("meta", "pages", "chunks")


def _put(df: DataFrame, path: str) -> None:
    """Rewrite the shards that ``df`` holds rows of: rows of its keys are replaced, others in those shards are kept."""
    spark = df.sparkSession
    new = df.withColumn("shard", shard(F.col("key")))
    fs, target = sinks._fs(spark, path)
    if fs.exists(target):
        old = spark.read.parquet(path)
        touched = [r[0] for r in new.select("shard").distinct().collect()]  # 37 shards at most
        kept = old.where(F.col("shard").isin(touched)).join(new.select("key").distinct(), "key", "left_anti")
        new = kept.unionByName(new, allowMissingColumns=True)
    new = Rounds(spark, "archive").put(new)  # merged once, not for each shard
    for s in [r[0] for r in new.select("shard").distinct().collect()]:
        sinks.swap(new.where(F.col("shard") == s).drop("shard"), f"{path}/shard={s}")


def write(path: str, meta: DataFrame, pages: DataFrame, chunks: DataFrame | None = None) -> None:
    """Add documents, or replace those whose keys are there."""
    for name, df in zip(TABLES, (meta, pages, chunks), strict=True):
        if df is not None:
            _put(df, f"{path}/{name}")


def read(spark: SparkSession, path: str, table: str, key: str | None = None) -> DataFrame:
    """One of the three tables, or one document's rows of it (only its shard's folder is read)."""
    out = spark.read.parquet(f"{path}/{table}")
    if key is not None:
        out = out.where((F.col("shard") == spark.range(1).select(shard(F.lit(key))).first()[0]) & (F.col("key") == key))
    return out.drop("shard")


def keys(spark: SparkSession, path: str) -> DataFrame:
    """All archived keys in order."""
    return spark.read.parquet(f"{path}/meta").select("key").orderBy("key")


def patch(spark: SparkSession, path: str, changes: DataFrame) -> None:
    """Meta rows with what ``changes (key, ...)`` gives; nulls keep what is there, unknown keys are left out."""
    old = read(spark, path, "meta")
    names = [c for c in changes.columns if c != "key"]
    new = old.join(changes.select("key", *(F.col(c).alias(f"__{c}") for c in names)), "key")
    _put(new.select("key", *(F.coalesce(f"__{c}", c).alias(c) if c in names else F.col(c) for c in old.columns if c != "key")), f"{path}/meta")


def catalogue(spark: SparkSession, path: str, unique: Sequence[str] = ("key", "doi")) -> DataFrame:
    """The catalogue made anew from the archive; files that can't be read are skipped. Two contents under one key or
    identifier raise ``DuplicateKey``."""
    meta = spark.read.option("ignoreCorruptFiles", "true").parquet(f"{path}/meta").drop("shard")
    n = spark.read.option("ignoreCorruptFiles", "true").parquet(f"{path}/pages").groupBy("key").agg(F.count("*").alias("page_count"))
    out = meta.join(n, "key", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0)))
    check_unique(out, unique)
    return out


def upsert(catalog: DataFrame, new: DataFrame, now: str, unique: Sequence[str] = ("key", "doi")) -> DataFrame:
    """The catalogue with new rows by ``content_hash``: a row that is there keeps its ``ingested_at`` and takes the rest. Keys
    and identifiers that another content holds raise ``DuplicateKey``."""
    n = new.select(*(F.col(c).alias(f"__{c}") if c != "content_hash" else F.col(c) for c in new.columns), F.lit(True).alias("__new"))
    both = catalog.join(n, "content_hash", "full_outer")
    taken = [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new.columns else F.col(c) for c in catalog.columns if c not in ("content_hash", "ingested_at")]
    out = both.select("content_hash", *taken, F.coalesce("ingested_at", F.lit(now)).alias("ingested_at")).select(*catalog.columns)
    check_unique(out, unique)
    return out


def remove(spark: SparkSession, path: str, key: str) -> None:
    """Take a document out of all three tables: its shard of each is rewritten, the others aren't touched."""
    s = spark.range(1).select(shard(F.lit(key))).first()[0]
    for name in TABLES:
        folder = f"{path}/{name}/shard={s}"
        fs, target = sinks._fs(spark, folder)
        if fs.exists(target):
            sinks.swap(spark.read.parquet(folder).where(F.col("key") != key), folder)


def drop(spark: SparkSession, path: str) -> bool:
    """Delete a table of an older layout; whether there was one."""
    fs, target = sinks._fs(spark, path)
    return bool(fs.exists(target) and fs.delete(target, True))


def link(links: DataFrame, new: DataFrame, added: str = "added_at") -> DataFrame:
    """Project links (``project_id, content_hash, ...``) with new ones in place of those of the same pair: the last added."""
    from parchmint.operators.ordered import upsert as by_key

    return by_key(links, new, ["project_id", "content_hash"], [F.desc(added)])


def unlink(links: DataFrame, project: str, content: str) -> DataFrame:
    return links.where(~((F.col("project_id") == project) & (F.col("content_hash") == content)))
