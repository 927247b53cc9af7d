"""Sinks: sharded tables, swaps, keyed upserts and deletes on Parquet, append-only logs."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions.ids import shard
from parchmint.operators.ordered import upsert


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def swap(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write beside ``path`` and rename; ``df`` may read ``path``. The old table goes only after the new one has its name: a
    rename that fails is undone and raises. Between the two renames a reader that opens the path finds nothing and has to
    open it again; readers that can't should use ``write_version`` and ``read_version``."""
    spark = df.sparkSession
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(staged)
    fs, target = _fs(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    was = fs.exists(target)
    if was and not fs.rename(target, path_of(old)):
        raise OSError(f"{path} could not be moved aside; the new table is at {staged}")
    if not fs.rename(path_of(staged), target):
        if was:
            fs.rename(path_of(old), target)
        raise OSError(f"{staged} could not be moved to {path}; the old table is kept")
    if was:
        fs.delete(path_of(old), True)
    spark.catalog.refreshByPath(path)


def write_version(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Write ``df`` as the next version of a table and return its number. A version is a folder of its own whose marker
    of success Spark writes last, so readers see the version before until this one is whole."""
    spark = df.sparkSession
    number = max([n for n, _ in _versions(spark, path)], default=0) + 1
    w = df.write
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/v{number:08d}")
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The last whole version of a table, or the one asked for."""
    whole = [n for n, done in _versions(spark, path) if done]
    return spark.read.parquet(f"{path}/v{(max(whole) if number is None else number):08d}")


def drop_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` whole versions."""
    fs, _ = _fs(spark, path)
    for n in sorted(n for n, done in _versions(spark, path) if done)[:-keep]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{n:08d}"), True)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, bool]]:
    fs, top = _fs(spark, path)
    if not fs.exists(top):
        return []
    found = [s.getPath() for s in fs.listStatus(top)]
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    return [(int(p.getName()[1:]), fs.exists(path_of(p, "_SUCCESS"))) for p in found if p.getName().startswith("v") and p.getName()[1:].isdigit()]


def write_sharded(df: DataFrame, path: str, key: str) -> None:
    """One folder for each first character of the key (letters and digits in lower case, else ``_``)."""
    swap(df.withColumn("shard", shard(F.col(key))), path, ["shard"])


def merge(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> None:
    """Upsert by key; of several new rows with one key the first in ``order`` counts."""
    swap(upsert(spark.read.parquet(path), new, keys, order), path)


def insert_missing(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str]) -> None:
    """Rows whose key the table lacks; what is there stays. Null keys are dropped."""
    old = spark.read.parquet(path)
    fresh = new.dropna(subset=list(keys)).dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti")
    swap(old.unionByName(fresh.select(*old.columns)), path)


def delete(spark: SparkSession, path: str, gone: DataFrame, keys: Sequence[str]) -> None:
    swap(spark.read.parquet(path).join(gone.select(*keys), list(keys), "left_anti"), path)


def delete_everywhere(spark: SparkSession, paths: dict[str, str], key: object) -> None:
    """Remove a document's rows from several tables: path to the name of its key column."""
    for path, column in paths.items():
        swap(spark.read.parquet(path).where(~F.col(column).eqNullSafe(F.lit(key))), path)


def append_log(df: DataFrame, path: str, most: int = 200) -> None:
    """Append as JSON lines, long parameters cut."""
    cut = [F.left(c, F.lit(most)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*cut).write.mode("append").json(path)
