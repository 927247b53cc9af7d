"""Lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``. Where none is set, a folder of our own if the session runs in one process on
    one machine (tests); anywhere else executors would write where nobody reads, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="parchmint-"))
    return _own[0]


def _shuffles(spark: SparkSession) -> set[int]:
    """Ids of all shuffles whose files are kept."""
    ids = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().keys().iterator()
    out = set()
    while ids.hasNext():
        out.add(int(ids.next()))
    return out


def _others(spark: SparkSession) -> bool:
    return bool(list(spark.sparkContext.statusTracker().getActiveJobsIds()))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back.

    Later jobs read files instead of recomputing, a lost executor costs nothing that was written, and Catalyst knows
    the table's real size, so it broadcasts by the size it checked and by nothing else. The shuffle files that the write
    left are deleted at once; without that they stay until the driver happens to collect its garbage. (Where another job
    runs in the session, they are left to that, since nothing tells whose they are. A plan that needs them again would make
    them again.)
    """
    spark = df.sparkSession
    path = f"{folder(spark).rstrip('/')}/parchmint/{name}-{uuid.uuid4().hex}"
    alone = not _others(spark)
    before = _shuffles(spark) if alone else set()
    df.write.parquet(path)
    cleaner = spark.sparkContext._jsc.sc().cleaner()
    if alone and not _others(spark) and cleaner.isDefined():
        for k in _shuffles(spark) - before:
            cleaner.get().doCleanupShuffle(k, False)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        files = df.inputFiles() if df is not None else []
        if files and "/parchmint/" in files[0]:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
