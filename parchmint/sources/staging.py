"""Tables written between the rounds of an iterative job, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a folder of our own where none is set and the session is one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="parchmint-rounds-"))
    return _own[0]


def tasks_for(df: DataFrame, rows: int = 500_000) -> int:
    """Partitions that hold some ``rows`` of a table each, so that a task's memory doesn't grow with the table; at least as many
    as the session has. Counting reads no column of a Parquet table."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows))


class Rounds:
    """Writes each round's table and reads it back, so that plans stay short, a lost executor costs one round, and joins are
    chosen by sizes that were seen. Where each round reads only the one before, ``keep=2`` deletes older tables."""

    def __init__(self, spark: SparkSession, name: str, keep: int | None = None):
        self.spark, self.keep, self.kept = spark, keep, []
        self.path = f"{shared_folder(spark)}/rounds/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.kept.append(path)
        gone = [] if self.keep is None else self.kept[: -self.keep]
        for old in gone:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(old)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.kept = self.kept[len(gone) :]
        return self.spark.read.schema(df.schema).parquet(path)
