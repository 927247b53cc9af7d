"""Incremental work as Structured Streaming: the checkpoint is the queue, every micro-batch is idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parchmint.operators import search


def chunk_stream(spark: SparkSession, pages: str, chunks: str, checkpoint: str, schema: str = "key string, page int, text string") -> StreamingQuery:
    """Chunks of arriving page files. A micro-batch writes its own chunks only, into the folder ``batch=<id>``: what it
    costs depends on what arrived and not on the table, and a batch that runs again writes the same folder again. A page
    that arrives once more is replaced as a whole: ``read_chunks`` takes each page from the last batch that has it."""
    stream = spark.readStream.schema(schema).parquet(pages)

    def batch(df: DataFrame, number: int) -> None:
        rows = df.dropDuplicates(["key", "page"]).withColumn("id", F.struct("key", "page"))
        own = search.chunks(rows, "id", "text")
        found = own.select("id.key", "id.page", "chunk_index", "text")
        # a page without a sentence leaves a row without a chunk, so that what it had before goes
        none = rows.select("key", "page").join(found.select("key", "page").distinct(), ["key", "page"], "left_anti")
        found.unionByName(none, allowMissingColumns=True).write.mode("overwrite").parquet(f"{chunks}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_chunks(spark: SparkSession, chunks: str) -> DataFrame:
    """``key, page, chunk_index, text``: every page's chunks of the last batch that held the page."""
    rows = spark.read.parquet(chunks)
    last = rows.groupBy("key", "page").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["key", "page", "batch"], "left_semi").where("chunk_index IS NOT NULL").drop("batch")


def call_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Calls and errors by tool in tumbling windows of event time; rows later than ``late`` are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "tool")
    return w.agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "error").alias("errors")).select(F.col("window.start").alias("start"), "tool", "calls", "errors")


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """``file, sha256, chunk_index, text`` of an index that ``sync_corpus`` keeps: each file as the last batch has it."""
    from parchmint.sources import sinks

    fs, target = sinks._fs(spark, index)
    if not fs.exists(target):
        return spark.createDataFrame([], "file string, sha256 string, chunk_index int, text string")
    rows = spark.read.parquet(index)
    last = rows.groupBy("file").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["file", "batch"], "left_semi").where("sha256 IS NOT NULL").select("file", "sha256", "chunk_index", "text")


def sync_corpus(spark: SparkSession, current: DataFrame, index: str, block: int = 500) -> dict[str, int]:
    """Bring an index of files up to date with ``current (file, sha256, text)``: added and changed files are chunked,
    removed ones marked. Every block of files is written as a batch of its own, so a run costs what has changed, what is
    done stays done if a later block fails, and a run that begins again goes on from there. Counts by change."""
    from parchmint.operators import catalog
    from parchmint.sources import sinks

    was = read_index(spark, index).select("file", "sha256").distinct()
    change = catalog.sync_classify(current.select("file", "sha256"), was, "file", "sha256")
    todo = f"{index}.todo"
    change.where("change <> 'unchanged'").write.mode("overwrite").parquet(todo)  # the plan is fixed before anything changes
    counts = {r[0]: r[1] for r in change.groupBy("change").count().collect()}
    plan = spark.read.parquet(todo)
    fs, target = sinks._fs(spark, index)
    number = max([int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(target) if x.getPath().getName().startswith("batch=")], default=0) if fs.exists(target) else 0
    columns = ("file", "sha256", "chunk_index", "text")
    if counts.get("removed"):
        number += 1
        gone = plan.where("change = 'removed'").selectExpr("file", "CAST(NULL AS STRING) AS sha256", "CAST(NULL AS INT) AS chunk_index", "CAST(NULL AS STRING) AS text")
        gone.write.parquet(f"{index}/batch={number}")
    blocks = -(-(counts.get("added", 0) + counts.get("changed", 0)) // block)
    own = plan.where("change IN ('added', 'changed')").join(current, "file").withColumn("__b", F.pmod(F.xxhash64("file"), F.lit(max(blocks, 1))))
    for b in range(blocks):
        number += 1
        some = own.where(F.col("__b") == b)
        chunks = search.chunks(some.select(F.struct("file", "sha256").alias("id"), "text"), "id", "text").select("id.file", "id.sha256", "chunk_index", "text")
        none = some.select("file", "sha256").join(chunks.select("file").distinct(), "file", "left_anti").selectExpr("file", "sha256", "CAST(NULL AS INT) AS chunk_index", "CAST(NULL AS STRING) AS text")
        chunks.select(*columns).unionByName(none).write.parquet(f"{index}/batch={number}")
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(todo), True)
    return counts
