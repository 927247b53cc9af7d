"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` points. Every shard owns ``vnodes`` of them; a key belongs to the first virtual node clockwise of
its own point. No shard takes more than its capacity: keys that overflow a full shard continue clockwise to the next
virtual node whose shard has room. With ``slack=0`` the capacities add up to the number of rows, so shard counts differ
by one at most; with more slack fewer keys move when the number of shards changes.

Only counts by ring point reach the driver (``CELLS`` numbers at most, whatever the input), and the walk round the ring
runs on them. It yields intervals of ranks within a point, which a broadcast table of bounded size brings back to the
rows. A row's rank is a ``row_number`` within its point; points that hold more than their share of rows (a text that a
third of all rows repeat) are dealt by a hash of the whole row into sub-buckets, whose sizes are counted first, so rows
without ids and rows that share one are dealt as well; only rows equal in every column stand in one sub-bucket.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.llm._scratch import stage

CELLS = 1 << 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes in clockwise order. A shard's points don't depend on how many others there
    are; where two shards hash to one point, the lower shard stands first."""
    return sorted((xxhash.xxh3_64_intdigest(f"shard {s} node {v}") % CELLS, s) for s in range(shards) for v in range(vnodes))


def capacities(rows: int, shards: int, slack: float) -> list[int]:
    if slack:
        return [math.ceil((1 + slack) * rows / shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def walk(counts: np.ndarray, shards: int, vnodes: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(cell, from rank, to rank, shard, slot of the first) for all rows; ``counts`` are rows by ring point."""
    nodes = ring(shards, vnodes)
    points = np.array([p for p, _ in nodes])
    arcs: list[list[list[int]]] = [[] for _ in nodes]
    for cell in np.flatnonzero(counts).tolist():
        arcs[int(np.searchsorted(points, cell)) % len(nodes)].append([cell, 0, int(counts[cell])])
    for arc in arcs[:1]:  # the arc that runs over the end of the ring begins behind the last node
        arc.sort(key=lambda x: (x[0] <= points[0], x[0]))
    room, filled = capacities(int(counts.sum()), shards, slack), [0] * shards
    out = []
    waiting = [a for a in range(len(nodes)) if arcs[a]]
    for step in range(len(nodes)):
        for a in waiting:
            shard = nodes[(a + step) % len(nodes)][1]
            arc = arcs[a]
            while arc and room[shard]:
                cell, lo, hi = arc[0]
                n = min(hi - lo, room[shard])
                out.append((cell, lo, lo + n, shard, filled[shard]))
                filled[shard] += n
                room[shard] -= n
                if lo + n == hi:
                    arc.pop(0)
                else:
                    arc[0][1] += n
        waiting = [a for a in waiting if arcs[a]]
        if not waiting:
            break
    return out


def _table(spark: SparkSession, names: list[str], rows: list[tuple], types: list[pa.DataType]) -> DataFrame:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names))


def assign(df: DataFrame, shards: int, key: Column, row_id: Column, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """``df`` with ``shard int`` (0 to shards-1) and ``slot long`` (gapless from 0 in each shard).

    ``key`` places a row on the ring, so rows with equal keys lie together unless a capacity divides them; ``row_id``
    orders rows at one point. Null keys and ids are values like any other; rows that are equal in both are
    interchangeable; an empty table stays empty. Columns named ``shard`` or ``slot`` are replaced. ``df`` is read three
    times (points, hot points, rows), so pass a narrow or written table where its computation is dear.
    """
    spark = df.sparkSession
    own = [c for c in df.columns if c not in ("shard", "slot")]
    h = F.xxhash64(key)
    base = df.withColumns({"__h": h, "__cell": F.shiftrightunsigned(h, 48).cast("int"), "__o": F.xxhash64(row_id, F.lit(7), *(F.col(f"`{c}`") for c in own if "map<" not in df.schema[c].dataType.simpleString()))}).drop("shard", "slot")
    counted = base.groupBy("__cell").count().toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[counted["__cell"].to_numpy(np.int64)] = counted["count"].to_numpy(np.int64)
    total = int(counts.sum())
    # points above this many rows are dealt out; at most CELLS / 4 sub-buckets come of it
    most = max(64, 4 * total // CELLS)
    hot = np.flatnonzero(counts > most)
    subs = _table(spark, ["__cell", "__n"], [(int(c), -(-int(counts[c]) // most)) for c in hot], [pa.int32(), pa.int32()])
    base = base.join(F.broadcast(subs), "__cell", "left").withColumn("__sub", F.coalesce(F.pmod("__o", F.col("__n").cast("long")).cast("int"), F.lit(0)))
    offsets: list[tuple[int, int, int]] = []
    if len(hot):
        seen: dict[int, int] = {}
        for cell, sub, n in sorted(tuple(r) for r in base.where("__n IS NOT NULL").groupBy("__cell", "__sub").count().collect()):
            offsets.append((cell, sub, seen.get(cell, 0)))
            seen[cell] = seen.get(cell, 0) + n
    parts = _table(spark, ["__cell", "__sub", "__off"], offsets, [pa.int32(), pa.int32(), pa.int64()])
    placed = _table(spark, ["__cell", "__lo", "__hi", "shard", "__slot"], walk(counts, shards, vnodes, slack), [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()])
    order = Window.partitionBy("__cell", "__sub").orderBy("__h", "__o", row_id)
    ranked = base.withColumn("__rank", F.row_number().over(order).cast("long") - 1)
    ranked = ranked.join(F.broadcast(parts), ["__cell", "__sub"], "left").withColumn("__rank", F.col("__rank") + F.coalesce("__off", F.lit(0)))
    placed = placed.withColumnRenamed("__cell", "__c")
    out = ranked.join(F.broadcast(placed), (F.col("__cell") == F.col("__c")) & (F.col("__rank") >= F.col("__lo")) & (F.col("__rank") < F.col("__hi")))
    return out.select(*own, "shard", (F.col("__slot") + F.col("__rank") - F.col("__lo")).alias("slot"))


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Write an assigned table as one folder for each shard, files in slot order; large shards get several tasks."""
    part = F.floor(F.col("slot") / rows_per_file)
    df.repartition("shard", part).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


SHARDS = 24


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    narrow = stage(
        docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("ring")),
        "ring",
    )
    return assign(narrow, SHARDS, F.col("ring"), F.col("doc_id")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
