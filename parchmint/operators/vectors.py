"""Nearest vectors by an inverted file: k-means cells, every row assigned to its nearest centre, few cells read for a query.

Cells also keep their radius, so a search can tell by the triangle inequality which cells can't hold a nearer row: after
the nearest cells are scanned, only those are read that may. That makes the index search as exact as the full scan; with
``probes`` alone it reads less and may miss rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.operators.search import nearest

#: Rows that the centres are trained on, and cells, at most. Centres reach the driver: cells times dimensions.
SAMPLE, CELLS = 20_000, 1024


def build(vectors: DataFrame, path: str, row_id: str = "vec_id", vector: str = "embedding", cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> None:
    """Write the index of ``vectors``: ``rows`` by cell, all columns, and ``cells`` with centres, radii and counts.

    Centres are trained on about ``sample`` rows chosen by hash; there are as many as the root of the number of rows, ``CELLS``
    at most. Every row is assigned; rows without a vector can't be near anything and are left out. Equal vectors stand in
    one cell, whose files are written by many tasks. An empty table gives an index that finds nothing."""
    spark = vectors.sparkSession
    own = vectors.where(F.col(vector).isNotNull()).drop("cell", "to_centre")
    n = own.count()
    k = max(1, min(CELLS, cells or math.isqrt(n)))
    share = min(1.0, sample / max(1, n))
    drawn = own.where(F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    centres = np.zeros((0, 0))
    if n:
        centres = np.array(KMeans(k=k, seed=seed, maxIter=12, featuresCol="v", initSteps=2).fit(drawn if not drawn.isEmpty() else own.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"))).clusterCenters())
    norms = (centres**2).sum(1) if n else None

    def assign(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            x = np.stack(pdf[vector].map(lambda v: np.asarray(v, float)).tolist()) if len(pdf) else np.zeros((0, 1))
            cell = (norms - 2 * x @ centres.T).argmin(1) if len(pdf) else np.zeros(0, int)
            away = np.sqrt(((x - centres[cell]) ** 2).sum(1)) if len(pdf) else np.zeros(0)
            yield pdf.assign(cell=cell.astype(np.int32), to_centre=away)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields), "cell int", "to_centre double"])
    own.mapInPandas(assign, schema).write.partitionBy("cell").parquet(f"{path}/rows")
    if not n:
        spark.createDataFrame([], "cell int, n long, radius double, centre array<double>").write.parquet(f"{path}/cells")
        return
    seen = spark.read.parquet(f"{path}/rows").groupBy("cell").agg(F.count("*").alias("n"), F.max("to_centre").alias("radius"))
    listed = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>")
    seen.join(listed, "cell").select("cell", "n", "radius", "centre").write.parquet(f"{path}/cells")


class Cells:
    """An index that was written, for searches: centres and radii in memory (bounded by ``CELLS``), rows in their files."""

    def __init__(self, spark: SparkSession, path: str, row_id: str = "vec_id", vector: str = "embedding"):
        self.row_id, self.vector = row_id, vector
        known = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        self.ids = np.array([r.cell for r in known], int)
        self.radius = np.array([r.radius for r in known])
        self.centre = np.array([r.centre for r in known])
        self.rows = spark.read.parquet(f"{path}/rows") if known else spark.createDataFrame([], f"{row_id} long, {vector} array<float>, cell int, to_centre double")

    def _away(self, query: Sequence[float]) -> np.ndarray:
        return np.sqrt(((self.centre - np.asarray(query, float)) ** 2).sum(1)) if len(self.ids) else np.zeros(0)

    def _scan(self, query: Sequence[float], cells: Sequence[int], n: int, where: Column | None) -> DataFrame:
        """The nearest rows of some cells: other cells' folders aren't read."""
        own = self.rows.where(F.col("cell").isin([int(c) for c in cells]) if len(cells) else F.lit(False)).drop("cell", "to_centre")
        return nearest(own, query, n, self.row_id, self.vector, where)

    def probe(self, query: Sequence[float], n: int, probes: int = 8, where: Column | None = None) -> DataFrame:
        """The nearest rows among those in the ``probes`` nearest cells."""
        return self._scan(query, self.ids[np.argsort(self._away(query), kind="stable")[:probes]], n, where)

    def exact(self, query: Sequence[float], n: int, probes: int = 8, where: Column | None = None) -> DataFrame:
        """The nearest rows of all, ties by id: the ``probes`` nearest cells first, then every cell that may hold a row as near
        as the ``n``-th found (all, where fewer are found)."""
        away = self._away(query)
        order = np.argsort(away, kind="stable")
        found = self._scan(query, self.ids[order[:probes]], n, where).select("distance").collect()
        # distances are rounded to six places, squares that is
        reach = math.sqrt(found[n - 1].distance + 1e-6) + 1e-6 if len(found) == n else math.inf
        return self._scan(query, self.ids[away - self.radius <= reach * (1 + 1e-9)], n, where)

    def probe_all(self, queries: DataFrame, query_id: str, n: int, probes: int = 8) -> DataFrame:
        """``query_id, row_id, distance, rank`` for a table of queries (``query_id``, vector): each meets only the rows of its
        ``probes`` nearest cells, by an equi-join on the cell."""
        centre, ids, vector = self.centre, self.ids, self.vector
        kind = queries.schema[query_id].dataType.simpleString()

        def choose(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in it:
                x = np.stack(pdf["__q"].map(lambda v: np.asarray(v, float)).tolist()) if len(pdf) else np.zeros((0, centre.shape[1]))
                near = ids[np.argsort((centre**2).sum(1) - 2 * x @ centre.T, axis=1, kind="stable")[:, :probes]]
                yield pd.DataFrame({query_id: np.repeat(pdf[query_id].to_numpy(), near.shape[1]), "__q": np.repeat(pdf["__q"].to_numpy(), near.shape[1]), "cell": near.ravel().astype(np.int32)})

        asked = queries.where(F.col(vector).isNotNull()).select(query_id, F.col(vector).cast("array<double>").alias("__q"))
        asked = asked.mapInPandas(choose, f"`{query_id}` {kind}, `__q` array<double>, cell int")
        rows = self.rows.select(F.col(self.row_id).alias("__r"), F.col(vector).cast("array<double>").alias("__v"), "cell")
        gap = F.aggregate(F.zip_with("__v", "__q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        met = asked.join(rows, "cell").select(query_id, F.col("__r").alias("found"), F.round(gap, 6).alias("distance"))
        rank = F.row_number().over(Window.partitionBy(query_id).orderBy("distance", "found"))
        return met.withColumn("rank", rank).where(F.col("rank") <= n)
