"""The inverted file against the full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmint.operators import search, vectors


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    middle = r.normal(size=(40, 16))
    data = [(i, (middle[i % 40] + 0.4 * r.normal(size=16)).astype(np.float32).tolist(), "ab"[i % 2]) for i in range(6000)]
    data += [(6000 + i, data[5][1], "a") for i in range(300)] + [(7000, None, "a")]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label string").repartition(6).cache()


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cells"))
    vectors.build(rows, path + "/index", cells=48, sample=2000)
    return vectors.Cells(spark, path + "/index")


def test_every_row_is_in_one_cell(index, rows):
    assert index.rows.count() == 6300 == index.rows.select("vec_id").distinct().count() and len(index.ids) > 30


def test_exact_search_equals_the_scan(index, rows):
    held = rows.where("embedding IS NOT NULL")
    queries = [r.embedding for r in held.where("vec_id % 1500 = 5").collect()] + [[0.0] * 16, [9.0] * 16]
    for q in queries:
        for where in (None, F.col("label") == "b"):
            want = [tuple(r) for r in search.nearest(held, q, 20, where=where).collect()]
            assert [tuple(r) for r in index.exact(q, 20, probes=2, where=where).select("vec_id", "label", "distance").collect()] == want
    assert index.exact(queries[0], 9000).count() == 6300


def test_recall_of_few_cells(index, rows):
    """Twenty nearest for every 50th row, by 8 of 48 cells, against all rows."""
    asked = rows.where("vec_id % 50 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("q"), "embedding")
    found = {}
    for r in index.probe_all(asked, "q", 20, probes=8).collect():
        found.setdefault(r.q, []).append(r.distance)
    x = np.array([r.embedding for r in rows.where("embedding IS NOT NULL").collect()], float)
    hits = []
    for r in asked.collect():
        kth = np.sort(((x - np.array(r.embedding, float)) ** 2).sum(1))[19]
        hits.append(sum(d <= kth + 1e-5 for d in found[r.q]) / 20)
    assert len(hits) > 120 and np.mean(hits) >= 0.9


def test_empty_index(spark, rows, tmp_path):
    vectors.build(rows.limit(0), f"{tmp_path}/none")
    index = vectors.Cells(spark, f"{tmp_path}/none")
    assert index.exact([0.0] * 16, 5).count() == 0 == index.probe([0.0] * 16, 5).count()
