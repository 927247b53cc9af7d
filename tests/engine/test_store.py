"""Commits over six tables: upserts, cascading removal, failures in the middle, compaction."""

import os

import pytest

from parchmint.sources.store import Store

TABLES = {
    "bib": ("key", "key string, title string"),
    "raw": ("key", "key string, page int, text string"),
    "catalog": ("doc", "doc string, hash string"),
    "archive": ("key", "key string, path string"),
    "vectors": ("paper", "id long, paper string, x array<float>"),
    "manifest": ("key", "key string, chunks long"),
}


def filled(spark, path):
    s = Store(spark, path, TABLES)
    names = [f"p{i}" for i in range(40)]
    df = lambda rows, name: spark.createDataFrame(rows, TABLES[name][1])
    s.upsert(
        {
            "bib": df([(k, f"Title {k}") for k in names], "bib"),
            "raw": df([(k, p, "text " * 400) for k in names for p in range(5)], "raw"),
            "catalog": df([(k, k * 3) for k in names] + [(None, "lost")], "catalog"),
            "archive": df([(k, f"/a/{k}") for k in names], "archive"),
            "vectors": df([(i * 10 + j, k, [0.5, float(j)]) for i, k in enumerate(names) for j in range(4)], "vectors"),
            "manifest": df([(k, 4) for k in names], "manifest"),
        }
    )
    return s


def keys(s):
    return {n: {str(r.key) for r in s.keys(n).collect()} for n in TABLES}


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if not f.endswith(".crc"))


def test_removal_is_small_and_cascades(spark, tmp_path):
    s = filled(spark, str(tmp_path))
    every = {f"p{i}" for i in range(40)}
    assert all(v == every for v in keys(s).values())
    before = size(tmp_path)
    first = s.remove(spark.createDataFrame([("p7",), ("p8",), ("nobody",), (None,)], "key string"))
    assert size(tmp_path) - before < 10_000
    assert all(v == every - {"p7", "p8"} for v in keys(s).values())
    assert s.read("raw").where("key = 'p7'").isEmpty() and s.read("raw").count() == 38 * 5
    assert s.read("bib", first - 1).count() == 40
    s.remove(spark.createDataFrame([("p9",)], "key string"), ["vectors"])
    assert keys(s)["vectors"] == every - {"p7", "p8", "p9"} and "p9" in keys(s)["bib"]


def test_upsert_replaces_all_rows_of_a_key(spark, tmp_path):
    s = filled(spark, str(tmp_path))
    s.upsert({"vectors": spark.createDataFrame([(900, "p3", [1.0]), (901, "p3", [2.0]), (902, "new", [3.0])], TABLES["vectors"][1])})
    assert sorted(r.id for r in s.read("vectors").where("paper IN ('p3', 'new')").collect()) == [900, 901, 902]
    s.remove(spark.createDataFrame([("p3",)], "key string"))
    s.upsert({"bib": spark.createDataFrame([("p3", "Back")], TABLES["bib"][1])})
    assert [r.title for r in s.read("bib").where("key = 'p3'").collect()] == ["Back"] and "p3" not in keys(s)["vectors"]


def test_failure_in_the_middle(spark, tmp_path, monkeypatch):
    """Neither a removal nor an upsert of several tables is seen before its commit is whole."""
    s = filled(spark, str(tmp_path))
    before = keys(s)

    def fails(*_):
        raise OSError("disk")

    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", fails)
        with pytest.raises(OSError):
            s.upsert({"bib": spark.createDataFrame([("p1", "half")], TABLES["bib"][1]), "manifest": spark.createDataFrame([("p1", 9)], TABLES["manifest"][1])})
        with pytest.raises(OSError):
            s.remove(spark.createDataFrame([("p2",)], "key string"))
    (tmp_path / "commits" / "000000000077").mkdir()  # begun, and never ended
    assert keys(s) == before and s.read("bib").where("title = 'half'").isEmpty()
    assert s.remove(spark.createDataFrame([("p2",)], "key string")) == 78
    assert keys(s) == {n: v - {"p2"} for n, v in before.items()} and s.read("bib").where("title = 'half'").isEmpty()


def test_compaction_changes_no_row(spark, tmp_path):
    s = filled(spark, str(tmp_path))
    s.remove(spark.createDataFrame([("p1",), ("p2",)], "key string"))
    s.upsert({"raw": spark.createDataFrame([("p1", 1, "again")], TABLES["raw"][1])})
    rows = lambda: {n: sorted(map(str, s.read(n).collect())) for n in TABLES}
    before = rows()
    s.compact("raw")
    assert rows() == before
    s.vacuum()
    assert rows() == before and len(s._listed("tables/raw")) == 1
    for n in TABLES:
        s.compact(n)
    s.vacuum()
    s.remove(spark.createDataFrame([("p5",)], "key string"))
    assert rows() == {n: [x for x in v if "'p5'" not in x] for n, v in before.items()}


def test_empty_store(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/none", TABLES)
    assert s.read("bib").count() == 0 and s.keys("vectors").count() == 0
    s.remove(spark.createDataFrame([("p",)], "key string"))
    assert s.read("bib").columns == ["key", "title"]
