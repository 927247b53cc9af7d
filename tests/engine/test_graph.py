"""Ancestry, include walks and closures over long, wide and circular graphs."""

from pyspark.sql import functions as F

from parchmint.operators import graph


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, i) for i, (a, b) in enumerate(pairs)], "parent string, child string, ord int")


def test_ancestry_of_a_long_chain(spark):
    rows = [(f"n{k}", f"n{k - 1}" if k else None) for k in range(301)]
    got = {r.id: r.steps for r in graph.descendants(spark, spark.createDataFrame(rows, "id string, parent string"), "n0").collect()}
    assert got == {f"n{k}": k for k in range(301)}
    below = graph.descendants(spark, spark.createDataFrame(rows, "id string, parent string"), "n290").collect()
    assert {r.id: r.steps for r in below} == {f"n{290 + k}": k for k in range(11)}


def test_ancestry_with_cycles_and_gaps(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "seed"), ("f", "e"), ("g", "gone"), ("h", ""), ("i", None), ("seed", "x"), ("x", "seed"), (None, "seed"), ("self", "self"), ("e", None)]
    df = spark.createDataFrame(rows, "id string, parent string")
    assert {r.id: r.steps for r in graph.descendants(spark, df, "seed").collect()} == {"seed": 0, "e": 1, "f": 2, "x": 1}
    assert {r.id for r in graph.descendants(spark, df, "a").collect()} == {"a", "b", "c", "d"}
    assert [tuple(r) for r in graph.descendants(spark, df, "nobody").collect()] == [("nobody", 0)]
    assert [tuple(r) for r in graph.descendants(spark, df.limit(0), "seed").collect()] == [("seed", 0)]


def test_ancestry_of_a_million(spark):
    """A tree, and a star whose leaves all point to one node."""
    n = 1_200_000
    to = F.when(F.col("id") == 0, None).when(F.col("id") % 2 == 0, F.lit("1")).otherwise(F.floor(F.col("id") / 10).cast("string"))
    tree = spark.range(n).select(F.col("id").cast("string").alias("id"), to.alias("parent"))
    assert graph.descendants(spark, tree, "0").count() == n


def test_walk_of_many_diamonds(spark):
    """Thirty diamonds in a row have 2^30 paths; every node has one least path."""
    pairs = [x for k in range(30) for x in ((f"j{k}", f"l{k}"), (f"j{k}", f"r{k}"), (f"l{k}", f"j{k + 1}"), (f"r{k}", f"j{k + 1}"))] + [("j30", "j0"), ("j3", "gone"), ("other", "j2")]
    got = {r.node: r for r in graph.reach(spark, edges(spark, pairs), "j0").collect()}
    assert len(got) == 92 and got["j30"].depth == 60 and got["l29"].path < got["r29"].path
    plain, order = {}, {}

    def visit(node, path, depth):
        if node in plain:
            return
        plain[node], order[node] = path, depth
        for i, (a, b) in enumerate(pairs):
            if a == node:
                visit(b, f"{path}{i:09d}/", depth + 1)

    visit("j0", "", 0)
    assert {k: (r.path, r.depth) for k, r in got.items()} == {k: (plain[k], order[k]) for k in plain}
    near = {r.node: r.depth for r in graph.closure(edges(spark, pairs), "j0").collect()}
    assert near == {k: order[k] for k in plain}


def test_walk_prefers_the_first_include(spark):
    e = spark.createDataFrame([("m", "a", 2), ("m", "b", 1), ("b", "c", 1), ("c", "a", 12000), ("a", "c", 1)], "parent string, child string, ord int")
    got = {r.node: (r.depth, r.path.count("/")) for r in graph.reach(spark, e, "m").collect()}
    assert got == {"m": (0, 0), "b": (1, 1), "c": (2, 2), "a": (3, 3)}
    assert {r.node: r.depth for r in graph.closure(e, "m").collect()} == {"m": 0, "a": 1, "b": 1, "c": 2}
