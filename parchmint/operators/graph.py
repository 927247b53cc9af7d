"""Citation graph: shared citers, discovery, metadata joins, traversal, components of staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.sources.staging import Rounds, tasks_for


def shared_citers(edges: DataFrame, seeds: DataFrame, least: int, limit: int) -> DataFrame:
    """Papers that cite at least ``least`` of ``seeds`` (column ``cited``): ``citing, shared``, the most first."""
    n = tasks_for(edges)
    hit = edges.repartition(n, "cited").join(seeds.select("cited").distinct(), "cited", "left_semi").dropDuplicates(["citing", "cited"])
    return hit.repartition(n, "citing").groupBy("citing").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).orderBy(F.desc("shared"), "citing").limit(limit)


def recency(year: Column, as_of: int) -> Column:
    """One tenth off for each year of age, a tenth at least; half where the year is unknown or 0."""
    aged = F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(0.1) * (F.lit(as_of) - year))
    return F.when(year.isNull() | (year == 0), F.lit(0.5)).otherwise(aged)


def discover_new(edges: DataFrame, papers: DataFrame, library: DataFrame, known: DataFrame, as_of: int, least: int, limit: int, min_year: int | None = None, dismissed: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """Citing papers outside the library, scored by how many library papers they cite and how recent they are.

    ``edges(citing, cited)``, ``papers(citing, year)``, ``library(cited)``, ``known(citing)``. With ``dismissed(citing)`` and
    ``held(doi)`` papers that were dismissed go as well, and those whose DOI (a column of ``papers``) the library holds
    under another id, in whatever case. Three anti-joins; the last meets only papers with enough shared references."""
    hit = edges.join(library, "cited", "left_semi").join(known, "citing", "left_anti")
    if dismissed is not None:
        hit = hit.join(dismissed.select("citing"), "citing", "left_anti")
    sets = hit.groupBy("citing").agg(F.array_sort(F.collect_set("cited")).alias("shared_keys"))
    sets = sets.withColumn("n_shared", F.size("shared_keys").cast("long")).where(F.col("n_shared") >= least)
    out = sets.join(papers, "citing", "left").withColumn("year", F.coalesce("year", F.lit(0)))
    if held is not None:
        own = held.where("doi <> ''").select(F.lower("doi").alias("__doi"))
        out = out.join(own, F.lower("doi") == F.col("__doi"), "left_anti")
    if min_year is not None:
        out = out.where(F.col("year") >= min_year)
    out = out.withColumn("score", F.round(F.col("n_shared") * recency(F.col("year"), as_of), 2))
    return out.orderBy(F.desc("score"), F.desc("year"), "citing").limit(limit)


def neighbours(edges: DataFrame, of: DataFrame, papers: DataFrame, towards: str, most: int) -> DataFrame:
    """Citers (``towards="citing"``) or references (``"cited"``) of each paper with their metadata, ``most`` each and the
    number in all."""
    key = "cited" if towards == "citing" else "citing"
    n = tasks_for(edges)
    # distinct pairs are dealt by both ends, written once and dealt by key, so that no task holds more of them as tables grow
    hit = edges.join(of.select(F.col("key").alias(key)).distinct(), key, "left_semi").repartition(n, "citing", "cited").dropDuplicates(["citing", "cited"])
    hit = Rounds(edges.sparkSession, "edges").put(hit.select("citing", "cited")).repartition(n, key)
    ranked = hit.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(towards))).where(F.col("rn") <= most)
    ranked = ranked.join(hit.groupBy(key).agg(F.count("*").alias("total")), key)
    return ranked.join(papers, towards, "left").withColumnRenamed(key, "key").withColumnRenamed(towards, "other")


def find_stale(keys: DataFrame, seen: DataFrame, now: str, max_days: float) -> DataFrame:
    """Keys without a readable last check or with one older than ``max_days``: those first, then the oldest."""
    at = F.try_to_timestamp(F.col("last_checked").cast("string"))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(at)) / 86_400_000_000
    out = keys.join(seen, "key", "left").withColumn("age_days", age)
    return out.where(F.col("age_days").isNull() | (F.col("age_days") > max_days)).orderBy(F.desc_nulls_first("age_days"), F.desc("key")).select("key", "age_days")


def reach(spark: SparkSession, edges: DataFrame, root: str) -> DataFrame:
    """Pre-order walk of an include graph ``edges(parent, child, ord)`` from ``root``: ``node, depth, path``; every node once, where
    the walk first comes to it, so cycles are cut. ``path`` joins the places of the includes on the way.

    A node's least path is the least path of its parent and one place more. So each round carries on only the nodes
    whose path has become less: one join a level, however many paths lead to a node."""
    rounds = Rounds(spark, "reach", keep=2)
    e = edges.select("parent", "child", F.concat(F.lpad(F.col("ord").cast("string"), 9, "0"), F.lit("/")).alias("place")).where("child IS NOT NULL")
    best = rounds.put(spark.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("depth"), F.lit("").alias("path"), F.lit(True).alias("new")))
    while not best.where("new").isEmpty():
        grown = best.where("new").join(e, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", "place").alias("path"), F.lit(True).alias("new"))
        both = best.withColumn("new", F.lit(False)).unionByName(grown)
        # of equal paths the known one is kept, so a node that gains nothing isn't carried on
        best = rounds.put(both.groupBy("node").agg(F.min(F.struct("path", "new", "depth")).alias("b")).select("node", "b.depth", "b.path", "b.new"))
    return best.select("node", "depth", "path")


def closure(edges: DataFrame, root: str) -> DataFrame:
    """``node, depth``: every node that ``root`` leads to, once, with its least depth. A frontier that only gains new nodes:
    one join a level, however many paths lead to a node (a walk by paths would list them all)."""
    spark = edges.sparkSession
    rounds, level = Rounds(spark, "closure", keep=2), 0
    e = edges.select("parent", "child").where("child IS NOT NULL").distinct()
    seen = rounds.put(spark.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("depth")))
    while not (front := seen.where(F.col("depth") == level)).isEmpty():
        level += 1
        grown = front.join(e, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), F.lit(level).alias("depth"))
        seen = rounds.put(seen.unionByName(grown).groupBy("node").agg(F.min("depth").alias("depth")))
    return seen


def descendants(spark: SparkSession, parents: DataFrame, seed: str) -> DataFrame:
    """``id, steps``: nodes of ``parents(id, parent)`` whose chain of parents leads to ``seed``, itself included (0 steps).

    Pointer jumping: every node points to an ancestor, at first its parent, and each round to what that one points to, so
    a chain of n nodes takes log2(n) joins. A node is settled when it points to the seed, or past a node without a parent
    or out of the table. In every round some node settles unless all that are left lead into cycles: then they don't lead
    to the seed, and the walk ends. Of several parents of an id the greatest counts; null ids are left out."""
    rounds, before = Rounds(spark, "ancestry", keep=2), None
    own = parents.where("id IS NOT NULL").groupBy("id").agg(F.max("parent").alias("to"))
    is_seed = F.col("id").eqNullSafe(F.lit(seed))
    found = is_seed | F.col("to").eqNullSafe(F.lit(seed))
    unsettled = ~found & (F.coalesce("to", F.lit("")) != "")
    now = rounds.put(own.select("id", "to", F.when(is_seed, 0).otherwise(1).cast("long").alias("steps"), found.alias("found"), unsettled.alias("open")))
    while (left := now.where("open").count()) and left != before:
        before = left
        next_ = now.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"), F.col("found").alias("found2"), F.col("open").alias("open2"))
        jumped = now.where("open").join(next_, "to", "left").select("id", F.col("to2").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.coalesce("found2", F.lit(False)).alias("found"), F.coalesce("open2", F.lit(False)).alias("open"))
        now = rounds.put(now.where("NOT open").unionByName(jumped))
    root = spark.range(1).select(F.lit(seed).alias("id"), F.lit(0).cast("long").alias("steps"))
    return now.where("found").select("id", "steps").unionByName(root).groupBy("id").agg(F.min("steps").alias("steps"))


def explorations(spark, nodes: DataFrame, relevance: str | None = None, seed: str | None = None, expandable: bool = False, citers: DataFrame | None = None) -> DataFrame:
    """Explored papers by depth and year. Expandable are relevant papers of whose citers (``citers(s2_id, citing)``) there
    are some that aren't explored; papers without citers are not."""
    out = nodes
    if relevance:
        out = out.where(F.col("relevance") == relevance)
    if seed:
        out = out.join(descendants(spark, nodes.select(F.col("s2_id").alias("id"), F.col("parent").alias("parent")), seed).select(F.col("id").alias("s2_id")), "s2_id", "left_semi")
    if expandable:
        open_ = citers.join(nodes.select(F.col("s2_id").alias("citing")), "citing", "left_anti").select("s2_id").distinct()
        out = out.where(F.col("relevance") == "relevant").join(open_, "s2_id", "left_semi")
    return out.orderBy("depth", F.desc(F.coalesce("year", F.lit(0))), "s2_id")


# What an explored paper can be.
RELEVANCE = ("unknown", "relevant", "irrelevant", "deferred")


def mark(nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """``nodes`` with the relevance and note of ``marks (s2_id, relevance, note)``: unknown states and papers change
    nothing, an empty note keeps the old one."""
    good = marks.where(F.col("relevance").isin(*RELEVANCE)).select("s2_id", F.col("relevance").alias("__r"), F.col("note").alias("__n"))
    own = nodes.join(good, "s2_id", "left")
    return own.withColumns({"relevance": F.coalesce("__r", "relevance"), "note": F.when(F.coalesce("__n", F.lit("")) != "", F.col("__n")).otherwise(F.col("note"))}).drop("__r", "__n")


def explore(nodes: DataFrame, fetched: DataFrame, now: str, days: float = 7.0) -> DataFrame:
    """``nodes`` with papers fetched anew (``s2_id, title, year, abstract, parent, depth, fetched_at``): one that was fetched
    less than ``days`` ago stays as it is; of others relevance and note stay, an empty parent and depth 0 keep the old ones,
    and abstracts are cut to 500 characters."""
    old = nodes.select("s2_id", *(F.col(c).alias(f"__{c}") for c in ("title", "year", "abstract", "parent", "depth", "fetched_at", "relevance", "note")))
    both = old.join(fetched.withColumn("__new", F.lit(True)), "s2_id", "full_outer")
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.try_to_timestamp("__fetched_at"))) / 86_400_000_000
    keep = F.col("__new").isNull() | F.coalesce(age < days, F.lit(False))
    pick = lambda c, new: F.when(keep, F.col(f"__{c}")).otherwise(new).alias(c)
    return both.select(
        "s2_id",
        pick("title", F.col("title")),
        pick("year", F.col("year")),
        pick("abstract", F.left("abstract", F.lit(500))),
        pick("parent", F.when(F.coalesce("parent", F.lit("")) != "", F.col("parent")).otherwise(F.col("__parent"))),
        pick("depth", F.when(F.coalesce("depth", F.lit(0)) != 0, F.col("depth")).otherwise(F.coalesce("__depth", F.lit(0)))),
        pick("fetched_at", F.col("fetched_at")),
        F.coalesce("__relevance", F.lit("unknown")).alias("relevance"),
        F.coalesce("__note", F.lit("")).alias("note"),
    )


def new_edges(known: DataFrame, fetched: DataFrame, papers: DataFrame | None = None, min_year: int | None = None) -> DataFrame:
    """Edges (``citing, cited``) that aren't known yet, once each, without null ids; with ``min_year`` only those whose
    citing paper (``papers(citing, year)``) is that young."""
    out = fetched.dropna(subset=["citing", "cited"]).dropDuplicates(["citing", "cited"]).join(known.select("citing", "cited"), ["citing", "cited"], "left_anti")
    if min_year is not None:
        out = out.join(papers.where(F.col("year") >= min_year).select("citing"), "citing", "left_semi")
    return out
