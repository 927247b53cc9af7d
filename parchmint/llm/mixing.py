"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

A token budget runs down a tree of domains, languages and sources. At every node it is divided among the children by
weight; a child can take no more than ``max_epochs`` times the tokens below it, and what it can't take goes to its
siblings (in proportion to weight, again and again until all fits). Only when a whole node is exhausted does the rest
pass to the node's own siblings, since a node never gets more than its subtree holds. In each leaf the budget is spent
on whole epochs first, then on a prefix of the next epoch, whose order is ``md5(seed:epoch:doc_id)``.

The division has a closed form over windows: with children in the order of capacity / weight, child k is filled when
``capacity_k * (weights from k on) <= (budget - capacities before k) * weight_k``, and the rest share the remainder by
weight. All of it is integer arithmetic, so budgets round down and never exceed the total.

Where a leaf's prefix ends is found from token sums of hash buckets; only the one bucket in which it ends is sorted.
Rows of a hot source are thus summed, never gathered.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.llm._scratch import stage

_BLANK = " \t\n\u000b\f\r"


def token_count(text: str = "text") -> Column:
    """Words between ASCII white space; none for null."""
    core = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_BLANK))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, r"[\x20\x09-\x0D]+"))).cast("long")


@dataclass(frozen=True)
class Mix:
    """Weights by path (``("web",)``, ``("web", "en")``, ``("web", "en", "src0")``); unlisted children weigh
    ``default_weight``. The budget is ``share[0] / share[1]`` of the corpus' tokens, or ``tokens`` where given."""

    levels: Sequence[str]
    weights: Mapping[tuple[str, ...], int] = field(default_factory=dict)
    default_weight: int = 1
    share: tuple[int, int] = (3, 5)
    tokens: int | None = None
    max_epochs: int = 1
    seed: int = 17


def _weight(mix: Mix, keys: Sequence[str]) -> Column:
    """The weight of the path in ``keys``: a lookup in a literal map."""
    listed = [x for path, w in mix.weights.items() if len(path) == len(keys) for x in (F.lit("\x1f".join(path)), F.lit(int(w)).cast("long"))]
    default = F.lit(mix.default_weight).cast("long")
    return F.coalesce(F.try_element_at(F.create_map(*listed), F.concat_ws("\x1f", *keys)), default) if listed else default


def _divide(nodes: DataFrame, within: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``__got``: the parent's ``__budget`` divided among children of ``__w`` and ``__cap``."""
    sort = [F.col("__cap") / F.col("__w"), *map(F.col, order)]
    w = Window.partitionBy(*within).orderBy(*sort)
    before = F.coalesce(F.sum("__cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("__w").over(w.rowsBetween(0, Window.unboundedFollowing))
    out = nodes.where("__w > 0").withColumns({"__left": F.col("__budget") - before, "__rest": after, "__rn": F.row_number().over(w)})
    out = out.withColumn("__full", F.expr("__cap * __rest <= __left * __w"))
    level = F.min(F.when(~F.col("__full"), F.struct("__rn", "__left", "__rest"))).over(Window.partitionBy(*within))
    out = out.withColumn("__level", level)
    return out.withColumn("__got", F.expr("CASE WHEN __full THEN __cap ELSE greatest(0L, (__w * __level.__left) div __level.__rest) END")).drop("__left", "__rest", "__rn", "__full", "__level")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """Leaf table (levels as ``__k0..``, ``__avail`` tokens, ``__n`` rows) with ``__got`` tokens to take from each."""
    depth = len(mix.levels)
    keys = [f"__k{i}" for i in range(depth)]
    leaves = leaves.withColumn("__cap", F.col("__avail") * mix.max_epochs)
    total = F.lit(mix.tokens).cast("long") if mix.tokens is not None else F.expr(f"(sum(__all) OVER () * {mix.share[0]}L) div {mix.share[1]}L")
    parent = None
    for d in range(1, depth + 1):
        own = keys[:d]
        nodes = leaves.groupBy(*own).agg(F.sum("__cap").alias("__cap"), F.sum("__avail").alias("__all"), F.sum("__n").alias("__n"))
        nodes = nodes.withColumn("__w", _weight(mix, own))
        if parent is None:
            nodes = nodes.withColumn("__budget", total)
        else:
            nodes = nodes.join(parent.select(*keys[: d - 1], F.col("__got").alias("__budget")), keys[: d - 1])
        parent = _divide(nodes, keys[: d - 1], own)
    return parent.select(*keys, F.col("__all").alias("__avail"), "__n", "__got")


def _hash(mix: Mix, epoch: str, row_id: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(mix.seed), F.col(epoch), F.col(row_id)))


def decide(docs: DataFrame, mix: Mix, row_id: str = "doc_id", text: str = "text", name: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(narrow rows: levels as ``__k0..``, id, ``n_tokens``; leaf decisions: ``__full`` epochs and ``__cut`` hash)."""
    keys = [f"__k{i}" for i in range(len(mix.levels))]
    narrow = stage(docs.select(row_id, *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in zip(keys, mix.levels, strict=True)), token_count(text).alias("n_tokens")), f"{name}-rows")
    sums = stage(narrow.groupBy(*keys).agg(F.sum("n_tokens").alias("__avail"), F.count("*").alias("__n")), f"{name}-leaves")
    leaves = budgets(sums, mix)
    # hash digits that tell buckets of at most 128 rows apart, four at most (65,536 buckets a leaf)
    digits = F.least(F.lit(4), F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("__n") / 128.0)))).cast("int")
    leaves = leaves.withColumns({"__full": F.expr("CASE WHEN __avail > 0 THEN __got div __avail ELSE 0L END"), "__digits": digits})
    leaves = stage(leaves.withColumn("__rest", F.expr("__got - __full * __avail")), f"{name}-budgets")
    part = narrow.join(leaves.where("__rest > 0").select(*keys, "__full", "__rest", "__digits"), keys)
    part = part.withColumn("__h", _hash(mix, "__full", row_id)).withColumn("__bucket", F.expr("substr(__h, 1, __digits)"))
    run = Window.partitionBy(*keys).orderBy("__bucket")
    bucket = part.groupBy(*keys, "__bucket", "__rest").agg(F.sum("n_tokens").alias("__sum")).withColumn("__upto", F.sum("__sum").over(run))
    last = bucket.where("__upto > __rest").groupBy(*keys).agg(F.min(F.struct("__bucket", (F.col("__upto") - F.col("__sum")).alias("base"))).alias("__last"))
    last = stage(last.select(*keys, F.col("__last.__bucket").alias("__end"), F.col("__last.base").alias("__base")), f"{name}-ends")
    edge = part.join(last, keys).where("__bucket = __end")
    edge = edge.withColumn("__upto", F.col("__base") + F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("__h")))
    cut = edge.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("__upto") <= F.col("__rest"), F.col("__h"))), F.first("__end")).alias("__cut"))
    decided = leaves.join(cut, keys, "left").select(*keys, "__full", F.coalesce("__cut", F.lit("")).alias("__cut"))
    return narrow, stage(decided, f"{name}-decisions")


def _taken(rows: DataFrame, decided: DataFrame, keys: Sequence[str], mix: Mix, row_id: str, epoch: str = "epoch") -> DataFrame:
    part = (F.col("__cut") != "") & (_hash(mix, "__full", row_id) <= F.col("__cut"))
    out = rows.join(decided, list(keys)).withColumn("__times", F.col("__full") + part.cast("long")).where("__times > 0")
    return out.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__times") - 1))).drop("__times", "__full", "__cut")


def mix_sources(docs: DataFrame, mix: Mix, row_id: str = "doc_id", text: str = "text", epoch: str = "epoch") -> DataFrame:
    """The chosen rows of ``docs``, all columns, with column ``epoch`` (long): a row taken in k epochs comes k times.

    Null levels count as the empty name. Rows that share an id share their hash and are taken or left together. Rows
    without tokens (null, empty) cost nothing and are taken when their hash lies before the leaf's cut or their leaf is
    taken whole. A leaf's prefix never exceeds its budget. An empty table gives an empty table.
    """
    keys = [f"__k{i}" for i in range(len(mix.levels))]
    _, decided = decide(docs, mix, row_id, text)
    base = docs.drop(epoch).withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("")) for k, c in zip(keys, mix.levels, strict=True)})
    return _taken(base, decided, keys, mix, row_id, epoch).drop(*keys)


#: Which sources make up which domain (by the number in the source's name): below 10, below 15, the others.
DOMAIN_SQL = "CASE WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int) < 10 THEN 'web' WHEN try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int) < 15 THEN 'books' ELSE 'forum' END"
WEIGHTS = {("web",): 50, ("books",): 30, ("forum",): 20} | {(d, x): w for d in ("web", "books", "forum") for x, w in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))}
MIX = Mix(levels=("domain", "lang", "source"), weights=WEIGHTS, share=(4, 5), max_epochs=2, seed=17)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("domain", F.expr(DOMAIN_SQL))
    narrow, decided = decide(docs, MIX)
    keys = ["__k0", "__k1", "__k2"]
    return _taken(narrow, decided, keys, MIX, "doc_id").select("doc_id", F.col("__k0").alias("domain"), F.col("__k1").alias("lang"), F.col("__k2").alias("source"), "n_tokens", "epoch")


def _level_sql(name: str, keys: str, parent: str, parent_keys: str) -> str:
    """SQL of one level: children of ``parent`` (budget b) by weight and capacity."""
    join = f"JOIN {parent} p USING ({parent_keys})" if parent_keys else f"CROSS JOIN {parent} p"
    w = f"PARTITION BY {parent_keys}" if parent_keys else ""
    return f"""
{name}_n AS (SELECT {keys}, sum(cap)::BIGINT AS cap FROM leaf GROUP BY {keys}),
{name}_o AS (SELECT {", ".join("c." + k for k in keys.split(", "))}, c.cap, coalesce(w.w, 1)::BIGINT AS w, p.b
  FROM {name}_n c {join} LEFT JOIN {name}_w w USING ({keys})),
{name}_r AS (SELECT *, b - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
  sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rst, row_number() OVER o AS rn
  FROM {name}_o WHERE w > 0 WINDOW o AS ({w} ORDER BY cap::DOUBLE / w, {keys})),
{name}_l AS (SELECT *, min(CASE WHEN cap * rst > lft * w THEN rn END) OVER ({w}) AS k FROM {name}_r),
{name} AS (SELECT a.{a_keys(keys)}, CASE WHEN a.k IS NULL OR a.rn < a.k THEN a.cap ELSE greatest(0, (a.w * x.lft) // x.rst) END AS b
  FROM {name}_l a LEFT JOIN {name}_l x ON x.rn = a.k{"".join(f" AND x.{k} = a.{k}" for k in parent_keys.split(", ") if k)})"""


def a_keys(keys: str) -> str:
    return ", a.".join(keys.split(", "))


_LANG_W = ", ".join(f"('{p[0]}', '{p[1]}', {w})" for p, w in WEIGHTS.items() if len(p) == 2)
_DOM_W = ", ".join(f"('{p[0]}', {w})" for p, w in WEIGHTS.items() if len(p) == 1)
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {DOMAIN_SQL} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN trim(coalesce(text, ''), E' \\t\\n\\x0B\\f\\r') = '' THEN 0 ELSE len(string_split_regex(trim(text, E' \\t\\n\\x0B\\f\\r'), '[\\x20\\x09-\\x0D]+')) END::BIGINT AS n_tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS avail, 2 * sum(n_tokens)::BIGINT AS cap FROM d GROUP BY ALL),
top AS (SELECT (sum(avail)::BIGINT * 4) // 5 AS b FROM leaf),
dom_w(domain, w) AS (VALUES {_DOM_W}),
lng_w(domain, lang, w) AS (VALUES {_LANG_W}),
src_w AS (SELECT ''::VARCHAR AS domain, ''::VARCHAR AS lang, ''::VARCHAR AS source, 0 AS w WHERE false),
{_level_sql("dom", "domain", "top", "")},
{_level_sql("lng", "domain, lang", "dom", "domain")},
{_level_sql("src", "domain, lang, source", "lng", "domain, lang")},
plan AS (SELECT domain, lang, source, CASE WHEN avail > 0 THEN b // avail ELSE 0 END AS epochs, CASE WHEN avail > 0 THEN b % avail ELSE 0 END AS rest
  FROM src JOIN leaf USING (domain, lang, source)),
run AS (SELECT d.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || epochs || ':' || doc_id)) AS upto
  FROM d JOIN plan USING (domain, lang, source)),
times AS (SELECT *, (epochs + (rest > 0 AND upto <= rest)::INT)::BIGINT AS n FROM run)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(0, n))::BIGINT AS epoch FROM times
"""
