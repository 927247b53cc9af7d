"""Tasks and freshness: ranking of what needs doing, expiry, cache statistics."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.sources.staging import Rounds


def task_score(done: Column, now: Column, cadence_hours: Column, changed: Column) -> Column:
    """Never done (or unreadable) 1000; changed since 100 and the overdue ratio; else hours over cadence. Cadence 0 and
    less: only changes count."""
    hours = (F.unix_micros(now) - F.unix_micros(done)) / 3_600_000_000
    ratio = F.when(cadence_hours > 0, hours / cadence_hours).otherwise(F.lit(0.0))
    return F.when(done.isNull(), F.lit(1000.0)).when(changed, F.lit(100.0) + ratio).otherwise(ratio)


def rank(items: DataFrame, limit: int) -> DataFrame:
    return items.where("score > 0").orderBy(F.desc("score"), "file", "task").limit(limit)


def expired(fetched_at: Column, ttl_days: Column, now: Column) -> Column:
    """Older than the time to live; unreadable dates never expire."""
    age = (F.unix_micros(now) - F.unix_micros(F.try_to_timestamp(fetched_at))) / 86_400_000_000
    return F.coalesce(age > ttl_days, F.lit(False))


def cache_stats(cache: DataFrame, service: str, kind: str, size: str) -> DataFrame:
    """Entries and bytes by service and kind, by service and in all: one rollup."""
    return cache.rollup(service, kind).agg(F.count("*").alias("entries"), F.sum(size).alias("bytes"))


def append_numbered(rows: DataFrame, new: DataFrame, number: str, order: str) -> DataFrame:
    """``rows`` and ``new`` (in ``order``) numbered on from the greatest number. New rows are dealt by range and numbered where
    they lie, from the counts of the parts before; no task gets them all."""
    top = rows.agg(F.coalesce(F.max(number), F.lit(0)).alias("__top"))
    dealt = new.repartitionByRange(order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    placed = Rounds(new.sparkSession, "numbered").put(dealt).withColumn("__part", F.shiftright("__at", 33))
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = placed.groupBy("__part").count().select("__part", before.alias("__before"))
    ranked = placed.join(parts, "__part").crossJoin(top)
    nth = F.col("__top") + F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.unionByName(ranked.withColumn(number, nth.cast(rows.schema[number].dataType)).select(*rows.columns))


def by_glob(defined: DataFrame, files: DataFrame, block: int = 64) -> DataFrame:
    """``file`` and the columns of ``defined (task, glob, ...)`` for every file that a task's glob (``*``, ``?``) names. The
    tasks are a project's stated list: each block of them is one filter over the files, without a join."""
    names = defined.columns
    tasks_ = [r.asDict() for r in defined.orderBy("task", "glob").toLocalIterator()]
    out = None
    for k in range(0, len(tasks_), block):
        some = tasks_[k : k + block]
        made = [F.struct(*(F.lit(t[n]).cast(defined.schema[n].dataType).alias(n) for n in names)) for t in some]
        rules = [F.regexp_like("file", F.lit("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in t["glob"]) + r"\z")) for t in some]
        hit = F.array_compact(F.array(*(F.when(r, m) for r, m in zip(rules, made, strict=True))))
        part = files.select("file", F.explode(hit).alias("t")).select("file", "t.*")
        out = part if out is None else out.unionAll(part)
    return out


def mark_done(state: DataFrame, done: DataFrame, latest: Sequence[str]) -> DataFrame:
    """``id, task, file, done``: completions by task and file, the latest of new ones in place of what was there; the id is
    ``task::file``."""
    w = Window.partitionBy("task", "file").orderBy(*(F.desc(c) for c in latest))
    fresh = done.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").select("task", "file", "done")
    kept = state.join(fresh.select("task", "file"), ["task", "file"], "left_anti").unionByName(fresh)
    return kept.select(F.concat_ws("::", "task", "file").alias("id"), "task", "file", "done")


def keep_unless_given(rows: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``rows`` with what ``new`` gives by key; empty values keep the old ones, unknown keys are added."""
    n = new.select(key, *(F.nullif(F.col(c), F.lit("")).alias(f"__{c}") for c in columns))
    return rows.join(n, key, "full_outer").select(key, *(F.coalesce(f"__{c}", c).alias(c) for c in columns))


def advice(rows: DataFrame) -> DataFrame:
    """``category, delta`` from ``kind, newest, built`` (seconds): an empty library, a waiting inbox, what is older than its
    sources and by how much (``s``, ``m`` or ``h``)."""
    k, new = F.col("kind"), F.col("newest")
    category = F.when((k == "papers") & new.isNull(), "papers_empty").when((k == "inbox") & (new > 0), "inbox_pending").when(new > F.col("built"), F.concat(k, F.lit("_stale")))
    behind = (new - F.col("built")).cast("long")
    text = lambda n, unit: F.concat(F.floor(behind / n).cast("string"), F.lit(unit))
    delta = F.when(behind.isNull(), None).when(behind < 60, text(1, "s")).when(behind < 3600, text(60, "m")).otherwise(text(3600, "h"))
    return rows.select(category.alias("category"), delta.alias("delta")).where("category IS NOT NULL")
