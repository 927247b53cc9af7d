"""Ordered computations: as-of, forward fill, first and last wins, hierarchies, segments, neighbourhoods, paging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, take: Sequence[str]) -> DataFrame:
    """Each left row with ``take`` of the last right row of its group at or before it: one union, one shuffle, one
    window (a theta join would compare all rows of a group)."""
    empty = {c: F.lit(None).cast(right.schema[c].dataType) for c in take}
    rest = [c for c in left.columns if c not in (*by, on)]
    a = left.withColumns({f"__{c}": v for c, v in empty.items()}).withColumn("__side", F.lit(1))
    b = right.select(*by, on, *(F.col(c).alias(f"__{c}") for c in take))
    b = b.withColumns({c: F.lit(None).cast(left.schema[c].dataType) for c in rest}).withColumn("__side", F.lit(0))
    w = Window.partitionBy(*by).orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("__hit", F.last(F.when(F.col("__side") == 0, F.struct(*(f"__{c}" for c in take))), ignorenulls=True).over(w))
    return both.where("__side = 1").select(*left.columns, *(F.col("__hit")[f"__{c}"].alias(c if c not in left.columns else f"{c}_right") for c in take))


def forward_fill(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str, to: str) -> DataFrame:
    """``value`` carried down from the last row that has one, the row itself included."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.last(value, ignorenulls=True).over(w))


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in ``order`` (descending order keeps the last)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys; of several new rows the first in ``order``."""
    fresh = keep_one(new, keys, order)
    return old.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh.select(*old.columns))


def parents(df: DataFrame, by: Sequence[str], order: str, depth: str, levels: int) -> DataFrame:
    """Each entry's parent: the nearest earlier entry that is shallower. One running window, a column for each level."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    above = [F.when(F.col(depth) > d, F.last(F.when(F.col(depth) == d, F.col(order)), ignorenulls=True).over(w)) for d in range(levels)]
    return df.withColumn("parent", F.greatest(*above) if len(above) > 1 else above[0])


def segments(df: DataFrame, by: Sequence[str], order: str, starts: Column, to: str) -> DataFrame:
    """Running number of the segment that a row belongs to; a new one begins where ``starts`` holds."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.sum(F.when(starts, 1).otherwise(0)).over(w))


def around(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, reach: int, to: str) -> DataFrame:
    """``value`` of the rows from ``reach`` before to ``reach`` after, in order, as an array."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-reach, reach)
    return df.withColumn(to, F.collect_list(value).over(w))


def page(df: DataFrame, order: Sequence[Column | str], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of rows in a total order, with the number of all rows. Only the rows up to the page's end
    are ranked (a top-k), whatever the table's size."""
    total = df.agg(F.count("*").alias("total"))
    head = df.orderBy(*order).limit(number * size)
    rn = F.row_number().over(Window.orderBy(*order))
    return head.withColumn("rn", rn).where(F.col("rn") > (number - 1) * size).crossJoin(total)


def disambiguate(df: DataFrame, base: str, order: Sequence[Column | str], to: str) -> DataFrame:
    """Keys that share a base get letters: the first stays plain, then ``a`` to ``z``; beyond that null."""
    rn = F.row_number().over(Window.partitionBy(base).orderBy(*order))
    letter = F.when(rn == 1, "").when(rn <= 27, F.char(F.lit(95) + rn))
    return df.withColumn(to, F.concat(F.col(base), letter))
