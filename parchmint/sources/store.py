"""Tables that grow by small commits and are resolved when they are read.

A commit adds rows to some tables and marks keys as replaced or gone; it counts once its last part, the marks, is whole. So
a removal writes the marked keys alone, whatever the tables hold, and holds for all tables or for none. Rows that a failed
commit left behind are never read. Reading keeps, of each table's rows, those that no later mark of their key hides.
``compact`` writes a table's rows anew, apart from the writers; ``vacuum`` deletes what nothing reads any more.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MARKS = "name string, key string, seq long"


class Store:
    """``tables``: name to (key column, schema as DDL). Keys are compared as text; rows without a key are left out. One writer
    at a time; readers need no lock."""

    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, tuple[str, str]]):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), dict(tables)

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _listed(self, folder: str) -> dict[str, bool]:
        """Folders of commits by name, and whether each is whole."""
        top = self._path(f"{self.path}/{folder}")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return {}
        return {s.getPath().getName(): fs.exists(self._path(f"{s.getPath()}/_SUCCESS")) for s in fs.listStatus(top) if s.isDirectory()}

    def _commits(self) -> list[int]:
        return sorted(int(n) for n, whole in self._listed("commits").items() if whole)

    def _next(self) -> int:
        """Above every number that was ever begun."""
        used = [int(n) for n in self._listed("commits")]
        for t in self.tables:
            used += [int(n.split(".")[0]) for n in self._listed(f"tables/{t}")]
        return max(used, default=0) + 1

    def _parts(self, name: str, commits: Iterable[int]) -> tuple[int, list[str]]:
        """(number of the last compaction, folders from there on) of a table, of whole commits."""
        whole = set(commits)
        found = [(int(n.split(".")[0]), n) for n, done in self._listed(f"tables/{name}").items() if done]
        found = sorted(x for x in found if x[0] in whole)
        base = max((seq for seq, n in found if n.endswith(".base")), default=0)
        return base, [f"{self.path}/tables/{name}/{n}" for seq, n in found if seq >= base]

    def _commit(self, seq: int, marks: DataFrame | None) -> None:
        none = self.spark.createDataFrame([], "name string, key string")
        own = none if marks is None else marks.where("key IS NOT NULL").distinct()
        own.withColumn("seq", F.lit(seq).cast("long")).write.parquet(f"{self.path}/commits/{seq:012d}")

    def upsert(self, rows: Mapping[str, DataFrame]) -> int:
        """All rows of the given keys are replaced by the given ones, in all the tables named or in none. Returns the commit."""
        seq, marks = self._next(), None
        for name, df in rows.items():
            key, schema = self.tables[name]
            out = df.select(*self.spark.createDataFrame([], schema).columns).where(F.col(key).isNotNull())
            path = f"{self.path}/tables/{name}/{seq:012d}"
            out.withColumn("__seq", F.lit(seq).cast("long")).write.parquet(path)
            part = self.spark.read.parquet(path).select(F.lit(name).alias("name"), F.col(key).cast("string").alias("key")).distinct()
            marks = part if marks is None else marks.unionByName(part)
        self._commit(seq, marks)
        return seq

    def remove(self, keys: DataFrame, names: Iterable[str] | None = None) -> int:
        """Hide all rows of ``keys (key)`` in the named tables (all of them): only marks are written."""
        seq = self._next()
        named = F.explode(F.array(*(F.lit(n) for n in (self.tables if names is None else names))))
        self._commit(seq, keys.select(named.alias("name"), F.col("key").cast("string").alias("key")))
        return seq

    def read(self, name: str, upto: int | None = None) -> DataFrame:
        """The rows of a table as of its last commit (or of ``upto``; compaction ends what can be gone back to). The marks meet
        the rows by key: broadcast where they are small, by the size that Spark sees."""
        key, schema = self.tables[name]
        commits = [c for c in self._commits() if upto is None or c <= upto]
        base, parts = self._parts(name, commits)
        if not parts:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, __seq long").parquet(*parts)
        later = [f"{self.path}/commits/{c:012d}" for c in commits if c > base]
        if later:
            marks = self.spark.read.schema(_MARKS).parquet(*later).where(F.col("name") == name)
            last = marks.groupBy(F.col("key").alias("__key")).agg(F.max("seq").alias("__last"))
            rows = rows.join(last, F.col(key).cast("string") == F.col("__key"), "left").where("__seq >= coalesce(__last, 0L)").drop("__key", "__last")
        return rows.drop("__seq")

    def keys(self, name: str) -> DataFrame:
        """Which keys a table has: ``key, rows``."""
        return self.read(name).groupBy(F.col(self.tables[name][0]).alias("key")).agg(F.count("*").alias("rows"))

    def compact(self, name: str) -> int:
        """Write what ``read`` gives as the table's new beginning."""
        rows, seq = self.read(name), self._next()
        rows.withColumn("__seq", F.lit(seq).cast("long")).write.parquet(f"{self.path}/tables/{name}/{seq:012d}.base")
        self._commit(seq, None)
        return seq

    def vacuum(self) -> None:
        """Delete folders before each table's last compaction or without a whole commit, and commits before all compactions."""
        commits = self._commits()
        bases = []
        for name in self.tables:
            base, parts = self._parts(name, commits)
            bases.append(base)
            for n in self._listed(f"tables/{name}"):
                path = f"{self.path}/tables/{name}/{n}"
                if path not in parts:
                    self._delete(path)
        for n in self._listed("commits"):
            if int(n) < min(bases, default=0):
                self._delete(f"{self.path}/commits/{n}")

    def _delete(self, path: str) -> None:
        p = self._path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
