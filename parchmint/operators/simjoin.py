"""Similarity joins by lossless filters over words and characters, then exact scores.

A token is rare or common by the rows of both sides that have it. If two rows must share at least ``m`` of a row's ``n`` tokens,
they share one of its ``n - m + 1`` rarest: only these are looked up, by an equi-join on tokens. The bounds follow from the
scores' definitions, so no pair that reaches the threshold is lost; nothing is capped, and neither side goes to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.operators.search import Ratios, bags
from parchmint.sources.staging import Rounds


@F.pandas_udf(T.StringType())
def word_set(text: pd.Series) -> pd.Series:
    """Distinct words, sorted, with single spaces: all that a token-set ratio depends on."""
    return text.map(lambda t: " ".join(sorted(set((t or "").split()))))


def grams(text: Column, n: int) -> Column:
    """Runs of ``n`` characters, each with the number of its earlier occurrences: what two such lists share is what the
    bags of runs share. A text shorter than ``n`` has none."""
    at = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    sorted_ = F.array_sort(F.transform(at, lambda i: F.substring(text, i, F.lit(n))))

    def numbered(x: Column) -> Column:
        return F.transform(x, lambda g, i: F.concat(g, F.lit("\x1f"), (i - F.array_position(x, g).cast("int") + 1).cast("string")))

    return F.transform(F.array(sorted_), numbered)[0]


def _tasks(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame) -> DataFrame:
    """Dealt over all cores: for rows that are small in bytes and dear to work on, so that partitions aren't chosen by size."""
    return rows.repartition(_tasks(rows.sparkSession))


def _order(tokens: DataFrame) -> DataFrame:
    """``t, df``: how many rows have each token; one that isn't listed is rarest."""
    return tokens.groupBy("t").agg(F.count("*").alias("df"))


def _rarest(tokens: DataFrame, df: DataFrame, by: str, most: str) -> DataFrame:
    """Of each row's tokens the ``most`` rarest (a column)."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.coalesce("df", F.lit(0)), "t"))
    return tokens.join(df, "t", "left").withColumn("rn", rank).where(F.col("rn") <= F.col(most)).drop("rn", "df", most)


def _lookup_words(asked: DataFrame, known: DataFrame, cover: float, a: str, b: str) -> DataFrame:
    """Pairs (``a``, ``b``) that may share words of ``cover`` of the length of ``a``."""
    own = asked.select(a, F.length(a).alias("la"), F.explode(F.split(a, " ")).alias("t"))
    index = known.select(b, F.explode(F.split(b, " ")).alias("t"))
    ranked = own.join(_order(index), "t")  # words that the other side lacks can't be shared
    common = Window.partitionBy(a).orderBy(F.desc("df"), "t").rowsBetween(Window.unboundedPreceding, 0)
    # the commonest words, as long as they alone can't cover enough, needn't be looked up
    first = ranked.withColumn("upto", F.sum(F.length("t") + 1).over(common)).where(F.col("upto") - 1 >= cover * F.col("la") - 1e-6)
    n = _tasks(asked.sparkSession)
    return first.select(a, "t").repartition(n, "t").join(index.repartition(n, "t"), "t").select(a, b)


#: Word sets of either side that meet in a cell, on the average.
BLOCK = 16384


def set_pairs(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """``s, s2, ratio``: all pairs of word sets (columns ``s`` and ``s2``, distinct, as ``word_set`` gives them, not empty) with a
    token-set ratio of ``least`` and more.

    A ratio reaches it in one of three ways. The common words cover ``least / (2 - least)`` of one side's length: looked up
    from either side. Or the whole strings have a common subsequence of ``least`` of their mean length: then they share as
    many characters, in any order, and their lengths differ by the factor ``(2 - least) / least`` at most. Strings of few
    different letters share most of these with most others, so an index would only list nearly all pairs: rows meet by classes
    of length in cells of ``BLOCK`` by ``BLOCK``, where products of matrices count what they share. That is quadratic in
    the sets of a class, but of some nanoseconds a pair; a task holds one side of a cell and a part of the other."""
    if not 0.7 <= least <= 1:
        raise ValueError("ratios below 0.7 leave no bound on what is shared")
    rounds = Rounds(asked.sparkSession, "pairs")
    asked, known = rounds.put(asked.select("s")), rounds.put(known.select("s2"))
    cover, ratio = least / (2 - least), (2 - least) / least
    met = _lookup_words(asked, known, cover, "s", "s2").unionByName(_lookup_words(known, asked, cover, "s2", "s"))

    def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pdf = pdf.drop_duplicates()
            pairs = [(x, y) for x, y in zip(pdf["s"].tolist(), pdf["s2"].tolist(), strict=True) if len(" ".join(set(x.split()) & set(y.split()))) >= cover * min(len(x), len(y)) - 1e-6]
            yield pd.DataFrame(_scored(pairs, least), columns=["s", "s2", "ratio"])

    # pairs are scored where they meet and only those that are near are shuffled; the others are many times the input
    covered = met.mapInPandas(score, "s string, s2 string, ratio double")

    size = lambda n: F.floor(F.log(n.cast("double")) / (4 * math.log(ratio)) if ratio > 1 else n).cast("int")
    many, parts = [max(1, -(-x.count() // BLOCK)) for x in (asked, known)], []
    for rows, c, side in ((known, "s2", 0), (asked, "s", 1)):
        n = F.length(c)
        low, high = (n, n) if side == 0 else (F.ceil(n * cover - 1e-6), F.floor(n / cover + 1e-6))
        own = F.pmod(F.hash(c), F.lit(many[1 - side]))
        rows = rows.select(F.col(c).alias("s"), F.lit(side).alias("side"), own.alias("own"), F.explode(F.sequence(size(low), size(high))).alias("size"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(many[side] - 1))))
        parts.append(rows.select(F.concat_ws(" ", "size", *(("own", "other") if side else ("other", "own"))).alias("cell"), "side", "s"))
    n = max(_tasks(asked.sparkSession), min(4 * many[0] * many[1], 4096))
    cells = parts[0].unionByName(parts[1]).repartition(n, "cell").sortWithinPartitions("cell", "side")

    def meet(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, block, held = None, None, []
        for pdf in it:
            for name, part in pdf.groupby("cell", sort=False):
                if name != cell:
                    cell, block, held = name, None, []
                first = part["side"] == 0
                held += part["s"][first].tolist()
                new = part["s"][~first].tolist()
                if new and held:
                    block = block or _Block(held, least)
                    for low in range(0, len(new), 8192):
                        yield from block.near(new[low : low + 8192])

    return covered.unionByName(cells.mapInPandas(meet, "s string, s2 string, ratio double")).distinct()


def _scored(pairs: list[tuple[str, str]], least: float) -> list[tuple[str, str, float]]:
    ratios = Ratios()
    for low in range(0, len(pairs), 1 << 16):
        for a, b in pairs[low : low + (1 << 16)]:
            ratios.add(ratios.words(a, 0), ratios.words(b, 1))
        pairs[low : low + (1 << 16)] = [(*x, r) for x, r in zip(pairs[low : low + (1 << 16)], ratios.take(), strict=True)]
    return [x for x in pairs if x[2] >= least]


class _Block:
    """Strings that others are held against: shared characters by a product of matrices, then shared neighbouring two, then
    the ratio."""

    CLASSES, PLACES = 32, 128

    def __init__(self, texts: list[str], least: float):
        self.texts, self.least = sorted(texts, key=len), least
        self.size = np.array([len(x) for x in self.texts], int)
        # a place is a class of characters and how often it stands at least; those that tell most strings apart are used
        bag, self.pick = bags(self.texts, self.CLASSES), []
        self.most = bag.max(0)
        for c in range(self.CLASSES):
            often = np.bincount(bag[:, c])
            share = often[::-1].cumsum()[::-1][1:] / len(bag)
            self.pick += [(-x * (1 - x), c, k + 1) for k, x in enumerate(share.tolist())]
        self.pick = sorted(self.pick)[: self.PLACES]
        places = self._places(bag)
        # the length's share is part of the product, so that what is left is a comparison with 0
        self.matrix = np.concatenate([places, -least / 2 * self.size[:, None], -np.ones((len(places), 1))], 1).astype(np.float32).T.copy()
        self.two = bags(self.texts, 512, True)

    def _places(self, bag: np.ndarray) -> np.ndarray:
        return bag[:, [c for _, c, _ in self.pick]] >= np.array([k for _, _, k in self.pick], int)

    def near(self, texts: list[str]) -> Iterator[pd.DataFrame]:
        """``s, s2, ratio`` of pairs whose whole strings can have a long enough common subsequence, and that reach the ratio."""
        texts = sorted(texts, key=len)
        size = np.array([len(x) for x in texts], int)
        bag = bags(texts, self.CLASSES)
        places = self._places(bag)
        # places that aren't used may all be shared
        goal = self.least / 2 * size - (np.minimum(bag, self.most).sum(1) - places.sum(1))
        left = np.concatenate([places, np.ones((len(places), 1)), goal[:, None]], 1).astype(np.float32)
        two = bags(texts, 512, True)
        cover = self.least / (2 - self.least)
        for low in range(0, len(texts), 256):
            high = min(low + 256, len(texts))
            a, b = np.searchsorted(self.size, [size[low] * cover - 1e-6, size[high - 1] / cover + 1e-6])
            slack = 1e-3 + 1e-6 * float(size[high - 1] + self.size[-1])
            found = np.flatnonzero(left[low:high] @ self.matrix[:, a:b] >= -slack)
            near = []
            for some in np.array_split(found, -(-len(found) // 8192)) if len(found) else []:
                i, j = np.divmod(some, b - a)
                i, j = i + low, j + a
                need = self.least * (size[i] + self.size[j]) / 2 - 1e-6
                ok = np.minimum(two[i], self.two[j]).sum(1) >= 3 * need - size[i] - self.size[j] - 3
                near += [(texts[x], self.texts[y]) for x, y in zip(i[ok].tolist(), j[ok].tolist(), strict=True)]
            out = _scored(near, self.least)
            if out:
                yield pd.DataFrame(out, columns=["s", "s2", "ratio"])


def _titles(new: DataFrame, key: str, title: str, known: DataFrame, known_key: str, known_title: str, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``__n, s`` of new rows, ``__k, s2`` of known ones, and ``set_pairs`` of their distinct word sets."""
    rounds = Rounds(new.sparkSession, "titles")
    asked = rounds.put(new.select(F.col(key).alias("__n"), word_set(F.col(title)).alias("s")).where("s <> ''"))
    rows = rounds.put(known.where(F.col(known_title).isNotNull()).select(F.col(known_key).alias("__k"), word_set(F.col(known_title)).alias("s2")).where("s2 <> ''"))
    return asked, rows, set_pairs(asked.select("s").distinct(), rows.select("s2").distinct(), least)


def title_hits(new: DataFrame, key: str, title: str, known: DataFrame, known_key: str, known_title: str, least: float = 0.9) -> DataFrame:
    """``key, known_key, ratio``: all known titles that are much the same as a new one. Distinct word sets of both sides are
    joined by ``set_pairs``; copies of a title meet only when keys are joined back. Titles without a word match nothing."""
    asked, rows, pairs = _titles(new, key, title, known, known_key, known_title, least)
    return asked.join(pairs, "s").join(rows, "s2").select(F.col("__n").alias(key), F.col("__k").alias("known_key"), "ratio")


def first_hits(new: DataFrame, key: str, title: str, known: DataFrame, known_key: str, known_title: str, least: float = 0.9, other: bool = False) -> DataFrame:
    """``key, known_key, ratio, hits``: of the rows of ``title_hits`` for each new key the one with the least known key, and their
    number; null keys have none. With ``other`` a key's hits with itself are left out. Copies of a title are counted first, so that new
    and known copies never meet row by row."""
    asked, rows, pairs = _titles(new, key, title, known, known_key, known_title, least)
    rounds = Rounds(new.sparkSession, "hits")
    pairs = rounds.put(pairs)
    rows = rows.where("__k IS NOT NULL")

    def least_of(df: DataFrame, by: str) -> DataFrame:
        """The least ``v``; with ``other`` that of the next key as well, since one of two at most is a new row's own."""
        first = df.groupBy(by).agg(F.min("v").alias("v"))
        if not other:
            return first
        rest = df.join(first.withColumnRenamed("v", "w"), by).where(F.col("v.__k") > F.col("w.__k"))
        return first.unionByName(rest.groupBy(by).agg(F.min("v").alias("v")))

    keys = pairs.join(least_of(rows.select("s2", F.struct("__k").alias("v")), "s2"), "s2").select("s", F.struct("v.__k", "ratio").alias("v"))
    keys = least_of(keys, "s").groupBy("s").agg(F.array_sort(F.collect_list("v")).alias("m"))
    sums = pairs.join(rows.groupBy("s2").agg(F.count("*").alias("n")), "s2").groupBy("s").agg(F.sum("n").alias("hits"))
    # written, so that the join with a title's many copies can be split
    found = asked.where("__n IS NOT NULL").join(rounds.put(keys.join(sums, "s")), "s")
    if other:
        own = asked.distinct().join(rows, F.col("__n") == F.col("__k")).join(pairs, ["s", "s2"]).groupBy("s", "__n").agg(F.count("*").alias("own"))
        found = found.join(own, ["s", "__n"], "left").withColumn("m", F.filter("m", lambda x: x["__k"] != F.col("__n"))).withColumn("hits", F.col("hits") - F.coalesce("own", F.lit(0)))
    found = found.where("hits > 0").select("__n", F.get("m", F.lit(0)).alias("m"), "hits")
    found = found.groupBy("__n").agg(F.min_by("m", "m.__k").alias("m"), F.sum("hits").alias("hits"))
    return found.select(F.col("__n").alias(key), F.col("m.__k").alias("known_key"), "m.ratio", "hits")


def _can_share(a: list[str], b: list[str], goal: float | np.ndarray, loss: int) -> np.ndarray:
    """Which pairs can have a common subsequence of ``goal`` of their mean length: by the characters in common, and by the
    neighbouring two, of which ``3 L - la - lb - loss`` stay. Bags are counted once for each string of the batch."""
    codes, every = pd.factorize(np.array([*a, *b], object))
    x, y = codes[: len(a)], codes[len(a) :]
    size = np.array([len(t) for t in every], int)
    need = np.asarray(goal) * (size[x] + size[y]) / 2 - 1e-6
    ok = np.minimum(size[x], size[y]) >= need
    one = bags(list(every))
    ok[ok] = np.minimum(one[x[ok]], one[y[ok]]).sum(1) >= np.broadcast_to(need, ok.shape)[ok]
    two = bags(list(every), 512, True)
    ok[ok] = np.minimum(two[x[ok]], two[y[ok]]).sum(1) >= 3 * need[ok] - size[x[ok]] - size[y[ok]] - loss
    return ok


def _ratios(pairs: DataFrame) -> DataFrame:
    """``asked, key, ratio`` of the pairs that reach their ``goal``, by matching blocks (the longest first, then what is left on
    either side of it)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        match, last = SequenceMatcher(), None
        for pdf in it:
            pdf = pdf[_can_share(pdf["asked"].tolist(), pdf["key"].tolist(), pdf["goal"].to_numpy(), 1)] if len(pdf) else pdf
            out = []
            for a, k, goal in zip(pdf["asked"], pdf["key"], pdf["goal"], strict=True):
                if a != last:
                    match.set_seq2(a)
                    last = a
                match.set_seq1(k)
                if match.quick_ratio() >= goal:
                    ratio = match.ratio()
                    if ratio >= goal:
                        out.append((a, k, ratio))
            yield pd.DataFrame(out, columns=["asked", "key", "ratio"])

    return spread(pairs.select("asked", "key", "goal")).sortWithinPartitions("asked").mapInPandas(run, "asked string, key string, ratio double")


#: Up to so many subsequences of a key are looked up, and from this ratio on.
SUBSEQUENCES, ALIKE = 2048, 0.9


def _subsequences(rows: DataFrame, text: str, left: str) -> DataFrame:
    """``rows`` with ``h``, once for each hash of the subsequences of ``left`` characters of ``text``. Equal ones have equal hashes."""
    schema = T.StructType([*rows.schema.fields, T.StructField("h", T.LongType())])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for (size, keep), same in pdf.groupby([pdf[text].str.len(), left]):
                kept = np.array(list(combinations(range(size), keep)), int).reshape(-1, keep)
                factor = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(keep)], np.uint64)
                for low in range(0, len(same), step := max(1, (1 << 18) // len(kept))):
                    part = same.iloc[low : low + step]
                    points = np.frombuffer("".join(part[text]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size).astype(np.uint64)
                    h = np.zeros((len(part), len(kept)), np.uint64)
                    for k in range(keep):
                        h += points[:, kept[:, k]] * factor[k]
                    h.sort(axis=1)
                    row, col = np.nonzero(np.diff(h, axis=1, prepend=~h[:, :1]))
                    yield part.iloc[row].assign(h=h[row, col].view(np.int64))

    return spread(rows).mapInPandas(run, schema)


def _alike(want: DataFrame, have: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(``asked, key`` of pairs that can reach ``least``, ``la, upto``: ratios that may be missing for asked keys of a length).

    Of joint length n, such a pair has a common subsequence of ``least * n / 2`` characters, so leaving out the others gives
    equal strings. Spelt alike or not, keys meet only where they are near. Lengths at which one side would have more than
    ``SUBSEQUENCES`` are left out; their ratios are bounded by the shorter side."""
    sizes = have.select(F.length("key").alias("lk")).distinct()
    keep = F.greatest(F.lit(1), F.ceil(least * (F.col("la") + F.col("lk")) / 2 - 1e-6).cast("int"))

    def ways(n: Column, gone: Column) -> Column:
        return F.when(gone == 0, 1).when(gone == 1, n).when(gone == 2, n * (n - 1) / 2).when(gone == 3, n * (n - 1) * (n - 2) / 6).otherwise(2.0 * SUBSEQUENCES)

    most = F.greatest(*(ways(F.col(c).cast("double"), F.col(c) - F.col("keep")) for c in ("la", "lk")))
    meets = want.select(F.length("asked").alias("la")).distinct().crossJoin(sizes).withColumn("keep", keep).where(F.col("keep") <= F.least("la", "lk")).withColumn("most", most)
    open_ = meets.where(F.col("most") > SUBSEQUENCES).groupBy("la").agg(F.max(2 * F.least("la", "lk") / (F.col("la") + F.col("lk"))).alias("upto"))
    meets = meets.where(F.col("most") <= SUBSEQUENCES).join(open_.where("upto = 1"), "la", "left_anti")
    left = want.withColumn("la", F.length("asked")).join(meets.select("la", "keep").distinct(), "la").select("asked", "keep")
    right = have.withColumn("lk", F.length("key")).join(meets.select("lk", "keep").distinct(), "lk").select("key", "keep")
    n = _tasks(want.sparkSession)
    pairs = _subsequences(left, "asked", "keep").repartition(n, "h").join(_subsequences(right, "key", "keep").repartition(n, "h"), ["keep", "h"])
    return pairs.select("asked", "key").distinct(), open_


def close_keys(asked: DataFrame, keys: DataFrame, n: int = 5, least: float = 0.5) -> DataFrame:
    """``asked, key, ratio``: for every asked key that doesn't exist the ``n`` likeliest keys that do, by matching blocks, from
    ``least`` on; of equal ones the last by name. Null keys are left out.

    First pairs of ``ALIKE`` and more are found by common subsequences: an asked key is answered by ``n`` of them that are
    likelier than any that may be missing.
    For the others, keys that share an asked key's rarest neighbouring two are scored; the nth of them raises its threshold.
    With that, how many neighbouring two, or single characters, a likelier key must share is known, and all keys that can
    share so many are looked up by the rarest of them and scored."""
    rounds = Rounds(keys.sparkSession, "keys")
    have = rounds.put(keys.select("key").where("key IS NOT NULL").distinct())
    want = rounds.put(asked.select(F.col("key").alias("asked")).where("asked IS NOT NULL").distinct().join(have, F.col("asked") == F.col("key"), "left_anti"))
    best = Window.partitionBy("asked").orderBy(F.desc("ratio"), F.desc("key"))
    first = lambda scored: scored.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= n)
    near, open_ = _alike(want, have, max(ALIKE, least))
    near = rounds.put(first(_ratios(near.withColumn("goal", F.lit(max(ALIKE, least))))).select("asked", "key", "ratio"))
    nth = near.groupBy("asked").agg(F.count("*").alias("hits"), F.min("ratio").alias("nth")).where(F.col("hits") == n)
    done = nth.withColumn("la", F.length("asked")).join(open_, "la", "left").where(F.col("nth") > F.coalesce("upto", F.lit(0.0)) + 1e-9).select("asked")
    rest = rounds.put(want.join(done, "asked", "left_anti"))
    near = near.join(done, "asked", "left_semi")
    if not rest.isEmpty():
        near = near.unionByName(first(_by_grams(rounds, rest, have, n, least)).select("asked", "key", "ratio"))
    return near.select("asked", "key", F.round("ratio", 6).alias("ratio"))


def _by_grams(rounds: Rounds, want: DataFrame, have: DataFrame, n: int, least: float) -> DataFrame:
    """``asked, key, ratio``: the ``n`` likeliest keys of each asked one and some others, by neighbouring two and characters."""
    index = have.select("key", F.explode(F.concat(grams(F.col("key"), 1), grams(F.col("key"), 2))).alias("t"))
    index = rounds.put(index)
    own = want.select("asked", F.explode(grams(F.col("asked"), 2)).alias("t"), F.lit(4).alias("most"))
    df = rounds.put(_order(index))
    likely = Window.partitionBy("asked").orderBy(F.desc("shared"), "key")
    seeds = _rarest(own.join(df.select("t"), "t", "left_semi"), df, "asked", "most").join(index, "t").groupBy("asked", "key").agg(F.count("*").alias("shared"))
    seeds = seeds.withColumn("rn", F.row_number().over(likely)).where(F.col("rn") <= 2 * n)
    best = Window.partitionBy("asked").orderBy(F.desc("ratio"), F.desc("key"))
    nth = _ratios(seeds.withColumn("goal", F.lit(least))).withColumn("rn", F.row_number().over(best)).where(F.col("rn") == n).select("asked", "ratio")
    goal = rounds.put(want.join(nth, "asked", "left").select("asked", F.greatest(F.coalesce("ratio", F.lit(0.0)), F.lit(least)).alias("goal")))
    length, total = F.length("asked"), F.length("asked") * (1 + F.col("goal") / (2 - F.col("goal")))
    pairs = F.floor((1.5 * F.col("goal") - 1) * total - 1 + 1e-6)
    single = F.greatest(F.lit(1), F.ceil(F.col("goal") / 2 * total - 1e-6))
    two = goal.where(pairs >= 1).select("asked", "goal", (length - pairs).alias("most"), F.explode(grams(F.col("asked"), 2)).alias("t"))
    one = goal.where(pairs < 1).select("asked", "goal", (length - single + 1).alias("most"), F.explode(grams(F.col("asked"), 1)).alias("t"))
    met = _rarest(two.unionByName(one), df, "asked", "most").join(index, "t").select("asked", "goal", "key").distinct()
    return _ratios(met)
