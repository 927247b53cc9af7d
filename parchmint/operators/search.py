"""Search: exact nearest neighbours with metadata filters, substring and quote search, paragraphs, proximity."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.functions import text as tx
from parchmint.operators.ordered import asof
from parchmint.sources.staging import Rounds


def squared_distance(vector: Column, query: Sequence[float]) -> Column:
    """Squared Euclidean distance to a literal vector, in double arithmetic."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return F.aggregate(F.zip_with(vector.cast("array<double>"), q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)


def nearest(vectors: DataFrame, query: Sequence[float], n: int, row_id: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """The ``n`` nearest rows by squared distance, ties by id: a filter, a projection and a distributed top-k."""
    rows = vectors if where is None else vectors.where(where)
    d = F.round(squared_distance(F.col(vector), query), 6)
    return rows.withColumn("distance", d).drop(vector).orderBy("distance", row_id).limit(n)


def not_true(column: str) -> Column:
    """``!= true`` that keeps rows without the field."""
    return ~F.coalesce(F.col(column), F.lit(False))


def merged(parts: Sequence[DataFrame], n: int, row_id: str) -> DataFrame:
    """Nearest rows of several collections; a missing distance comes last."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.orderBy(F.asc_nulls_last("distance"), row_id).limit(n)


def grep(rows: DataFrame, needle: str, row_id: Sequence[str], text: str, around: int, limit: int | None = None) -> DataFrame:
    """All occurrences of a normalised needle in normalised text, overlapping ones too: its ``offset`` there, and the ``context``
    in the raw text. Both ends of an occurrence are scaled by the ratio of lengths; ``around`` characters before and
    after them belong to the context, white space at its ends doesn't. Sorted only where there is a limit."""
    low = rows.where(F.col(text).isNotNull()).withColumn("__norm", tx.normalize(F.col(text)))
    low = low.where(F.col("__norm").contains(needle)).withColumns({"__at": tx.occurrences(F.col("__norm"), needle), "__parts": tx.pieces(F.col(text))})
    ratio = F.length(text) / F.length("__norm")
    scaled = lambda at: F.floor(at * ratio).cast("int")

    def hit(at: Column) -> Column:
        begin = F.greatest(F.lit(0), scaled(at - 1) - around)
        end = F.least(F.length(text), scaled(at - 1 + len(needle)) + around)
        return F.struct((at - 1).alias("offset"), tx.strip(tx.cut(F.col("__parts"), begin, end)).alias("context"))

    out = low.select(*row_id, F.explode(F.transform("__at", hit)).alias("__hit")).select(*row_id, "__hit.offset", "__hit.context")
    return out.orderBy(*row_id, "offset").limit(limit) if limit else out


def find_in_files(files: DataFrame, query: str, around: int = 3, limit: int | None = None) -> DataFrame:
    """``file, hit, line_start, line_end, context``: every occurrence of a pasted text in TeX sources ``files(file, text)``, one
    row each, those that overlap too. Markup and line breaks don't count: a whole file is one normalised text.

    A place in it is scaled to the raw file by the ratio of lengths, and becomes a line by an as-of join with the running
    lengths of the file's lines. ``context`` has the lines of the hit and ``around`` on either side, joined by line number.
    A file is one row; null texts and an empty query have no hits."""
    needle = tx.normal_form(query)
    rounds = Rounds(files.sparkSession, "files")
    own = files.where(F.col("text").isNotNull()).select("file", "text", tx.normalize_markup(F.col("text")).alias("norm"))
    own = rounds.put(own.where(F.contains("norm", F.lit(needle)) if needle else F.lit(False)))
    # lengths are taken once for each file: a text's length is counted anew wherever it is named
    found = own.select("file", F.length("text").alias("size"), F.length("norm").alias("plain"), tx.occurrences(F.col("norm"), needle or " ").alias("at"))
    place = lambda at: F.floor(at * (F.col("size") / F.col("plain"))).cast("int")
    hits = found.select("file", "size", "plain", F.posexplode("at").alias("hit", "at"))
    hits = rounds.put(hits.select("file", "hit", place(F.col("at") - 1).alias("begin"), F.least(place(F.col("at") - 1 + len(needle)), F.col("size") - 1).alias("end")))
    pieces = F.split("text", "\n")
    ends = tx.running(F.transform(pieces, lambda x: F.length(x) + 1))
    lines = own.select("file", F.posexplode(F.arrays_zip(pieces.alias("text"), ends.alias("upto"))).alias("line", "x"))
    lines = rounds.put(lines.select("file", (F.col("line") + 1).alias("line"), "x.text", (F.col("x.upto") - F.length("x.text") - 1).alias("at")))
    first = asof(hits.withColumnRenamed("begin", "at"), lines, ["file"], "at", ["line"]).select("file", "hit", F.col("line").alias("line_start"), F.col("end").alias("at"))
    both = asof(first, lines, ["file"], "at", ["line"]).select("file", "hit", "line_start", F.col("line").alias("line_end"))
    near = both.withColumn("line", F.explode(F.sequence(F.greatest(F.lit(1), F.col("line_start") - around), F.col("line_end") + around)))
    near = near.join(lines.select("file", "line", "text"), ["file", "line"])
    context = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    out = near.groupBy("file", "hit", "line_start", "line_end").agg(tx.strip(context).alias("context"))
    return out.orderBy("file", "hit").limit(limit) if limit else out


def verify_quotes(quotes: DataFrame, documents: DataFrame, quote_id: str, quote: str, row_id: str, text: str, words: int = 8) -> DataFrame:
    """``quote_id, row_id`` of all pairs of a quote and a document that holds it verbatim, also from within a word on.

    A quote's first and last word may be parts of longer ones in the document; what stands between them are whole words.
    Both sides meet on the hash of the first ``words`` of these (ids and hashes only, the texts are joined back to the
    pairs that meet). Quotes without a whole word inside are looked for in every document; they are a bounded literal list
    only in so far as the quotes are, so they go through one filter for each block of them."""
    split = lambda c: F.split(c, r"\s+")
    own = quotes.where(F.col(quote).isNotNull()).select(F.col(quote_id).alias("__q"), F.col(quote).alias("__t"))
    own = own.withColumn("__inner", F.slice(split(F.col("__t")), 2, F.greatest(F.lit(0), F.size(split(F.col("__t"))) - 2)))
    own = own.withColumn("__n", F.least(F.lit(words), F.size("__inner")))
    key = lambda w, i, n: F.xxhash64(F.array_join(F.slice(w, i, n), " "))
    keyed = own.where("__n > 0").withColumn("__k", key("__inner", 1, F.col("__n")))
    sizes = [r[0] for r in keyed.select("__n").distinct().collect()]  # ``words`` values at most
    d = documents.select(F.col(row_id).alias("__d"), split(F.col(text)).alias("__w"))
    starts = lambda n: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("__w") - n + 1))
    runs = lambda n: F.transform(starts(n), lambda i: key("__w", i, n))
    met = None
    if sizes:  # all lengths in one pass over the texts
        met = d.select("__d", F.explode(F.array_distinct(F.concat(*map(runs, sizes)))).alias("__k")).join(keyed.select("__q", "__k"), "__k").select("__q", "__d")
    out = own.select(F.col("__q").alias(quote_id), F.lit(None).cast(documents.schema[row_id].dataType).alias(row_id)).where("false")
    if met is not None:
        texts = documents.select(F.col(row_id).alias("__d"), F.col(text).alias("__x"))
        both = met.distinct().join(own.select("__q", "__t"), "__q").join(texts, "__d").where(F.contains("__x", F.col("__t")))
        out = out.unionAll(both.select("__q", "__d"))
    short = own.where("__n = 0").select("__q", "__t")
    held: list = []

    def add(out: DataFrame, held: list) -> DataFrame:
        found = F.filter(F.array(*(F.struct(F.lit(q).alias("q"), F.lit(t).alias("t")) for q, t in held)), lambda x: F.contains(F.col(text), x["t"]))
        return out.unionAll(documents.select(F.explode(found).alias("x"), F.col(row_id).alias("__d")).select("x.q", "__d"))

    for r in short.toLocalIterator():
        held.append(r)
        if len(held) == 256:
            out, held = add(out, held), []
    return add(out, held) if held else out


@F.pandas_udf(T.DoubleType())
def token_proximity(query: pd.Series, text: pd.Series) -> pd.Series:
    """Share of query tokens found (repeats count below), less the wider the least window that holds all found."""
    import math

    def one(q: str | None, t: str | None) -> float:
        tokens, words = (q or "").lower().split(), (t or "").lower().split()
        wanted = set(tokens)
        places = [(i, w) for i, w in enumerate(words) if w in wanted]
        found = {w for _, w in places}
        if not tokens or not found:
            return 0.0
        coverage = len(found) / len(tokens)
        if len(found) == 1:
            return coverage * 0.3
        last: dict[str, int] = {}
        best = len(words)
        for i, w in places:
            last[w] = i
            if len(last) == len(found):
                best = min(best, i - min(last.values()) + 1)
        return coverage * min(1.0, math.log(len(found) + 1) / math.log(best + 1))

    return pd.Series([one(q, t) for q, t in zip(query, text, strict=True)])


def proximity(query: str, text: Column) -> Column:
    """``token_proximity`` for a fixed query, in the JVM: the hits of the query's words are folded once, with the last place of
    each word as state."""
    tokens = query.lower().split()
    wanted = list(dict.fromkeys(tokens))
    if not tokens:
        return F.lit(0.0)
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    place = lambda w, i: F.struct(i.alias("i"), F.array_position(F.array(*map(F.lit, wanted)), w).cast("int").alias("k"))
    whole = F.transform(F.array(words), lambda ws: F.struct(F.size(ws).alias("n"), F.filter(F.transform(ws, place), lambda x: x["k"] > 0).alias("h")))

    def score(s: Column) -> Column:
        found = F.size(F.array_distinct(F.transform(s["h"], lambda x: x["k"])))
        start = F.struct(F.array_repeat(F.lit(-1), len(wanted)).alias("last"), s["n"].alias("best"), found.alias("found"))

        def step(acc: Column, x: Column) -> Column:
            last = F.transform(acc["last"], lambda p, j: F.when(j + 1 == x["k"], x["i"]).otherwise(p))
            seen = F.filter(last, lambda p: p >= 0)
            best = F.when(F.size(seen) == acc["found"], F.least(acc["best"], x["i"] - F.array_min(seen) + 1)).otherwise(acc["best"])
            return F.struct(last.alias("last"), best.alias("best"), acc["found"].alias("found"))

        end = F.aggregate(s["h"], start, step, lambda acc: F.struct(acc["best"].alias("best"), acc["found"].alias("found")))
        return F.transform(F.array(end), lambda e: F.when(e["found"] == 0, 0.0).when(e["found"] == 1, F.lit(0.3 / len(tokens))).otherwise(e["found"] / len(tokens) * F.least(F.lit(1.0), F.log(e["found"] + 1.0) / F.log(e["best"] + 1.0))))[0]

    return F.transform(whole, score)[0]


def paragraph_matches(pages: DataFrame, key: str, number: str, text: str, query: str, paragraphs: int = 1, n: int = 5, least: float = 0.3) -> DataFrame:
    """``key, rank, page, score, pages, texts``: the ``n`` best paragraphs of each document with what stands around them.

    A paragraph holds the normalised query (score 1), or, in documents where none does, enough of its words close by. Around
    it stand its neighbours in the order of the document, across pages (``paragraphs`` in all, an even number less one):
    ``pages`` lists theirs in order and ``texts`` what they say on each. Equal scores come in the order of the document."""
    needle, reach = tx.normal_form(query), (max(1, paragraphs) - 1) // 2
    paras = pages.where(F.col(text).isNotNull()).select(key, F.col(number).alias("__page"), F.explode(tx.paragraphs(F.col(text))).alias("__x"))
    clean = F.struct(F.col("__page").alias("page"), tx.clean_for_quote(F.col("__x.para")).alias("text"))
    w = Window.partitionBy(key).orderBy("__page", "__x.idx")
    norm = tx.normalize(F.col("__x.para"))
    own = paras.select(key, "__page", "__x.idx", norm.alias("__norm"), F.collect_list(clean).over(w.rowsBetween(-reach, reach)).alias("__near"))
    own = own.withColumn("__exact", F.contains("__norm", F.lit(needle)) if needle else F.lit(False))
    held = own.where("__exact").select(key).distinct()
    found = own.where("__exact").withColumn("score", F.lit(1.0))
    close = own.where("NOT __exact").join(held, key, "left_anti").withColumn("score", proximity(needle, F.col("__norm"))).where(F.col("score") >= least)
    best = Window.partitionBy(key).orderBy(F.desc("score"), "__page", "idx")
    top = found.unionByName(close.select(*found.columns)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    at = F.array_distinct(F.transform("__near", lambda x: x["page"]))
    says = F.transform(at, lambda p: F.array_join(F.transform(F.filter("__near", lambda x: x["page"] == p), lambda x: x["text"]), "\n\n"))
    return top.select(key, "rank", F.col("__page").alias("page"), F.round("score", 3).alias("score"), at.alias("pages"), says.alias("texts"))


def _indel(a: str, b: str) -> float:
    """2 * longest common subsequence / total length, by bit-parallel rows."""
    if not a or not b:
        return float(a == b)
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        m = row & place.get(c, 0)
        row = ((row + m) | (row - m)) & full
    lcs = len(a) - row.bit_count()
    return 2 * lcs / (len(a) + len(b))


def subsequence_lengths(a: Sequence[str], b: Sequence[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of ``a[i]`` and ``b[j]``: ``_indel``'s rows for many pairs at once. Letters have
    places of their own, so lengths are exact."""
    out = np.zeros(len(i), int)
    points = lambda texts: np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    left, right = (np.array([len(x) for x in texts], int) for texts in (a, b))
    codes, other = points(a), points(b)
    if not len(i) or not len(codes):
        return out
    place_of = np.zeros(int(codes.max()) + 2, int)
    place_of[codes] = 1
    n = int(place_of.sum()) + 1  # one more, which stands nowhere
    place_of = np.where(place_of > 0, np.cumsum(place_of) - 1, n - 1)
    codes, other = place_of[codes], place_of[np.minimum(other, len(place_of) - 1)]
    begin, start = np.cumsum(left) - left, np.cumsum(right) - right
    words = -(-left // 64)
    order = np.lexsort((i, words[i]))
    order = order[words[i[order]] > 0]
    while len(order):
        k = words[i[order[0]]]
        same = order[:8192]
        same = same[words[i[same]] == k]
        new = np.concatenate([[0], np.cumsum(np.diff(i[same]) != 0)])  # the pair's string in this part
        same = same[new < max(1, (1 << 21) // (n * k))]
        new, order = new[: len(same)], order[len(same) :]
        own = i[same][np.concatenate([[True], np.diff(new) != 0])]
        place = np.arange(left[own].sum()) - np.repeat(np.cumsum(left[own]) - left[own], left[own])
        row = np.repeat(np.arange(len(own)), left[own])
        code = codes[np.repeat(begin[own], left[own]) + place]
        held = np.zeros(k * len(own) * n, np.uint64)
        np.add.at(held, ((place >> 6) * len(own) + row) * n + code, np.uint64(1) << (place & 63).astype(np.uint64))
        held = held.reshape(k, -1)
        long = np.argsort(-right[j[same]], kind="stable")
        same, base, size = same[long], new[long] * n, right[j[same]][long]
        first, rows = start[j[same]], [np.full(len(same), ~np.uint64(0)) for _ in range(k)]
        going = len(same) - np.searchsorted(size[::-1], np.arange(size[0]), "right")
        for t, m in enumerate(going.tolist()):
            index, over = base[:m] + other[first[:m] + t], None
            for w in range(k):
                x = rows[w][:m]
                y = x & held[w][index]
                total = x + y
                if k > 1:
                    carry = total < y
                    if over is not None:
                        total += over
                        carry |= total < over
                    over = carry
                x ^= y
                x |= total
        out[same] = 64 * k - np.sum([np.bitwise_count(x) for x in rows], 0, int)
    return out


def token_set_ratio(a: str, b: str) -> float:
    """The best of three indel ratios between the common words and each side's words, sorted."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 1.0
    # what both begin with is part of a longest common subsequence, and the common words alone are all of their own
    head = len(both) + 1 if both else 0
    la, lb = head + len(left), head + len(right)
    return max((2 * head + _indel(left, right) * (len(left) + len(right))) / (la + lb), *((2 * len(both) / (len(both) + n) for n in (la, lb)) if both else (0.0, 0.0)))


class Ratios:
    """Token-set ratios of many pairs: pairs are added one by one and scored together."""

    def __init__(self):
        self.sides: tuple[dict[str, int], dict[str, int]] = {}, {}
        self.a, self.b, self.head = [], [], []

    def words(self, text: str, side: int) -> tuple[set[str], int]:
        """What ``add`` takes: a text's words, and the number here of these sorted."""
        words, known = set(text.split()), self.sides[side]
        return words, known.setdefault(" ".join(sorted(words)), len(known))

    def add(self, a: tuple[set[str], int], b: tuple[set[str], int]) -> None:
        x, y = a[0], b[0]
        left, right, head = a[1], b[1], 0
        if not x.isdisjoint(y):
            both = x & y
            if len(both) == len(x) or len(both) == len(y):
                head = -1
            else:
                own, known = self.sides
                left = own.setdefault(" ".join(sorted(x - both)), len(own))
                right = known.setdefault(" ".join(sorted(y - both)), len(known))
                head = sum(map(len, both)) + len(both)
        self.a.append(left)
        self.b.append(right)
        self.head.append(head)

    def take(self) -> list[float]:
        """The ratios in the order of ``add``; sides and pairs are forgotten. The same arithmetic as ``token_set_ratio``."""
        a, b = (list(x) for x in self.sides)
        left, right = (np.array([len(x) for x in texts], int) for texts in (a, b))
        i, j, head = np.array(self.a, int), np.array(self.b, int), np.array(self.head, int)
        out = np.where(head < 0, 1.0, 0.0)
        some = np.nonzero((head > 0) | (head == 0) & (left[i] > 0) & (right[j] > 0))[0] if len(i) else i
        i, j, head = i[some], j[some], head[some]
        left, right = left[i], right[j]
        ratio = 2 * subsequence_lengths(a, b, i, j) / (left + right)
        la, lb = head + left, head + right
        best = (2 * head + ratio * (left + right)) / (la + lb)
        both = np.maximum(head - 1, 0)
        for n in (la, lb):
            best = np.maximum(best, 2 * both / (both + n))
        out[some] = best
        self.sides, self.a, self.b, self.head = ({}, {}), [], [], []
        return out.tolist()


def _word_sets(texts: Iterable[str | None]) -> list[str]:
    """Each text's distinct words, sorted: all that its token-set ratio depends on."""
    return [" ".join(sorted(set((t or "").split()))) for t in texts]


def bags(sets: Sequence[str], classes: int = 32, pair: bool = False) -> np.ndarray:
    """Counts of characters, or of neighbouring two, in classes; classes of several characters only loosen the bound."""
    points = np.frombuffer("".join(sets).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    if pair:
        points, row = (points[:-1] * 31 + points[1:])[same := row[:-1] == row[1:]], row[:-1][same]
    return np.bincount(row * classes + points % classes, minlength=classes * len(sets)).reshape(len(sets), classes).astype(np.int32)


class Known:
    """Word sets that others are held against: which words are in which set, their characters, and where each stands.

    Characters are taken in classes; several in one class only loosen bounds."""

    CLASSES = 128

    def __init__(self, sets: Sequence[str]):
        self.sets, self.size, self.bag = sets, np.array([len(x) for x in sets], int), bags(sets)
        holders: dict[str, list[int]] = {}
        for j, x in enumerate(sets):
            for w in x.split():
                holders.setdefault(w, []).append(j)
        self.place = {w: k for k, w in enumerate(holders)}
        self.length = np.array([len(w) + 1 for w in holders], int)
        self.first = np.concatenate([[0], np.cumsum([len(h) for h in holders.values()], dtype=int)]).astype(int)
        self.holders = np.array([j for h in holders.values() for j in h], int)
        begin = [dict(zip(ws := x.split(), np.cumsum([0, *(len(w) + 1 for w in ws)]).tolist(), strict=False)) for x in sets]
        self.begin = np.array([begin[j][w] for w, h in holders.items() for j in h], int)
        # one class more, in which nothing stands
        self.places = [np.zeros(len(sets) * (self.CLASSES + 1), np.uint64) for _ in range(-(-self.size.max(initial=0) // 64))]
        for j, x in enumerate(sets):
            for k, c in enumerate(x):
                self.places[k >> 6][j * (self.CLASSES + 1) + ord(c) % self.CLASSES] |= np.uint64(1 << (k & 63))

    def words(self, part: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of ``part`` that any set has, and their rows."""
        own = [[k for w in x.split() if (k := self.place.get(w)) is not None] for x in part]
        return np.array([k for x in own for k in x], int), np.repeat(np.arange(len(part)), [len(x) for x in own])

    def held(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """In how many sets each word is, and the places of these in ``holders``."""
        n = self.first[words + 1] - self.first[words]
        return n, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[words], n)

    def covered(self, part: Sequence[str], size: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of which common words alone can give ``least``: they cover a share of the shorter side."""
        words, row = self.words(part)
        share = (least - 1e-5) / (2 - least + 1e-5)
        # most rows have too few words that any of the sets has
        enough = np.bincount(row, self.length[words], len(part)) - 1 >= share * np.minimum(size, self.size.min())
        words, row = words[enough[row]], row[enough[row]]
        n, at = self.held(words)
        pair, inverse = np.unique(np.repeat(row, n) * len(self.sets) + self.holders[at], return_inverse=True)
        both = np.bincount(inverse, np.repeat(self.length[words], n), len(pair)) - 1
        i, j = np.divmod(pair, len(self.sets))
        ok = 2 * both / np.maximum(both + np.minimum(size[i], self.size[j]), 1) >= least - 1e-5
        return i[ok], j[ok]

    def sequences(self, part: Sequence[str], i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Which pairs can have a common subsequence of ``need`` characters (classes) when the words that both have come
        first: these count whole and are taken out of the known side. ``_indel``'s rows, for many pairs at once. A pair is
        given up when the characters that are left can't make up for those that were lost."""
        if not len(i):
            return np.zeros(0, bool)
        position = np.full(len(part) * len(self.sets), -1)
        position[i * len(self.sets) + j] = np.arange(len(i))
        shared, row = self.words(part)
        some = np.isin(row, i)
        shared, row = shared[some], row[some]
        n, entry = self.held(shared)
        pos = position[np.repeat(row, n) * len(self.sets) + self.holders[entry]]
        some = pos >= 0
        pos, entry, length = pos[some], entry[some], np.repeat(self.length[shared], n)[some]
        need = need - np.bincount(pos, length, len(i))
        # bits of words of up to 64 characters; longer ones stay in, which only loosens the bound
        brief = length <= 64
        pos, begin, length = pos[brief], self.begin[entry[brief]], length[brief].astype(np.uint64)
        shift = (begin & 63).astype(np.uint64)
        bits = ~np.uint64(0) >> (np.uint64(64) - length)
        over_ = np.where(shift > 0, bits >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        keep = np.full((len(self.places) + 1, len(i)), ~np.uint64(0))
        np.bitwise_and.at(keep, (begin >> 6, pos), ~(bits << shift))
        np.bitwise_and.at(keep, ((begin >> 6) + 1, pos), ~over_)
        size = np.array([len(x) for x in part], int)
        wide = -(-size // 8) * 8  # eight steps at a time, filled up with the class in which nothing stands
        start, out = np.cumsum(wide) - wide, np.zeros(len(i), bool)
        points = np.full(wide.sum(), self.CLASSES)
        inside = np.arange(len(points)) - np.repeat(start, wide) < np.repeat(size, wide)
        points[inside] = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32) % self.CLASSES
        words = -(-self.size[j] // 64)
        order = np.lexsort((j, words))
        low = 0
        while low < len(order):
            same = order[low : low + 8192]
            same = same[words[same] == words[same[0]]]
            low, k = low + len(same), words[same[0]]
            rows = [np.full(len(same), ~np.uint64(0)) for _ in range(k)]
            own = [keep[w, same] for w in range(k)]
            base, at, left, goal = j[same] * (self.CLASSES + 1), start[i[same]], size[i[same]], need[same]
            while len(same):
                for t in range(8):
                    index, over = base + points[at + t], None
                    for w in range(k):
                        row = rows[w]
                        m = row & self.places[w][index] & own[w]
                        total = row + m
                        if w + 1 < k:
                            last, over = over, total < m
                        else:
                            last = over
                        if last is not None:
                            total += last
                            if w + 1 < k:
                                over |= total < last
                        rows[w] = total | (row ^ m)
                at, left = at + 8, np.maximum(left - 8, 0)
                found = 64 * k - np.sum([np.bitwise_count(x) for x in rows], 0, int)
                out[same[found >= goal]] = True
                go = np.nonzero((found < goal) & (found + left >= goal) & (left > 0))[0]
                if len(go) < len(same):
                    same, base, at, left, goal = same[go], base[go], at[go], left[go], goal[go]
                    rows, own = [x[go] for x in rows], [x[go] for x in own]
        return out


def similar(a: Sequence[str], known: Known, least: float) -> Iterator[tuple[int, int, float]]:
    """(i, j, ratio) of all pairs of word sets with a token-set ratio of ``least`` and more. Scored are only pairs for which
    one of the three ratios can reach it: by the length of the common words, or by a common subsequence, looked for only
    where lengths and the characters in common leave room for it."""
    if not len(known.place):
        return
    step = 16384
    for low in range(0, len(a), step):
        part = a[low : low + step]
        size = np.array([len(x) for x in part], int)
        i, j = known.covered(part, size, least)
        subset = i * len(known.sets) + j
        need = (least - 1e-5) * (size[:, None] + known.size) / 2
        i, j = np.nonzero(np.minimum(size[:, None], known.size) >= np.maximum(need, 1))
        bag, near = bags(part), []
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            goal = need[x, y]
            ok = np.minimum(bag[x], known.bag[y]).sum(1) >= goal
            x, y, goal = x[ok], y[ok], goal[ok]
            ok = known.sequences(part, x, y, goal)
            near.append(x[ok] * len(known.sets) + y[ok])
        for pair in np.unique(np.concatenate([subset, *near])).tolist():
            i, j = divmod(pair, len(known.sets))
            ratio = round(token_set_ratio(part[i], known.sets[j]), 6)
            if ratio >= least:
                yield low + i, j, ratio


def score_quotes(quotes: DataFrame, documents: DataFrame, quote_id: str, quote: str, row_id: str, text: str, least: float, block: int = 512) -> DataFrame:
    """``quote_id, row_id, ratio``: the best token-set ratio of each whole quote among all sentences of each document, where
    it reaches ``least``. Quotes are a stated query set and go to the executors in blocks; each block meets all rows."""
    # texts are small in bytes for the work on them, so they are dealt: a file of one row group would be one task
    spark = documents.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    sentences = documents.select(row_id, text).repartition(n).select(row_id, F.explode(tx.sentences(F.col(text))).alias("s"))
    types = [f"`{c}` {df.schema[c].dataType.simpleString()}" for df, c in ((quotes, quote_id), (documents, row_id))]
    out, held = None, []

    def add(held: list) -> DataFrame:
        keys, sets = [r[0] for r in held], _word_sets(r[1] for r in held)

        def score(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = Known(sets)
            for pdf in it:
                best: dict[tuple, float] = {}
                rows = pdf[row_id].tolist()
                for i, j, ratio in similar(_word_sets(pdf["s"]), known, least):
                    pair = keys[j], rows[i]
                    best[pair] = max(best.get(pair, 0.0), ratio)
                yield pd.DataFrame([(*k, v) for k, v in best.items()], columns=[quote_id, row_id, "ratio"])

        part = sentences.mapInPandas(score, ", ".join([*types, "ratio double"]))
        return part if out is None else out.unionAll(part)

    for r in quotes.where(F.col(quote).isNotNull()).select(quote_id, quote).toLocalIterator():
        held.append(r)
        if len(held) == block:
            out, held = add(held), []
    if held or out is None:
        out = add(held)
    return out.groupBy(quote_id, row_id).agg(F.max("ratio").alias("ratio"))


def pack_chunks(sentences: list[str], size: int = 500, overlap: int = 100) -> list[str]:
    """Greedy packing of sentences into chunks: a sentence is added while the chunk and it, the space between them not
    counted, have at most ``size`` characters; a longer one that begins a chunk is one by itself. A chunk begins with the
    last sentences of the one before that fit in ``overlap``, spaces counted; a last chunk that repeats the one before it
    is left out."""
    out: list[str] = []
    held: list[str] = []
    for s in sentences:
        if held and len(" ".join(held)) + len(s) > size:
            out.append(" ".join(held))
            keep = 0
            while keep < len(held) and len(" ".join(held[len(held) - keep - 1 :])) <= overlap:
                keep += 1
            held = held[len(held) - keep :]
        elif not held and len(s) > size:
            out.append(s)
            continue
        held.append(s)
    last = " ".join(held)
    if last and (not out or out[-1] != last):
        out.append(last)
    return out


def chunks(rows: DataFrame, row_id: str, text: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """``row_id, chunk_index, text`` of all rows: sentences by built-in functions, packing on Arrow batches."""
    own = rows.select(row_id, tx.sentences(F.coalesce(F.col(text), F.lit(""))).alias("s"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = [(k, i, c) for k, s in zip(pdf[row_id], pdf["s"], strict=True) for i, c in enumerate(pack_chunks(list(s), size, overlap))]
            yield pd.DataFrame(out, columns=[row_id, "chunk_index", "text"])

    return own.mapInPandas(run, f"{row_id} {rows.schema[row_id].dataType.simpleString()}, chunk_index int, text string")


def corpus_search(files: DataFrame, query: str, globs: Sequence[str], around: int = 3, limit: int | None = None) -> DataFrame:
    """``find_in_files`` over the files that the globs (``*``, ``?``) name. No file that they name raises ``LookupError``."""
    import re

    named = None
    for g in globs:
        test = F.regexp_like("file", F.lit("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g) + r"\z"))
        named = test if named is None else named | test
    own = files if named is None else files.where(named)
    if own.limit(1).isEmpty():
        raise LookupError(f"no file matches {list(globs)}")
    return find_in_files(own, query, around, limit)
