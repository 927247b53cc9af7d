"""Similarity joins against all pairs."""

import difflib
import random

from pyspark.sql import functions as F

from parchmint.operators import search, simjoin


def near_title(r, t):
    """A title with typos, words left out or added, or all of it in another order."""
    w = t.split()
    for _ in range(r.randrange(3)):
        w[r.randrange(len(w))] += r.choice(["s", "x", ""])
    if r.random() < 0.4:
        w = w[: r.randrange(1, len(w) + 1)]
    if r.random() < 0.4:
        w += r.sample(["rare", "odd", "unique", "seldom", "lone"], 3)
    return " ".join(r.sample(w, len(w)))


def test_titles(spark):
    for least, seed in ((0.9, 7), (0.8, 1)):
        r = random.Random(seed)
        base = [" ".join(r.choice("graph river stone light paper glass wind salt iron moss a of".split()) for _ in range(r.randrange(1, 9))) for _ in range(40)]
        titles = base + [near_title(r, t) for t in base for _ in range(3)] + ["", None, "graph", "graph zeta eta theta iota", "Graph", "graph", "a", "ab", "abc", "abd", "abcd", "abce", "abcdef", "abcdeg", "  of   a "]
        titles += ["internationalisation considerations", "internationalisatiom considerationz"]  # near, and no word in common
        titles += ["".join(r.choice("ab ") for _ in range(r.randrange(1, 14))) for _ in range(60)]
        rows = list(enumerate(titles))
        df = spark.createDataFrame(rows, "k long, t string")
        hits = simjoin.title_hits(df.where("k % 3 = 0"), "k", "t", df, "k", "t", least).collect()
        want = {(i, j): x for i, a in rows if i % 3 == 0 for j, b in rows if a and b and (x := search.token_set_ratio(a, b)) >= least}
        assert {(x.k, x.known_key): x.ratio for x in hits} == want and len(hits) == len(want) > 300


def test_close_keys(spark):
    r = random.Random(4)
    stems = ["xu2022noise", "chen2023graph", "smith2001", "customer#00000", "o'neil1999", "zeta"]
    keys = sorted({s[: r.randrange(3, len(s) + 1)] + "".join(r.choice("0123ab") for _ in range(r.randrange(4))) for s in stems for _ in range(30)} | {"", "a", "é2020", "k" * 250})
    asked = sorted({s[1:] + r.choice(["", "x", "0"]) for s in keys[::4]} | {"xu2022nois", "qqqq", "a", "b", "", "#", "k" * 249 + "z"} - {""})
    got = simjoin.close_keys(spark.createDataFrame([(a,) for a in [*asked, asked[0], None]], "key string"), spark.createDataFrame([(k,) for k in [*keys, keys[3], None]], "key string"))
    found = {}
    for x in got.orderBy("asked", F.desc("ratio"), F.desc("key")).collect():
        found.setdefault(x.asked, []).append(x.key)
    want = {a: difflib.get_close_matches(a, keys, 5, 0.5) for a in asked if a not in keys}
    assert found == {a: k for a, k in want.items() if k}


def test_every_asked_key_is_answered(spark):
    """More keys than were once taken to the driver."""
    stem = lambda k: F.concat(F.lit("author"), F.sha2(k.cast("string"), 256).substr(1, 12))
    keys = spark.range(400).select(F.concat(stem(F.floor(F.col("id") / 5)), (F.col("id") % 5).cast("string")).alias("key"))
    asked = spark.range(10_400).select(F.concat(stem(F.floor(F.col("id") / 130)), F.char(F.lit(97) + F.col("id") % 26), (F.col("id") % 5).cast("string")).alias("key"))
    got = simjoin.close_keys(asked, keys)
    assert got.groupBy("asked").agg(F.count("*").alias("n"), F.count(F.when(F.left("asked", F.lit(18)) == F.left("key", F.lit(18)), 1)).alias("own")).where("n = 5 AND own = 5").count() == 10_400


def narrow(r, n):
    """Titles of few letters: neighbouring two, and any other small pieces, are all common."""
    say = lambda: " ".join("".join(r.choice(["th", "er", "on", "in", "an", "ed"]) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(1, 9)))
    base = [say() for _ in range(n)]
    return base + [near_title(r, t) for t in base for _ in range(2)]


def test_titles_of_few_letters_meet_in_cells(spark, monkeypatch):
    """By their rarest neighbouring two nearly all of them met, row by row."""
    r = random.Random(11)
    sets = sorted({" ".join(sorted(set(t.split()))) for t in narrow(r, 300)})
    asked, known = sets[::2], sets[1::2] + ["o" * 300, "é日本 o"]
    want = {(a, b) for a in asked for b in known if search._indel(a, b) >= 0.9}
    seen, scored = [], simjoin._scored
    monkeypatch.setattr(simjoin, "_scored", lambda pairs, least: seen.extend(pairs) or scored(pairs, least))
    got = {(x, y): z for part in simjoin._Block(known, 0.9).near(asked) for x, y, z in part.itertuples(index=False)}
    assert want <= set(got) and len(want) > 50 and all(z == search.token_set_ratio(x, y) >= 0.9 for (x, y), z in got.items())
    assert len(seen) <= 0.02 * len(asked) * len(known)
    monkeypatch.setattr(simjoin, "BLOCK", 64)
    titles = spark.createDataFrame(list(enumerate(narrow(r, 60))), "k long, t string")
    hits = simjoin.title_hits(titles.where("k % 3 = 0"), "k", "t", titles, "k", "t", 0.8).collect()
    rows = titles.collect()
    assert sorted(map(tuple, hits)) == sorted((a.k, b.k, x) for a in rows if a.k % 3 == 0 for b in rows if (x := search.token_set_ratio(a.t, b.t)) >= 0.8)


def test_copies_never_meet_row_by_row(spark):
    """Of 400,000,000 pairs of copies only the two titles are made; keys that stand several times or are null count as before."""
    r = random.Random(5)
    rows = [(k % 70 if k % 13 else None, t) for k, t in enumerate(narrow(r, 40))] + [(7, "an on"), (7, "an on"), (8, "on an"), (9, None), (500, "alone"), (500, "alone")]
    new, known = rows[::3] + rows[-6:], rows
    table = lambda x: spark.createDataFrame(x, "k long, t string")
    for other in (False, True):
        want = {}
        for n, a in new:
            for k, b in known:
                if n is not None and k is not None and not (other and n == k) and a and b and (x := search.token_set_ratio(a, b)) >= 0.9:
                    want.setdefault(n, []).append((k, x))
        got = {x.k: x for x in simjoin.first_hits(table(new), "k", "t", table(known), "k", "t", other=other).collect()}
        assert {k: (x.known_key, x.hits) for k, x in got.items()} == {n: (min(h)[0], len(h)) for n, h in want.items()}
        assert all((x.known_key, x.ratio) in want[k] for k, x in got.items()) and (500 in got) != other
    many = spark.range(20_000).selectExpr("id AS k", "'the same title' AS t")
    got = simjoin.first_hits(many, "k", "t", many, "k", "t", other=True).groupBy("known_key", "hits").count().collect()
    assert sorted(map(tuple, got)) == [(0, 19_999, 19_999), (1, 19_999, 1)]
