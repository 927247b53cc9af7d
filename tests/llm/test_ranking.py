"""Ranked search against plain scoring of all documents for all items."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from parchmint.llm import ranking

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, k=20):
    """(item_id, rank, score) and the document ids that may stand there."""
    bags = [(d, collections.Counter(terms(t))) for d, t in docs]
    bags = [(d, b, b.total()) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for *_, n in bags)
    df = collections.Counter(t for _, b, _ in bags for t in b)
    out = []
    for i, text in items:
        asked, found = collections.Counter(terms(text)), []
        for d, bag, n in bags:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t, q in asked.items() if t in bag)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def made_up(n, seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Über", "日本", "naïve", "x9"]
    text = lambda most: " ".join(r.choice(words[: r.choice([4, 12, 64])]) + r.choice(["", ",", "."]) for _ in range(r.randrange(1, most)))
    docs = [(i, text(80)) for i in range(n)]
    docs += [(n + i, docs[5][1]) for i in range(30)] + [docs[7], docs[7], (None, docs[8][1]), (n + 40, None), (n + 41, ""), (n + 42, " .,;\n"), (n + 43, "w1 w2 " * 40000)]
    items = [(i, text(30)) for i in range(12)] + [(20, docs[5][1]), (21, None), (22, "!!"), (23, "nowhere"), (24, "W1 w1 w1"), (25, docs[8][1]), (25, docs[8][1])]
    return docs, items


@pytest.mark.parametrize(("n", "k"), [(150, 20), (10, 20), (150, 3)])
def test_made_up(spark, n, k):
    docs, items = made_up(n)
    wide = {c: F.lit("w1") for c in ("row", "id", "n", "t", "f", "item", "rank", "score")}
    d = spark.createDataFrame(docs, DOCS).repartition(5).withColumns(wide)
    i = spark.createDataFrame(items, ITEMS).withColumns(wide)
    got = ranking.Index(d, i, k=k).ranked()
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, items, k)


def test_thresholds_are_safe(spark):
    docs, items = made_up(150)
    index = ranking.Index(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    ids = {r.row: r.id for r in index.items.collect()}
    kth = {i: s for i, rank, _, s in plain(docs, items) if rank == 20}
    found = {ids[r.item]: r.least for r in index.thresholds().collect()}
    assert all(least <= kth[i] for i, least in found.items() if i in kth) and sum(v > 0 for v in found.values()) > 5
    needed = collections.Counter(r.item for r in index.needed().collect())
    asked = collections.Counter(r.item for r in index.asked().collect())
    assert any(needed[i] < asked[i] for i in asked)


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    assert ranking.Index(d.limit(0), i).ranked().count() == 0
    assert ranking.Index(d, i.limit(0)).ranked().count() == 0
