"""The registered queries over whole shipped tables against plain re-computation, and SQL where there is any."""

import collections
import hashlib
import math
import re
import zlib

import duckdb
import pytest

from parchmint.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def run(spark, sf, name):
    return QUERIES[name](spark, sf).collect()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.sql(ORACLES[name])
    got = QUERIES[name](spark, sf)
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == sorted(want.select(", ".join(names)).fetchall(), key=str)


def test_op1(spark, sf, docs):
    rows = run(spark, sf, "op1_ring_shards")
    by = collections.defaultdict(list)
    for r in rows:
        text = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "rows", None)
        by[r.shard].append(r.slot)
    assert len(rows) == len(docs) and set(by) == set(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and {len(s) for s in by.values()} <= {len(docs) // 24, len(docs) // 24 + 1}


def test_op3(spark, sf, docs):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in run(spark, sf, "op3_decontaminate")}
    plain = lambda t: " " + " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", t.lower())) + " "
    want = {(d, i) for d, r in docs.items() for i, t in bench.items() if plain(t) in plain(r.text)}
    assert want <= got
    for d, i in got - want:  # what isn't verbatim shares much of the item's words
        assert len(set(plain(bench[i]).split()) & set(plain(docs[d].text).split())) > 0.4 * len(set(plain(bench[i]).split()))


def test_op4(spark, sf, docs):
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    tokens = {d: [*words(r.text), None] for d, r in docs.items()}
    count = collections.Counter(w for d in docs if not held[d] for w in tokens[d])
    n, v = sum(count.values()), len(count)
    for r in run(spark, sf, "op4_lattice_likelihood"):
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(w in count for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        assert r.lattice_score < r.others_score <= r.score + 1e-9 < 1e-9


def test_op5(spark, sf, docs):
    base = (("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
    for r in run(spark, sf, "op5_secret_scan"):
        spans = sorted((m.start(g), k, m.end(g)) for k, (_, p, g, least) in enumerate(base) for m in p.finditer(docs[r.doc_id].text) if len(m[g]) >= least)
        shown = [f"{base[k][0]}:{s}:{e}" for s, k, e in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert [x for x in r.spans.split(",") if x and not x.startswith("format:")] == shown


def test_op7(spark, sf, docs):
    order = sorted(docs, reverse=True)
    of, shown = {}, {}
    for r in run(spark, sf, "op7_chunk_fingerprints"):
        t, nxt = docs[r.doc_id].text, docs[order[(order.index(r.doc_id) + 1) % len(order)]].text
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert of.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_next <= 1
        shown[r.doc_id] = r.near_edited
    long = [d for d in docs if len(docs[d].text) > 1000]
    assert all(0.3 < shown[d] <= 1 for d in long)


@pytest.mark.parametrize("name", ["op8_quality_cotraining", "op10_toxicity"])
def test_all_rows_are_scored(spark, sf, docs, name):
    rows = run(spark, sf, name)
    score = "score" if name.startswith("op10") else "quality_score"
    assert sorted(r.doc_id for r in rows) == sorted(docs) and all(0 <= r[score] <= 1 for r in rows)
    if name.startswith("op10"):
        assert all(r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
