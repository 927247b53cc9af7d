"""The pipeline's stages against plain re-computation, each on its own input; odd rows pass through all of them."""

import collections
import hashlib
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline as pipe  # noqa: E402
from parchmint.llm import mixing, quality  # noqa: E402
from parchmint.llm._scratch import stage  # noqa: E402

from test_operators import brute_components, fill, tokens  # noqa: E402, I001


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "src1", 0), (None, "no id here and some words more", "en", "src1", 5), (90003, "short", "xx", "elsewhere", 5), (90003, "short", "xx", "elsewhere", 5), (90004, "plain words of a long text " * 6000, "en", "src2", 162000), (90005, "z" * 150000, "en", "src2", 150000), (None, "no id here and some words more", "de", "src1", 5)], docs.schema)
    out = [stage(docs.unionByName(odd), "t")]
    for name, f in pipe.STAGES:
        out.append(stage(f(spark, out[-1], sf), name))
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in pipe.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert steps[-1].columns == [*steps[0].columns, "shard", "slot"]


def test_quality_keeps_what_it_scores_clean(spark, sf, steps):
    model = quality.fit(steps[0], spark.read.parquet(f"{sf}/labels.parquet"))
    want = sorted(str((r.doc_id, r.text)) for r in quality.score(steps[0], model).collect() if r.quality_score >= 0.5)
    assert sorted(str((r.doc_id, r.text)) for r in steps[1].collect()) == want
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in steps[1].collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) >= 0.98 * len(good)


def test_one_of_each_near_duplicate_stays(steps):
    rows = steps[1].collect()
    want = {c for i, _, c in brute_components([(r.doc_id, r.text) for r in rows]) if i is not None}
    ids = [r.doc_id for r in steps[2].collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want)


def test_leaks_go_and_others_stay(spark, sf, steps):
    items = [tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = lambda t: any(" " + " ".join(w) + " " in " " + " ".join(tokens(t)) + " " for w in items)
    before, after = ({(r.doc_id, r.text) for r in s.collect()} for s in steps[2:4])
    assert after <= before and not any(holds(t) for _, t in after)
    assert all(holds(t) for _, t in before - after)


def test_mix_takes_what_the_budgets_allow(steps):
    rows = steps[3].selectExpr("doc_id", f"{mixing.DOMAIN_SQL} AS d", "coalesce(lang, '') AS l", "coalesce(source, '') AS s", "text").collect()
    leaf = collections.defaultdict(list)
    for r in rows:
        leaf[r.d, r.l, r.s].append((r.doc_id, len(tokens(r.text))))
    cap = {k: sum(n for _, n in v) for k, v in leaf.items()}
    w, up = mixing.WEIGHTS, lambda p: sum(c for k, c in cap.items() if k[: len(p)] == p)
    want = collections.Counter()
    for d, b in fill(sum(cap.values()) * 4 // 5, [((d,), w.get((d,), 1), up((d,))) for d in {k[0] for k in cap}]).items():
        for p, b2 in fill(b, [(p, w.get(p, 1), up(p)) for p in {k[:2] for k in cap if k[:1] == d}]).items():
            for k, b3 in fill(b2, [(k, 1, c) for k, c in cap.items() if k[:2] == p]).items():
                full, rest, at = (b3 // cap[k], b3 % cap[k], 0) if cap[k] else (0, 0, 0)
                key = lambda x: hashlib.md5(":".join(str(y) for y in (17, full, x[0]) if y is not None).encode()).hexdigest()  # noqa: B023, E731
                for x in leaf[k]:
                    want[x[0]] += full
                for x in sorted(leaf[k], key=key) if rest else []:
                    at += x[1]
                    if at > rest:
                        break
                    want[x[0]] += 1
    assert collections.Counter(r.doc_id for r in steps[4].collect()) == +want


def test_shards_hold_all_rows_level(steps):
    rows = steps[5].collect()
    assert sorted(str((r.doc_id, r.text)) for r in rows) == sorted(str((r.doc_id, r.text)) for r in steps[4].collect())
    size = collections.Counter(r.shard for r in rows)
    assert max(size.values()) - min(size.get(k, 0) for k in range(pipe.SHARDS)) <= 1
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
