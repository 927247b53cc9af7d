"""Queries on small tables that show what larger ones ran into."""

import datetime as dt
import difflib
import random
import re

import duckdb
from pyspark.sql import functions as F

from parchmint.operators import contents, fuzzy, library, search, simjoin
from parchmint.plans import catalogue


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables given as Spark rows."""
    c = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(folder))
    want = c.execute(catalogue.ORACLES[name]).to_arrow_table().select(got.columns)
    return sorted(map(tuple, got.collect())), sorted(tuple(r.values()) for r in want.to_pylist())


def test_waits_are_rounded_once(spark, tmp_path):
    """A wait of 0.0004996 is none in three digits; rounded to six first it was one."""
    at = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(0, at, 2), (0, at + dt.timedelta(seconds=59.970024), 2), (0, at, 1)], "event_id long, ts timestamp, user_id long")
    got, want = both(spark, tmp_path, "throttled_calls", events=events)
    assert got == want == [("crossref", 1, 0), ("s2", 2, 0)]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_a_document_are_found_once(spark, sf):
    """Not for each candidate that is joined to it."""
    above, _ = plan(catalogue.QUERIES["doi_candidates"](spark, sf)).split("Join", 1)
    assert "regexp_replace" not in above


def test_lengths_are_taken_once_a_file(spark):
    """Not at every hit, which made the search quadratic in a file's hits."""
    files = spark.createDataFrame([("a", "here\nas\n" * 500)], "file string, text string")
    hits = search.find_in_files(files, "here as", 0)
    assert not re.search(r"lambdafunction\([^\n]*length\(text", plan(hits))
    assert sorted((x.hit, x.line_start, x.line_end) for x in hits.collect())[-1] == (499, 999, 1000)


def rendered(entries, floats, meta, depth):
    """A document's table by a walk over all its entries."""
    out = []
    seen = {}  # shown entry: (indent, file in force)
    for e in entries:
        above = seen.get(e["parent"]) if e["parent"] is not None else (-1, "", True)
        if above is None or not e["shown"] or not above[2]:
            continue
        indent, parent_file = above[0] + 1, above[1]
        here = e["file"] or parent_file
        opens = e["depth"] < depth
        seen[e["ord"]] = indent, here, opens
        pad = "  " * indent
        mark = f"Part {e['number']}".strip() if e["level"] == "part" else f"§{e['number']}" if e["number"] else ""
        line = f":{e['line']}" if e["line"] else ""
        place = "" if not e["file"] else (f"  {line}" if line else "") if e["file"] == parent_file else f"  {e['file']}{line}"
        out.append(f"{pad}{mark + ' ' if mark else ''}{e['title']}{'  [' + e['label'] + ']' if e['label'] else ''}{place}{'  p.' + str(e['page']) if e['page'] else ''}")
        if e["file"] and e["file"] != parent_file:
            out += [f"{pad}  # {m['field']}: {m['value']}" for m in meta if m["file"] == e["file"]]
        for kind, name in (("figure", "Fig"), ("table", "Tab")):
            for x in floats:
                if x["parent"] == e["ord"] and x["kind"] == kind:
                    where = f"  {x['file']}:{x['line']}" if x["file"] and x["file"] != here else f"  :{x['line']}" if x["line"] else ""
                    out.append(f"{pad}  {name} {x['number']}: {x['caption']}{where}  p.{x['page']}")
        if not opens:
            what = [f"{e[c]} {n}" for c, n in (("below", "subsections"), ("figures", "figures"), ("tables", "tables")) if e[c]]
            if what:
                out.append(f"{pad}  [{', '.join(what)}]")
    return out


def test_tables_are_rendered_line_by_line(spark):
    """Against a walk over whole documents, which is what the query did, in one Python row a document."""
    r = random.Random(5)
    rows, figs = [], []
    for doc in ("a", "b", "c"):
        for n in range(1, 60):
            d = r.randrange(5)
            rows.append((doc, n, "part" if d == 0 else "section", d, r.choice(["", "1.2", "IV"]), f"T{n}", r.randrange(3), r.choice(["", "x.tex", "y.tex"]), r.randrange(3), r.choice(["", "sec:q"])))
            figs.append((doc, r.randrange(70) or None, r.choice(["figure", "table"]), n, str(n), "Cap", r.randrange(9), r.choice(["", "x.tex", "y.tex"]), r.randrange(3)))
    notes = [("x.tex", "status", "draft"), ("x.tex", "owner", "me"), ("z.tex", "k", "v")]
    e = contents.tree(spark.createDataFrame(rows, "doc string, ord int, level string, depth int, number string, title string, page int, file string, line int, label string"))
    floats = spark.createDataFrame(figs, "doc string, parent int, kind string, ord int, number string, caption string, page int, file string, line int")
    meta = spark.createDataFrame(notes, "file string, field string, value string")
    for fl, shown, me, depth in ((floats, contents.matched(e, file="x.tex"), meta, 3), (None, None, None, 2), (floats, contents.matched(e, "t1", "y", (1, 2)), None, 9)):
        got = contents.render(e, fl, depth, shown, me)
        assert "MapInPandas" not in plan(got)
        below = {(x.doc, x.ord): x for x in contents.descendants(e, fl).collect()}
        seen = None if shown is None else {tuple(x) for x in shown.collect()}
        want = []
        for doc in "abc":
            own = [{**x.asDict(), **below[doc, x.ord].asDict(), "shown": seen is None or (doc, x.ord) in seen} for x in e.where(e.doc == doc).orderBy("ord").collect()]
            f = [x.asDict() for x in fl.where(fl.doc == doc).orderBy("ord").collect()] if fl is not None else []
            m = [dict(zip(("file", "field", "value"), x, strict=True)) for x in sorted(notes)] if me is not None else []
            want += [(doc, i, x) for i, x in enumerate(rendered(own, f, m, depth))]
        assert sorted(map(tuple, got.collect())) == want and len(want) > 3


def test_filters_read_the_entries_once(spark):
    e = contents.tree(spark.createDataFrame([("d", 1, 0, "A", "", 1, "a"), ("d", 2, 1, "urgent", "1", 9, ""), ("d", 3, 1, None, None, 1, "a.tex")], "doc string, ord int, depth int, title string, number string, page int, file string"))
    got = contents.matched(e, "urgent", "a", (0, 1))
    assert len(re.findall("Relation|LocalRelation|LogicalRDD", plan(got))) == 1
    assert [tuple(x) for x in got.collect()] == [("d", 1)]


def test_pairs_are_scored_where_they_meet(spark):
    """Before anything gathers them: they are many times the input."""
    words = spark.createDataFrame([(i, f"word{i} other{i % 3} third") for i in range(9)], "k long, t string")
    hits = simjoin.title_hits(words, "k", "t", words, "k", "t")
    assert re.search(r"MapInPandas[^\n]*\n[^\n]*Union", plan(hits)) and hits.where("k = known_key").count() == 9


def test_scans_hold_no_distinct_pairs(spark, sf):
    """Edges and texts are dealt before they are aggregated, so a task's memory doesn't grow with a file's row groups."""
    for name, least in (("citers_with_metadata", 1), ("references_with_metadata", 1), ("shared_citers", 2), ("inverted_index_reconstruct", 1)):
        assert plan(catalogue.QUERIES[name](spark, sf)).count("RepartitionByExpression") >= least, name


def test_keys_spelt_alike_meet_only_near_ones(spark, monkeypatch):
    """Not most of the keys, by which the pairs grew with the product of both tables."""
    r = random.Random(3)
    names = [f"Customer#{k:09}" for k in range(3000)] + sorted({"".join(r.choice("01") for _ in range(r.randrange(8, 23))) for _ in range(400)})
    asked = [f"Custmer#{k:09}" for k in range(0, 3000, 100)]
    seen, scored = [], simjoin._ratios
    monkeypatch.setattr(simjoin, "_ratios", lambda pairs: seen.append(pairs.count()) or scored(pairs))
    mixed = [x for n in names[3000::8] if (x := n[:3] + n[4:] + "1") not in names]
    for some, most in ((asked, 200), (mixed, 6000)):
        seen.clear()
        got = simjoin.close_keys(spark.createDataFrame([(a,) for a in some], "key string"), spark.createDataFrame([(k,) for k in names], "key string"))
        found = {}
        for x in got.orderBy("asked", F.desc("ratio"), F.desc("key")).collect():
            found.setdefault(x.asked, []).append(x.key)
        assert found == {a: difflib.get_close_matches(a, names, 5, 0.5) for a in some}
        assert sum(seen) <= most * len(some)


def test_quotes_are_held_against_near_sentences(spark, monkeypatch):
    """Only these are scored one by one, and the texts of one file are dealt over all tasks."""
    r = random.Random(6)
    say = lambda n: " ".join("".join(r.choice(["th", "er", "on", "in", "ed", "é", "日本"]) for _ in range(r.randrange(1, 5))) for _ in range(n))
    quotes = [" ".join(sorted(set(say(n).split()))) for n in (0, 1, 2, 9, 10, 11, 12, 40, 40)]
    rows = [" ".join(sorted(set(say(r.randrange(1, 50)).split()))) for _ in range(300)] + ["", "x"]
    rows += [" ".join(sorted({w[:-1] + "q" if r.random() < most else w for w in q.split()})) for q in quotes for most in (0.1, 0.3, 0.6, 1)]
    want = {(i, j): x for i, a in enumerate(rows) for j, b in enumerate(quotes) if (x := round(search.token_set_ratio(a, b), 6)) >= 0.8}
    scored, ratio = [], search.token_set_ratio
    monkeypatch.setattr(search, "token_set_ratio", lambda a, b: scored.append(1) or ratio(a, b))
    got = {(i, j): x for i, j, x in search.similar(rows, search.Known(quotes), 0.8)}
    assert got == want and len(want) > 12
    assert len(scored) <= 1.5 * len(want)
    one = spark.createDataFrame([(1, "a b c")], "k long, t string")
    assert "Repartition" in plan(search.score_quotes(one, one.coalesce(1).withColumnRenamed("k", "k2"), "k", "t", "k2", "t", 0.8))


def test_prefixes_of_any_form_are_dealt_over_all_tasks(spark):
    """A surname with digits or a year of other than four had no key; all pairs of a prefix were made in one task."""
    papers = [(1, "3M", 2020), (2, "Xu", 199), (3, "Xu", 19901), (4, None, 2000), (5, "Xu", None), (6, "Xu", 1990), (6, "Xu", 1990), (7, "\u00d6zg\u00fcr", 2001)]
    keys = ["3m2020slug", "xu199", "xu1990slug", "xu19901x", "xu1990slug", "nokey", "", None, "\u00f6zg\u00fcr2001"]
    got = library.parent_candidates(spark.createDataFrame(papers, "id long, surname string, year int"), spark.createDataFrame([(k,) for k in keys], "key string"))
    want = sorted((i, k) for i, s, y in papers for k in keys if s and y and k and k.startswith(f"{s.lower()}{y}"))
    assert sorted(map(tuple, got.collect())) == want and len(want) == 13
    many = library.parent_candidates(spark.range(2000).selectExpr("id", "'Xu' AS surname", "1990 AS year"), spark.range(50).selectExpr("concat('xu1990s', id) AS key"))
    made = many.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()
    assert sum(x.n for x in made) == 100_000 and max(x.n for x in made) < 80_000


def test_windows_are_scored_together(spark, monkeypatch):
    """Not one by one, and the pages of one file are dealt over all tasks; sizes of needles share windows."""
    r = random.Random(8)
    say = lambda n: " ".join("".join(r.choice(["th", "er", "on", "IN", "ed", "é", "日本", "a\u0130"]) for _ in range(r.randrange(1, 5))) for _ in range(n))
    rows = []
    for k in range(60):
        pages = [say(r.randrange(150)), None if k % 7 == 0 else say(r.randrange(90)), say(9)]
        words = pages[0].split()
        needles = [" ".join(words[3 : 3 + r.randrange(1, 40)]), say(3), "", None, "two words", say(r.randrange(30))]
        rows.append((k, r.sample(needles, r.randrange(len(needles) + 1)) if k % 9 else None, [say(1), "two words"], pages if k % 11 else None))

    def brute(needles, pages):
        best = (0.0, "", "")
        for n in [] if pages is None else [n for n in needles or [] if n]:
            low, wide, step, own = n.lower(), max(len(n.lower()) + len(n.lower()) // 2, 60), max(len(n.lower()) // 3, 20), (0.0, "")
            for page, at in ((p or "", at) for p in pages[:2] for at in range(0, max(len((p or "").lower()) - wide + 1, 1), step)):
                ratio = search.token_set_ratio(low, page.lower()[at : at + wide])
                if own[0] < 0.95 and ratio > own[0]:
                    own = (ratio, page[at : at + wide].strip())
            if best[0] < 0.95 and own[0] > best[0]:
                best = (*own, n)
        return best

    got = {x.k: (tuple(x.f), tuple(x.g)) for x in fuzzy.search_pages(spark.createDataFrame(rows, "k int, n array<string>, m array<string>, p array<string>"), ["n", "m"], "p", ["f", "g"]).collect()}
    assert got == {k: (brute(n, p), brute(m, p)) for k, n, m, p in rows} and sum(x[0][0] >= 0.95 for x in got.values()) > 5
    pages, short = [say(400), say(200)], say(5).lower()
    want = brute([short], pages)[:2]
    monkeypatch.setattr(search, "_indel", lambda a, b: 1 / 0)
    assert fuzzy.window_search(short, pages) == want
    some = fuzzy._Windows(pairs=7)
    (found,) = some.search([short], pages)
    some.flush()
    assert (found.ratio, found.snippet) == want
    one = spark.createDataFrame([(["a b"], ["a b c"])], "n array<string>, p array<string>").coalesce(1)
    assert "Repartition" in plan(fuzzy.search_pages(one, "n", "p", "f"))


def test_copied_titles_are_counted(spark, tmp_path, monkeypatch):
    """New and known rows of a title met one by one, so that hits grew with the square of its copies."""
    rows = [(k, f"<html><title>{t}</title>") for k, t in enumerate(["the same words", "words the same", "other words here", "", "lone"] * 60)] + [(None, "<title>lone</title>"), (500, "no title"), (501, None)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(simjoin, "title_hits", lambda *a, **b: 1 / 0)
    got = {x.page_id: (x.known_key, x.ratio, x.hits) for x in catalogue.QUERIES["fuzzy_title_dedup"](spark, str(tmp_path)).collect()}
    titles = [(k, (re.search("<title>([^<]*)</title>", h) or ["", ""])[1] if h else "") for k, h in rows]
    want = {}
    for n, a in titles:
        if n is not None and n % 50 == 0:
            hits = [(k, x) for k, b in titles if k is not None and k != n and (x := search.token_set_ratio(a, b)) >= 0.9]
            want[n] = (*min(hits, default=(None, None)), len(hits))
    assert got == want and want[0] == (1, 1.0, 119) and want[500] == (None, None, 0)
