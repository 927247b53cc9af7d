"""Behaviour of single operators on tables of a few rows."""

import gzip
import json
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from parchmint.functions import ids, register
from parchmint.functions import text as tx
from parchmint.operators import catalog, contents, figures, fuzzy, gates, graph, library, ordered, search, structure
from parchmint.plans import catalogue
from parchmint.sources import archive, readers, sinks
from parchmint.streaming import ingest


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols))
    return df.select(expr.alias("x")).first().x


def test_text(spark):
    t = F.col("t")
    assert one(spark, tx.normalize(t), t="The ﬁrst  co-\n  op­ “Quote” End") == 'the first coop "quote" end'
    assert one(spark, tx.clean_for_quote(t), t="Zero​Width – Kept") == "ZeroWidth - Kept"
    assert one(spark, tx.sentences(t), t="One. Two!  Three? end") == ["One.", "Two!", "Three?", "end"]
    assert one(spark, tx.occurrences(t, "aXa"), t="aXaXa aXa") == [1, 3, 7]
    assert one(spark, tx.occurrences(t, "zz"), t="aXa") == []
    many = "ab" * 1500 + "c" + "ab" * 3
    assert one(spark, tx.occurrences(t, "aba"), t=many) == [m.start() + 1 for m in re.finditer("(?=aba)", many)]
    for n in (0, 1, 255, 256, 257, 700):
        r = spark.range(1).select(tx.running(F.transform(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>"), lambda x: (x % 5).cast("int"))).alias("x")).first().x
        assert r == [sum(k % 5 for k in range(1, i + 1)) for i in range(1, n + 1)]
    assert one(spark, tx.squeeze(tx.strip_markup(t)), t=r"See \emph{the \textbf{bold} word} \cite{a} % gone") == "See the bold word"
    assert one(spark, tx.word_count(t), t=" \n") == 0


def test_ids(spark):
    assert one(spark, ids.surname(F.col("t")), t="Xu, Ada") == one(spark, ids.surname(F.col("t")), t="Ada M. Xu") == "xu"
    assert one(spark, ids.slug(F.col("t")), t="The Art of War Games") == "artwar"
    assert one(spark, ids.key_problem(F.col("t")), t="ok-1") is None


def test_overlap_fill_and_parents(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c")], "g int, t int, v string")
    right = spark.createDataFrame([(1, 2, "x"), (1, 5, "y"), (2, 10, "z")], "g int, t int, w string")
    assert {r.v: r.w for r in ordered.asof(left, right, ["g"], "t", ["w"]).collect()} == {"a": "y", "b": None, "c": None}
    up = ordered.upsert(left, spark.createDataFrame([(1, 7, "n"), (1, 8, "m")], "g int, t int, v string"), ["g"], [F.desc("t")])
    assert sorted((r.g, r.v) for r in up.collect()) == [(1, "m"), (2, "c")]


def test_graph(spark):
    edges = spark.createDataFrame([("p", "a"), ("p", "b"), ("p", "a"), ("q", "a")], "citing string, cited string")
    seeds = spark.createDataFrame([("a",), ("b",)], "cited string")
    assert [tuple(r) for r in graph.shared_citers(edges, seeds, 2, 5).collect()] == [("p", 2)]
    papers = spark.createDataFrame([("p", 2030), ("q", None)], "citing string, year int")
    none = spark.createDataFrame([], "citing string")
    assert [(r.citing, r.score) for r in graph.discover_new(edges, papers, seeds, none, 2025, 1, 5).collect()] == [("p", 3.0), ("q", 0.5)]
    seen = spark.createDataFrame([("a", "2024-01-01"), ("b", "not a date")], "key string, last_checked string")
    keys = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert [r.key for r in graph.find_stale(keys, seen, "2024-03-01 00:00:00", 5).collect()] == ["c", "b", "a"]


def test_unique_keys(spark):
    df = spark.createDataFrame([("h1", "k", None), ("h2", "k", None)], "content_hash string, key string, doi string")
    catalog.check_unique(df, ["doi"])
    with pytest.raises(catalog.DuplicateKey):
        catalog.check_unique(df, ["key"])


def test_scores(spark):
    q = spark.createDataFrame([("noise graph", "graph of noise"), ("noise noise", "noise"), ("x", "y"), (None, None)], "q string, t string")
    got = [round(r[0], 4) for r in q.select(search.token_proximity("q", "t")).collect()]
    assert got == [0.7925, 0.15, 0.0, 0.0]
    r = random.Random(5)
    texts = [" ".join(r.choices("a b c d e f g".split(), k=r.randrange(0, 30))) for _ in range(60)] + [None, "", "A\u00a0b  C"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for query in ("a b c", "a", "a a b", "z y", "c b a e"):
        rows = df.select(search.proximity(query, F.col("t")).alias("x"), search.token_proximity(F.lit(query), F.col("t")).alias("y")).collect()
        assert all(abs(x.x - x.y) < 1e-9 for x in rows)
    assert search.token_set_ratio("a b c", "c b a d") == 1.0
    assert search._indel("abc", "abd") == pytest.approx(4 / 6)
    out = search.pack_chunks(["x" * 60, "y" * 60, "z" * 60], 130, 70)
    assert out == ["x" * 60 + " " + "y" * 60, "y" * 60 + " " + "z" * 60]
    assert search.pack_chunks(["a" * 250, "b" * 250], 500) == ["a" * 250 + " " + "b" * 250]  # the space isn't counted
    assert search.pack_chunks(["a" * 600, "a" * 600], 500) == ["a" * 600, "a" * 600]


def test_quotes_begin_and_end_within_words(spark):
    docs = spark.createDataFrame([(1, "xxalpha beta gammazz and more"), (2, "alpha beta"), (3, "one,two  three"), (4, None)], "d long, t string")
    quotes = spark.createDataFrame([(1, "alpha beta gamma"), (2, "pha"), (3, "pha be"), (4, "two  three"), (5, "no such words here"), (6, None), (7, "o")], "q long, t string")
    got = sorted(tuple(r) for r in search.verify_quotes(quotes, docs, "q", "t", "d", "t").collect())
    assert got == sorted((q.q, d.d) for q in quotes.collect() for d in docs.collect() if q.t and d.t and q.t in d.t)


def test_grep_in_long_texts(spark):
    text = "ab " * 60_000 + "needle" + " cd" * 60_000
    df = spark.createDataFrame([(1, text)], "d long, t string")
    rows = search.grep(df, "needle", ["d"], "t", 3).collect()
    assert [(r.offset, r.context) for r in rows] == [(180_000, "ab needle cd")]


def plain_grep(text, needle, around):
    """Offsets and contexts by a walk over the whole text."""
    norm, out, at = tx.normal_form(text), [], -1
    while (at := norm.find(needle, at + 1)) >= 0:
        ratio = len(text) / max(len(norm), 1)
        out.append((at, text[max(0, int(at * ratio) - around) : min(len(text), int((at + len(needle)) * ratio) + around)].strip()))
    return out


def test_grep_context(spark):
    """Both ends are scaled and clipped, the end is taken from the occurrence, and white space goes."""
    r = random.Random(2)
    texts = ["abc needle xxx", "needle", "  needle   needle  ", "a" * 1100 + " needle\n\n\n  needle " + "é" * 600, "needleneedle", "none", ""]
    texts += ["".join(r.choice(["aa", "a a", " ", "\n  ", "é", "aaa", "-\nb"]) for _ in range(r.randrange(1, 400))) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "d long, t string")
    for needle, around in (("needle", 20), ("aa", 7), ("a", 0)):
        got = sorted((x.d, x.offset, x.context) for x in search.grep(df, needle, ["d"], "t", around).collect())
        assert got == sorted((i, at, c) for i, t in enumerate(texts) for at, c in plain_grep(t, needle, around))
    assert search.grep(df.where("d = 0"), "needle", ["d"], "t", 20).collect()[0].context == "abc needle xxx"


def test_versions(spark, tmp_path):
    p = str(tmp_path / "versions")
    for k in range(3):
        assert sinks.write_version(spark.range(k), p) == k + 1
    assert sinks.read_version(spark, p).count() == 2 and sinks.read_version(spark, p, 2).count() == 1
    sinks.drop_versions(spark, p)
    assert [n for n, _ in sorted(sinks._versions(spark, p))] == [2, 3]


def test_structure(spark):
    text = "x\n% === FILE META (machine-readable, not rendered) ===\n% Status: draft\n% Due: now: \n% Status: final\nend\n% Late: no"
    files = spark.createDataFrame([("a", text), ("b", "no block\n% Status: x")], "file string, text string")
    assert [tuple(r) for r in structure.file_meta(files).orderBy("field").collect()] == [("a", "Due", "now:"), ("a", "Status", "final")]
    assert [r.field for r in structure.file_meta(files, allowed=["Due"]).collect()] == ["Due"]
    new = spark.createDataFrame([("a", "open", "why"), ("a", "status", "new"), ("a", "gone", "")], "file string, field string, value string")
    out = dict(map(tuple, structure.write_meta(files, new, order=("status",)).collect()))
    assert out["a"] == "x\n\n% === FILE META (machine-readable, not rendered) ===\n% status: new\n% open: why\n"
    assert out["b"] == "no block\n% Status: x\n"
    lines = spark.createDataFrame([("f", 1, "% TODO(ann): fix \\cite{x}"), ("f", 2, "TODO(bo): more TODO(cy): yet")], "file string, line int, text string")
    got = structure.tracked(lines, {"todo": (r"TODO\((\w+)\): (\w+)", ["who", "what"])}).collect()
    assert [(r.line, r.raw, r.groups) for r in got] == [(1, "TODO(ann): fix", {"who": "ann", "what": "fix"}), (2, "TODO(bo): more", {"who": "bo", "what": "more"}), (2, "TODO(cy): yet", {"who": "cy", "what": "yet"})]
    deep = r"a \textbf{b \emph{c \textit{d \textsc{e \mbox{f}}}}} g"
    assert one(spark, tx.strip_markup(F.col("t")), t=deep) == "a b c d e f g"


def test_readers(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.tex").write_text("one\ntwo")
    (tmp_path / "p" / "venv").mkdir()
    (tmp_path / "p" / "venv" / "x.py").write_text("no")
    (tmp_path / "p" / "b.dat").write_text("no")
    assert [r.file for r in readers.project_files(spark, str(tmp_path / "p")).collect()] == ["a.tex"]
    assert [(r.line, r.text) for r in readers.text_lines(spark, str(tmp_path / "p" / "a.tex")).orderBy("line").collect()] == [(1, "one"), (2, "two")]
    with gzip.open(tmp_path / "d.json.gz", "wt") as f:
        f.write('{"id": 1}\n\nbroken\n{"id": 2}\n')
    assert sorted(r.id for r in readers.json_lines(spark, str(tmp_path / "d.json.gz"), "id int").collect()) == [1, 2]
    (tmp_path / "l.bib").write_text('@article{xu2022, title = {A {Nested} title}, year = 2022, x-tags = {a, b}}\n@book{c1, author = "Lee, Bo"}\n@comment{x, y}')
    rows = {r.key: r for r in readers.bibliography(spark, str(tmp_path / "l.bib")).collect()}
    assert rows["xu2022"].fields["title"] == "A {Nested} title" and rows["xu2022"].tags == ["a", "b"] and rows["c1"].type == "book"
    entries = readers.bibliography(spark, str(tmp_path / "l.bib"))
    (tmp_path / "o.bib").write_text("".join(r.text for r in readers.render_bib(entries).collect()))
    assert readers.round_trip(entries, readers.bibliography(spark, str(tmp_path / "o.bib"))).count() == 0
    toc = spark.createDataFrame([("t", 1, r"\contentsline {section}{\numberline {1.2}A \emph  {b}}{7}{section.1.2}%")], "file string, line int, text string")
    r = readers.toc_lines(toc).first()
    assert (r.level, r.depth, r.number, r.title, r.page, r.anchor) == ("section", 1, "1.2", "A b", 7, "section.1.2")
    more = [(1, r"\contentsline {part}{II Deep {a {b {c}}} end\fileinfo {./p/q.tex}{12}}{xi}{part.2}%"), (2, r"\contentsline {chapter}{no}{1}{c}"), (3, r"\contentsline {section}{broken"), (4, "text")]
    r = readers.toc_lines(spark.createDataFrame([("t", n, x) for n, x in more], "file string, line int, text string")).collect()
    assert [(x.number, x.title, x.page, x.file, x.line) for x in r] == [("II", "Deep {a {b {c}}} end", 0, "p/q.tex", 12)]
    lof = spark.createDataFrame([("l", 1, r"\contentsline {figure}{\numberline {3}{\ignorespaces " + "long " * 40 + r"}}{9}{figure.3}%")], "file string, line int, text string")
    assert [(x.kind, x.number, len(x.caption), x.caption[-3:]) for x in readers.float_lines(lof, "figure").collect()] == [("figure", "3", 120, "...")]
    aux = [(1, r"\newlabel{sec:a}{{1}{3}{T}{section.1}{}}"), (2, r"\newlabel{sec:b}{{1}{3}{T}{section.1}{}}"), (3, r"\newlabel{sec:c@cref}{{1}{3}{T}{section.2}{}}"), (4, r"\newlabel{fig:d}{{1}{3}{T}{figure.1}{}}")]
    assert [tuple(x) for x in readers.label_lines(spark.createDataFrame([("x", n, t) for n, t in aux], "file string, line int, text string")).collect()] == [("x", "section.1", "sec:b")]
    idx = spark.createDataFrame([("i", 1, r"\indexentry{a@Alpha!beta|see{Gamma}}{3}")], "file string, line int, text string")
    r = readers.index_lines(idx).first()
    assert (r.term, r.subterm, r.see_target, r.page) == ("Alpha", "beta", "Gamma", 3)


def test_api_shapes(spark):
    s2 = [(json.dumps({"paperId": "p", "year": 2020, "externalIds": {"DOI": "10.1/A"}, "authors": [{"name": n} for n in "abcdefg"]}),), ("{}",), ("broken",)]
    a = readers.api_papers(spark.createDataFrame(s2, "data string")).collect()
    assert a[0].doi == "10.1/a" and len(a[0].authors) == 5 and a[1].title is None and a[2].s2_id is None
    work = json.dumps({"message": {"DOI": "10.1/B", "title": ["T"], "author": [{"family": "Xu", "given": "A"}], "published-online": {"date-parts": [[2019, 1]]}}})
    b = readers.api_works(spark.createDataFrame([(work,)], "data string")).first()
    assert (b.doi, b.title, b.authors, b.year, b.journal) == ("10.1/b", "T", ["Xu, A"], 2019, None)
    x = "<x:xmpmeta><dc:title><rdf:Alt><rdf:li xml:lang='x'>My title</rdf:li></rdf:Alt></dc:title><prism:doi>10.1/c</prism:doi></x:xmpmeta>"
    r = readers.xmp(spark.createDataFrame([(1, x), (2, "<x:xmpmeta><broken")], "id int, xml string"), "id", "xml").orderBy("id").collect()
    assert (r[0].title, r[0].doi, r[1].title) == ("My title", "10.1/c", None)


def test_sinks(spark, tmp_path):
    p = str(tmp_path / "t")
    df = spark.createDataFrame([("a1", 1), ("B2", 2), ("_x", 3)], "key string, n int")
    sinks.write_sharded(df, p, "key")
    assert {r.shard for r in spark.read.parquet(p).collect()} == {"a", "b", "_"}
    q = str(tmp_path / "u")
    sinks.swap(df, q)
    sinks.merge(spark, q, spark.createDataFrame([("a1", 9), ("new", 4)], "key string, n int"), ["key"], ["n"])
    sinks.insert_missing(spark, q, spark.createDataFrame([("a1", 0), ("more", 5), (None, 6)], "key string, n int"), ["key"])
    sinks.delete(spark, q, spark.createDataFrame([("B2",)], "key string"), ["key"])
    assert sorted((r.key, r.n) for r in spark.read.parquet(q).collect()) == [("_x", 3), ("a1", 9), ("more", 5), ("new", 4)]
    sinks.append_log(spark.createDataFrame([("t", "x" * 500)], "tool string, params string"), str(tmp_path / "log"))
    assert len(spark.read.json(str(tmp_path / "log")).first().params) == 200


def test_chunk_stream_is_idempotent(spark, tmp_path):
    pages, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    spark.createDataFrame([("k", 1, "One. Two."), ("k", 2, "Three.")], "key string, page int, text string").write.parquet(pages)
    for _ in range(2):
        ingest.chunk_stream(spark, pages, out, mark).awaitTermination()
    spark.createDataFrame([("k", 2, "Changed.")], "key string, page int, text string").write.mode("append").parquet(pages)
    ingest.chunk_stream(spark, pages, out, mark).awaitTermination()
    assert sorted((r.page, r.text) for r in ingest.read_chunks(spark, out).collect()) == [(1, "One. Two."), (2, "Changed.")]
    spark.createDataFrame([("k", 1, "")], "key string, page int, text string").write.mode("append").parquet(pages)
    ingest.chunk_stream(spark, pages, out, mark).awaitTermination()
    assert [(r.page, r.text) for r in ingest.read_chunks(spark, out).collect()] == [(2, "Changed.")]


def test_call_counts(spark):
    df = spark.createDataFrame([("a", "ok", "2024-01-01 10:05:00"), ("a", "error", "2024-01-01 10:50:00"), ("b", "ok", "2024-01-01 11:00:00")], "tool string, status string, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.tool, r.calls, r.errors) for r in ingest.call_counts(df).collect()) == [("a", 2, 1), ("b", 1, 0)]


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


def test_quotes_against_brute_force(spark):
    r = random.Random(8)
    vocabulary = [f"{a}{b}" for a in ("gra", "riv", "sto", "lig", "pap") for b in ("ph", "er", "ne", "ht", "ss")]
    say = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    quotes = [(k, say(30)) for k in range(6)] + [(6, None)]
    docs = [(k, ". ".join(say(r.randrange(1, 30)) for _ in range(12)) + (f". {near_title(r, quotes[k % 6][1])}. The end." if k % 2 else "")) for k in range(30)] + [(30, None), (31, "")]
    want = {}
    for i, q in quotes:
        for d, t in docs:
            best = max((round(search.token_set_ratio(s.strip(), q or ""), 6) for s in re.split(r"(?<=[.!?])\s+", t or "")), default=0)
            if best >= 0.8:
                want[i, d] = best
    df, own = spark.createDataFrame(docs, "d long, text string"), spark.createDataFrame(quotes, "q long, t string")
    for block in (512, 4):
        got = search.score_quotes(own, df, "q", "t", "d", "text", 0.8, block).collect()
        assert {(x.q, x.d): x.ratio for x in got} == want and len(want) > 5 and len(got) == len(want)
    assert search.score_quotes(own.limit(0), df, "q", "t", "d", "text", 0.8).count() == 0


def test_quote_score_reads_beyond_the_beginning(spark, tmp_path):
    item = "seven quiet herons walked along the frozen canal before dawn broke over distant mills"
    late = "Nothing of note is said here at all. " * 20
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, late + item), (6, late)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(x) for x in catalogue.quote_score(spark, str(tmp_path)).collect()] == [("q1", "d5", 1.0)]


def test_whole_table_queries_read_every_row(spark, tmp_path):
    texts = {1: "Both the first. " * 200, 2: "Caf\u00e9 \ufb01th   the Sm\u00f6rg\u00e5s", 3: "\uff34\uff48\uff45 w\u00efth the th the", 4: "no hit", 5: None, 6: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("*", "coalesce(length(text), 0) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    norm = {k: None if t is None else " ".join(unicodedata.normalize("NFKC", t).lower().split()) for k, t in texts.items()}
    assert dict(map(tuple, catalogue.normalize_text(spark, str(tmp_path)).collect())) == norm
    hits = sorted((r.doc_id, r.offset) for r in catalogue.grep_overlapping(spark, str(tmp_path)).collect())
    assert hits == [(k, m.start()) for k, t in norm.items() for m in re.finditer("(?=th the)", t or "")] and {2, 3} <= {k for k, _ in hits}
    whole = dict(map(tuple, catalogue.inverted_index_reconstruct(spark, str(tmp_path)).collect()))
    assert whole == {k: " ".join(t.split()) for k, t in texts.items() if t is not None}


def test_whole_table_queries_reach_high_keys(spark, tmp_path):
    write = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    write("lineitem", [(7000, 500), (7000, 501), (7000, 501), (7001, 501)], "l_orderkey long, l_partkey long")
    write("part", [(500, "a"), (501, "b")], "p_partkey long, p_name string")
    write("orders", [(7000, "O"), (7001, "F")], "o_orderkey long, o_orderstatus string")
    write("supplier", [(500, "first")], "s_suppkey long, s_name string")
    run = lambda name: sorted(tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())
    assert run("shared_citers") == [(7000, 2)]
    assert run("citers_with_metadata") == [(500, 7000, 1, "O"), (501, 7000, 2, "O"), (501, 7001, 2, "F")]
    assert run("references_with_metadata") == [(7000, 500, 2, "a"), (7000, 501, 2, "b"), (7001, 501, 1, "b")]
    assert run("lookup_by_priority") == [(500, "first"), (501, "b")]


# --- rules stated by hand ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see doi:10.1103/PhysRevLett.1.2, and", "10.1103/PhysRevLett.1.2"),
        ("https://dx.doi.org/10.1000/a(b).", "10.1000/a(b"),
        ("DOI 10.1234/x;y", "10.1234/x"),
        ('bare 10.5555/ab"c', "10.5555/ab"),
        ("10.1/short", None),
        ("", None),
    ],
)
def test_dois(spark, text, want):
    assert one(spark, ids.extract_doi(F.col("t")), t=text) == want


@pytest.mark.parametrize(
    ("term", "want"),
    [("§2.1", "heading"), ("¶3", "heading"), ("¶ 7", "semantic"), ("2.1.3", "heading"), ("3", "semantic"), ("xu2022", "cite"), ("Xu-a_2022b", "cite"), (r"\label{fig:a}", "label"), (r"\ref{x", "label"), ("a/b.tex", "file"), ("%TODO", "marker"), (r"\foo", "marker"), ("quantum", "semantic")],
)
def test_terms(spark, term, want):
    assert one(spark, ids.classify_term(F.col("t")), t=term) == want


def test_names_titles_and_keys(spark):
    t = F.col("t")
    assert one(spark, ids.name_variants(t), t="Mehta, Girish") == ["Mehta, Girish", "Girish Mehta"]
    assert one(spark, ids.name_variants(t), t=" Girish K. Mehta ") == ["Girish K. Mehta", "Mehta, Girish K.", "Mehta Girish K."]
    assert one(spark, ids.name_variants(t), t="Smith, John, Jr.") == ["Smith, John, Jr.", "John, Jr. Smith"]
    assert one(spark, ids.name_variants(t), t="Plato") == ["Plato"] and one(spark, ids.name_variants(t), t="Lee,") == ["Lee,"]
    assert one(spark, ids.first_surname(t), t="Xu, Yang and Guo, Xuefeng") == "Xu" == one(spark, ids.first_surname(t), t="Yang Xu; X. Guo")
    assert one(spark, ids.slug(t), t="Étude comparative des Größen") == "etudedes" and one(spark, ids.slug(t), t="The Study of") == ""
    assert one(spark, ids.make_key(F.lit("de Silva"), F.lit(2007), t), t="Molecular logic") == "desilva2007molecular"
    assert one(spark, ids.related_kind(t, F.lit(None)), t="Correction to: Withdrawal of X") == "retraction"
    assert one(spark, ids.related_kind(t), t="Response to Y") == "comment" and one(spark, ids.related_kind(t), t="Y") is None
    page = "  \n12 May 2020\nJOURNAL OF X\nann@x.org and others\nUniversity of Y\ntiny\nA Real Title of This Paper\nmore"
    assert one(spark, ids.title_line(t), t=page) == "A Real Title of This Paper"
    got = one(spark, ids.identify(F.lit("doi:10.1234/abc"), F.lit("Microsoft Word - draft"), t), t=page)
    assert (got.doi, got.doi_source, got.title) == ("10.1234/abc", "metadata", "A Real Title of This Paper")
    assert one(spark, ids.attribution(F.array(F.lit("Xu, Y."), F.lit("Guo")), F.lit(2020), t), t="scheme4") == "Reproduced from Xu et al. (2020), Scheme 4"
    assert one(spark, ids.label_kind(t), t="subsec:a") == "subsection" and one(spark, ids.label_kind(t), t="ch:a") == "unknown"
    assert [r.file_type for r in spark.createDataFrame([("a.BIB",), ("b.tikz",), ("c.yml",), ("d.x",)], "f string").select(readers.file_type(F.col("f")).alias("file_type")).collect()] == ["bibtex", "tikz", "yaml", None]
    bad = spark.createDataFrame([("a/b.tex",), (".git/x.py",), ("box/in/p.md",), ("build/y.md",), ("build.md",)], "f string")
    assert [r.x for r in bad.select(readers.excluded(F.col("f"), below=("box/in",)).alias("x")).collect()] == [False, True, True, True, False]


def test_facts_by_hand(spark):
    rows = [(1, r"\label{sec:a} Section~\ref{sec:b} and \autoref{fig:c}"), (2, r"%\label{no}"), (3, r"\cite{x, y,}\citep[p.~1]{opt}\citealt{no}\mcitebox{z}{q}"), (4, r"\section*{T}\input{s/t}\include{u.tex}\index{a!b}"), (5, r"\label{fig:c}\label{eq:d}\eqref{eq:d}")]
    got = structure.facts(spark.createDataFrame([("f", n, t) for n, t in rows], "file string, line int, text string")).orderBy("line", "pos").collect()
    assert [(r.line, r.kind, r.name, r.extra, r.near) for r in got] == [
        (1, "label", "sec:a", "section", None),
        (1, "ref", "sec:b", "Section", "sec:a"),
        (1, "ref", "fig:c", "bare", "sec:a"),
        (3, "cite", "x", "cite", "sec:a"),
        (3, "cite", "y", "cite", "sec:a"),
        (3, "cite", "z", "mcitebox", "sec:a"),
        (4, "section", "T", "section", None),
        (4, "input", "s/t.tex", None, None),
        (4, "input", "u.tex", None, None),
        (4, "index", "a!b", None, None),
        (5, "label", "fig:c", "figure", None),
        (5, "label", "eq:d", "equation", None),
        (5, "ref", "eq:d", "bare", "eq:d"),
    ]


# --- what SQL can't state, by brute force ------------------------------------------------------------------------------------


def test_window_search(spark):
    page = "Some front matter that says little. " * 3 + "Light emission from QUANTUM dots in silicon\nby Ada Xu" + " and then more words follow here" * 5
    ratio, snippet = fuzzy.window_search("light emission from quantum dots in silicon", ["x", page])
    assert ratio >= 0.95 and "QUANTUM" in snippet
    assert fuzzy.window_search("light", ["", "a", "light"]) == (0.0, "")  # the third page isn't read

    def brute(needle, pages):
        wide, step, best = max(len(needle) + len(needle) // 2, 60), max(len(needle) // 3, 20), 0.0
        for p in pages[:2]:
            for a in range(0, max(len(p) - wide + 1, 1), step):
                best = max(best, search.token_set_ratio(needle, p.lower()[a : a + wide]))
                if best >= 0.95:
                    return best
        return best

    r = random.Random(3)
    words = "noise graph light paper glass wind salt iron moss".split()
    for _ in range(40):
        needle, pages = " ".join(r.choices(words, k=r.randrange(1, 8))), [" ".join(r.choices(words, k=r.randrange(0, 60))) for _ in range(3)]
        assert fuzzy.window_search(needle, pages)[0] == brute(needle, pages)
    df = spark.createDataFrame([(1, ["Ada Xu", "Xu, Ada"], ["written by Xu, Ada of nowhere " + "z " * 40]), (2, None, ["x"]), (3, ["a"], None)], "k int, n array<string>, p array<string>")
    got = {x.k: x.f for x in fuzzy.search_pages(df, "n", "p", "f").collect()}
    assert got[1].score == 1.0 and got[2].score == got[3].score == 0.0


def test_search_gates(spark):
    text = "Noise in small quantum systems\nby Girish Mehta and others. " + "The abstract says many things about noise. " * 4
    rows = [
        (1, [text], "Noise in small quantum systems", "Noise in small quantum systems", ["Mehta, Girish"]),
        (2, [text], "Noise in small quantum systems", "Porcelain teapots of the Ming dynasty", ["Quillfeather, Zed"]),
        (3, [text], None, None, None),
        (4, [], "x", "x", ["x"]),
        (5, [text], "porcelain teapots", "Porcelain Teapots", ["Xy", "X, Mehta"]),
    ]
    docs = spark.createDataFrame(rows, "key int, pages array<string>, title string, registry_title string, registry_authors array<string>")
    known = spark.createDataFrame([("b", "Noise in small quantum systems"), ("a", "systems quantum small in Noise"), ("c", None), ("d", "noise IN small quantum systems")], "key string, title string")
    got = {(x.key, x.gate): (x.passed, x.message) for x in gates.search_gates(docs, "key", known).collect()}
    assert got[1, "doi_title_match"] == (True, "Title found in text (score 1.00)") and got[1, "doi_author_match"] == (True, "Author 'Girish Mehta' found (score 1.00)") or got[1, "doi_author_match"][0]
    assert got[1, "title_dedup"] == (False, "Similar title in vault: 'a' (score 1.00)")
    assert not got[2, "doi_title_match"][0] and got[2, "doi_title_match"][1].startswith("Title mismatch (score 0.") and not got[2, "doi_author_match"][0]
    assert got[5, "doi_title_match"] == (True, "Title match score: 1.00") and got[5, "title_dedup"] == (True, "No similar titles found")
    assert {k for k, _ in got} == {1, 2, 5} and {g for k, g in got if k == 2} == {"doi_title_match", "doi_author_match", "title_dedup"}
    scores = spark.createDataFrame([(1, 1, 0.2), (2, 1, 0.9), (2, 3, 0.51), (2, 4, 0.5)], "key int, page int, score double")
    out = {x.key: (x.passed, x.message) for x in gates.injection_rows(scores, docs, "key").collect()}
    assert out[2] == (False, "Prompt injection detected on page(s) [1, 3] (max score: 0.90)") and out[1] == (True, "Clean (max score: 0.20)") and out[3][0]


def test_report_needs_the_title_of_papers(spark):
    rows = [(1, 1, "pdf_integrity", True, ""), (1, 6, "doi_title_match", True, ""), (2, 1, "pdf_integrity", True, ""), (3, 1, "pdf_integrity", True, ""), (4, 1, "pdf_integrity", True, ""), (4, 6, "doi_title_match", False, "no"), (4, 2, "dedup", False, "twice")]
    kinds = spark.createDataFrame([(3, "patent"), (4, "patent")], "key int, doc_type string")
    got = {r.key: (r.all_passed, r.auto_accept, r.issues, r.confidence) for r in gates.report(spark.createDataFrame(rows, "key int, ord int, gate string, passed boolean, message string"), "key", kinds).collect()}
    assert got == {1: (True, True, "", 1.0), 2: (True, False, "", 1.0), 3: (True, True, "", 1.0), 4: (False, False, "twice; no", 0.33)}


def test_contents_rendering(spark):
    rows = [("d", 1, "part", 0, "I", "Ground", 1, "part.1", "", 0), ("d", 2, "section", 1, "1", "Start", 3, "section.1", "a.tex", 4), ("d", 3, "subsection", 2, "1.1", "First", 0, "x", "a.tex", 9), ("d", 4, "subsubsection", 3, "1.1.1", "Deep", 5, "y", "b.tex", 0), ("d", 5, "section", 1, "", "Plain", 7, "z", "", 0)]
    e = contents.tree(spark.createDataFrame(rows, "doc string, ord int, level string, depth int, number string, title string, page int, anchor string, file string, line int"))
    assert {r.ord: r.ancestors for r in e.collect()} == {1: [], 2: [1], 3: [2, 1], 4: [3, 2, 1], 5: [1]}
    e = contents.with_labels(e, spark.createDataFrame([("d", "section.1", "sec:s")], "doc string, anchor string, label string"))
    floats = contents.float_parents(spark.createDataFrame([("d", 1, "figure", "1", "A cap", 3, "a.tex", 6), ("d", 2, "table", "2", "T", 6, "", 0)], "doc string, ord int, kind string, number string, caption string, page int, file string, line int"), e)
    meta = spark.createDataFrame([("a.tex", "status", "draft")], "file string, field string, value string")
    text = [r.text for r in contents.render(e, floats, depth=2, meta=meta).orderBy("at").collect()]
    assert text == ["Part I Ground  p.1", "  §1 Start  [sec:s]  a.tex:4  p.3", "    # status: draft", "    Fig 1: A cap  :6  p.3", "    §1.1 First  :9", "      [1 subsections, 1 tables]", "  Plain  p.7"]
    shown = contents.matched(e, query="¶1.1.1")
    assert [r.text.strip()[:8] for r in contents.render(e, None, depth=5, shown=shown).orderBy("at").collect()] == ["Part I G", "§1 Start", "§1.1 Fir", "§1.1.1 D"]


def test_figure_contexts(spark):
    pages = spark.createDataFrame([("p", 2, "Fig 3 is named\nearly. " + "x" * 200 + " See figure 3 and FIG.3a."), ("p", 10, "Figure 3: A caption\nover lines.\n\nFig. 4. Other"), ("q", 1, "Figure 3 without")], "key string, page int, text string")
    named = spark.createDataFrame([("p", "fig3", 3), ("p", "fig4", 4), ("p", "fig9", 9), ("q", "fig3", 3)], "key string, figure string, num int")
    caps = {(r.key, r.figure): (r.caption, r.page) for r in figures.captions(pages, named).collect()}
    assert caps == {("p", "fig3"): ("is named\nearly. " + "x" * 200 + " See figure 3 and FIG.3a.", 2), ("p", "fig4"): ("Other", 10), ("q", "fig3"): ("without", 1)}
    got = sorted((r.page, r.at, r.text) for r in figures.contexts(pages, named).where("key = 'p' AND figure = 'fig3'").collect())
    text = pages.collect()[0].text
    assert [x for x in got if x[0] == 2] == [(2, m.start(), text[max(0, m.start() - 100) : m.end() + 100].strip().replace("\n", " ")) for m in re.finditer(r"(?i)(?:figure|fig\.?)\s*3", text)] and len(got) == 4


def test_library_state(spark, tmp_path):
    assert library.search_bag(["cited_by:xu2022", "online"]) == library.Bag("cited_by", key="xu2022")
    assert library.search_bag(["graph", "noise", "page:3"]) == library.Bag("local", query="graph noise", offset=40)
    assert library.search_bag(["*", "page:x"]).route == "list" and library.search_bag(["online", "q"]) == library.Bag("online", query="q")
    e = spark.createDataFrame([("a", "article", {"title": "T"})], "key string, type string, fields map<string,string>")
    with pytest.raises(catalog.DuplicateKey):
        library.add_entry(e, "a")
    with pytest.raises(library.UnknownKey):
        library.rename_key(e, "zz", "b")
    with pytest.raises(catalog.DuplicateKey):
        library.rename_key(library.add_entry(e, "b"), "a", "b")
    calls = [("s2", x) for x in (0.0, 0.2, 0.3, 5.0)] + [("other", 0.0), ("other", 0.0)]
    free, want = {}, []
    for s, at in calls:
        start = max(at, free.get(s, at))
        want.append((s, at, round(start - at, 6)))
        free[s] = start + library.THROTTLE_SECONDS.get(s, 0)
    assert sorted(tuple(r) for r in library.throttled(spark.createDataFrame(calls, "service string, at double")).collect()) == sorted(want)
    (tmp_path / "s.json").write_text('{"a": 1}\nbroken\n')
    assert [r.a for r in readers.state(spark, str(tmp_path / "s.json"), "a int").collect()] == [1]
    assert readers.state(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "pdf").mkdir()
    for name, body in (("a.pdf", b"one\x0ctwo"), ("b.pdf", b"!"), ("c.pdf", b"three")):
        (tmp_path / "pdf" / name).write_bytes(body)

    def parse(content):
        if content == b"!":
            raise ValueError
        return content.decode().split("\x0c")

    known = spark.createDataFrame([("c",)], "key string")
    assert sorted(tuple(r) for r in readers.binary_pages(spark, str(tmp_path / "pdf"), parse, known=known).collect()) == [("a", 1, "one"), ("a", 2, "two")]
    info = {r.key: r.info for r in readers.binary_info(spark, str(tmp_path / "pdf"), lambda c: {"title": parse(c)[0], "author": ""}).collect()}
    assert info == {"a": {"title": "one"}, "b": {}, "c": {"title": "three"}}


def test_functions_for_sql(spark):
    embed = register.hashing_embedder(16)
    names = register.register_functions(spark, embed)
    assert names == ["txt_normalize", "token_set_ratio", "token_proximity", "embed", "chunk_text"]
    r = spark.sql("SELECT txt_normalize('The ﬁrst  co-\n  op') AS a, token_set_ratio('a b', 'b a c') AS b, token_proximity('noise graph', 'graph of noise') AS c, size(embed('x y')) AS d").first()
    assert (r.a, r.b, round(r.c, 4), r.d) == ("the first coop", 1.0, 0.7925, 16)
    assert [tuple(x) for x in spark.sql("SELECT * FROM chunk_text(array('One.', 'Two.', 'Three.'), 9, 0)").collect()] == [(0, "One. Two."), (1, "Three.")]
    df = spark.createDataFrame([(1, "  One cat sat. One cat sat. Quite other words here. "), (2, ""), (3, None)], "k int, t string")
    got = [tuple(x) for x in register.semantic_chunks(df, "k", "t", embed).collect()]
    assert got == [(1, 0, 0, 25, "One cat sat. One cat sat."), (1, 1, 26, 49, "Quite other words here.")]
    v = [x.embedding for x in register.embeddings(df, "t", embed).collect()]
    assert all(len(x) == 16 for x in v) and abs(sum(x * x for x in v[0]) - 1) < 1e-6 and not any(v[2])


def test_archive(spark, tmp_path):
    path = str(tmp_path / "vault")
    meta = spark.createDataFrame([("xu2022", "h1", "10.1/a", "T"), ("Xa", "h2", None, "U"), ("9b", "h3", "10.1/b", None)], "key string, content_hash string, doi string, title string")
    pages = spark.createDataFrame([("xu2022", 1, "one"), ("xu2022", 2, "two"), ("9b", 1, "nine")], "key string, page int, text string")
    chunks = spark.createDataFrame([("xu2022", 1, 0, "one")], "key string, page int, chunk_index int, text string")
    archive.write(path, meta, pages, chunks)
    assert [r.key for r in archive.keys(spark, path).collect()] == ["9b", "Xa", "xu2022"]
    assert [(r.page, r.text) for r in archive.read(spark, path, "pages", "xu2022").orderBy("page").collect()] == [(1, "one"), (2, "two")]
    archive.patch(spark, path, spark.createDataFrame([("Xa", "New", None), ("none", "x", None)], "key string, title string, doi string"))
    archive.write(path, meta.where("key = 'xu2022'").withColumn("title", F.lit("Again")), spark.createDataFrame([("xu2022", 1, "only")], pages.schema))
    got = {r.key: (r.title, r.doi, r.page_count) for r in archive.catalogue(spark, path).collect()}
    assert got == {"xu2022": ("Again", "10.1/a", 1), "Xa": ("New", None, 0), "9b": (None, "10.1/b", 1)}
    old = spark.createDataFrame([("h1", "xu2022", "10.1/a", "2023")], "content_hash string, key string, doi string, ingested_at string")
    new = spark.createDataFrame([("h1", "renamed", "10.1/a"), ("h9", "fresh", None)], "content_hash string, key string, doi string")
    assert sorted(tuple(r) for r in archive.upsert(old, new, "2024").collect()) == [("h1", "renamed", "10.1/a", "2023"), ("h9", "fresh", None, "2024")]
    with pytest.raises(catalog.DuplicateKey):
        archive.upsert(old, spark.createDataFrame([("h9", "xu2022", None)], new.schema), "2024")
    archive.remove(spark, path, "xu2022")
    assert [r.key for r in archive.keys(spark, path).collect()] == ["9b", "Xa"] and archive.read(spark, path, "chunks").count() == 0
    assert archive.drop(spark, path + "/chunks") and not archive.drop(spark, path + "/chunks")
    links = spark.createDataFrame([("p", "h1", 1)], "project_id string, content_hash string, added_at int")
    linked = archive.link(links, spark.createDataFrame([("p", "h1", 5), ("p", "h1", 4), ("q", "h1", 2)], links.schema))
    assert sorted(tuple(r) for r in linked.collect()) == [("p", "h1", 5), ("q", "h1", 2)] and archive.unlink(linked, "p", "h1").count() == 1


def test_corpus_sync_and_search(spark, tmp_path):
    index = str(tmp_path / "index")
    schema = "file string, sha256 string, text string"
    first = spark.createDataFrame([("a.tex", "1", "One. Two."), ("b.tex", "1", "Three."), ("c.md", "1", "Four.")], schema)
    assert ingest.sync_corpus(spark, first, index, block=2) == {"added": 3}
    second = spark.createDataFrame([("a.tex", "1", "One. Two."), ("b.tex", "2", "Changed."), ("d.tex", "1", "New.")], schema)
    assert ingest.sync_corpus(spark, second, index, block=1) == {"unchanged": 1, "changed": 1, "added": 1, "removed": 1}
    assert sorted((r.file, r.sha256, r.text) for r in ingest.read_index(spark, index).collect()) == [("a.tex", "1", "One. Two."), ("b.tex", "2", "Changed."), ("d.tex", "1", "New.")]
    files = spark.createDataFrame([("s/a.tex", "The \\textbf{bold}  claim\nnext"), ("t.md", "bold claim")], "file string, text string")
    assert [(r.file, r.line_start, r.context) for r in search.corpus_search(files, "Bold claim", ["s/*.tex"], 1).collect()] == [("s/a.tex", 1, "The \\textbf{bold}  claim\nnext")]
    with pytest.raises(LookupError):
        search.corpus_search(files, "x", ["*.py"])
