"""Search of pasted text in whole source files against a walk over each file."""

import random

import pytest
from pyspark.sql import functions as F

from parchmint.functions import text as tx
from parchmint.operators import search


def walk(raw, norm, needle, around):
    lines, out, at = raw.splitlines(keepends=True), [], -1
    while needle and (at := norm.find(needle, at + 1)) >= 0:
        ratio = len(raw) / max(len(norm), 1)
        first = raw[: int(at * ratio)].count("\n") + 1
        last = raw[: min(int((at + len(needle)) * ratio), len(raw) - 1)].count("\n") + 1
        out.append((first, last, "".join(lines[max(0, first - 1 - around) : min(len(lines), last + around)]).strip()))
    return out


@pytest.mark.parametrize(("query", "around"), [("bold claim", 3), ("and so\non", 1), ("o", 0), ("nowhere", 3), ("", 3)])
def test_hits_across_lines(spark, query, around):
    r = random.Random(3)
    parts = [r"\textbf{bold}", "claim", "bold claim", "and", "so", "on", "\n", "\n", "\n\n", r"% a comment \n", r"\cite{x}", "é", r"\section{Bold" + "\n", "}"]
    files = [(f"f{k}.tex", " ".join(r.choice(parts) for _ in range(r.randrange(1, 120)))) for k in range(25)]
    files += [("wrap.tex", "The \\textbf{bold}\nclaim\nis made"), ("empty.tex", ""), ("null.tex", None), ("long.tex", "word and\nso\non " * 3000)]
    df = spark.createDataFrame(files, "file string, text string")
    norms = {x.file: x.n for x in df.select("file", tx.normalize_markup(F.col("text")).alias("n")).collect()}
    want = sorted((f, i, *h) for f, t in files if t for i, h in enumerate(walk(t, norms[f], tx.normal_form(query), around)))
    got = sorted((x.file, x.hit, x.line_start, x.line_end, x.context) for x in search.find_in_files(df, query, around).collect())
    assert got == want
    if query == "bold claim":
        assert any(f == "wrap.tex" and last > first for f, _, first, last, _ in got)
        assert search.find_in_files(df, query, around, limit=2).count() == 2


def test_hunks_of_any_size(spark):
    from parchmint.operators import structure

    text = ["--- a/x", "+++ b/x", "@@ -1,3 +1000000,4 @@ title", " same", "+new", "++", "+++ not a header to us", "-old", "@@ no hunk", "@@ -99999999999 +20 @@", "-gone", "--- gone"]
    lines = spark.createDataFrame([("x", i, t) for i, t in enumerate(text)], "file string, line int, text string")
    hunks = structure.diff_hunks(lines)
    assert sorted(map(tuple, hunks.collect())) == [("x", 1, 1000000, 4, 1, 3, 2, 1), ("x", 2, 20, 1, 99999999999, 1, 0, 1)]
    assert sorted(map(tuple, structure.diff_totals(hunks).collect()), key=str) == [("x", 2, 2, 2), (None, 2, 2, 2)]


def test_semantic_chunks_by_page(spark):
    """Offsets are those of the stripped page; a chunk ends where neighbours differ or grow too long."""
    from parchmint.functions import register

    embed = register.hashing_embedder(64)
    pages = [("p", 1, "  One two three. One two four. Moss and fern grow. Moss and fern die.  "), ("p", 2, ""), ("q", 1, None), (None, 3, "Only one."), ("q", 2, "A b c. " * 40)]
    df = spark.createDataFrame(pages, "key string, page int, text string")
    got = {}
    for r in sorted(register.semantic_pages(df, "key", "page", "text", embed, 12, 0.2).collect(), key=lambda r: r.chunk_index):
        got.setdefault((r.key, r.page), []).append(r)
    assert set(got) == {("p", 1), (None, 3), ("q", 2)}
    for key, page, text in pages:
        for i, r in enumerate(got.get((key, page), [])):
            t = text.strip()
            assert r.chunk_index == i and t[r.char_start : r.char_end] == r.text and len(r.text.split()) <= 12
            said = [x + "." for x in r.text.rstrip(".").split(". ")]
            v = embed(said)
            assert all(float(a @ b) >= 0.2 for a, b in zip(v, v[1:], strict=False))
    assert [r.text for r in got["p", 1]] == ["One two three. One two four.", "Moss and fern grow. Moss and fern die."]
    assert "".join(r.text.replace(" ", "") for r in got["q", 2]) == "Abc." * 40
