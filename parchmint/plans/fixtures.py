"""Small inline tables that Spark and DuckDB read alike: the rows are SQL ``VALUES``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES: dict[str, tuple[str, str]] = {
    "tex_lines": (
        "file, line, text",
        r"""('main.tex', 1, '\documentclass{book}'), ('main.tex', 2, '\input{sections/intro}'), ('main.tex', 3, '% \input{sections/old}'),
        ('main.tex', 4, '\include{sections/method.tex}'), ('sections/intro.tex', 1, '\section{Introduction}\label{sec:intro}'),
        ('sections/intro.tex', 2, 'As \cite{xu2022,chen2023} show, see Figure~\ref{fig:one} and \eqref{eq:none}.'), ('sections/intro.tex', 5, '\cite[p.~3]{optional} \citealp{other} \citeqm{chen2023}\index{noise!shot}'),
        ('sections/intro.tex', 3, 'Again \cite{xu2022} and $x^2$ holds.'), ('sections/intro.tex', 4, '% \cite{hidden2000} \label{fig:hidden}'),
        ('sections/method.tex', 1, '\section{Method}\label{sec:method}'), ('sections/method.tex', 2, '\mciteboxp{chen2023} \citep{xu2022} \label{fig:one}'),
        ('sections/method.tex', 3, 'By \ref{sec:intro} and \citeq{chen2023}, \cite{chen2023}.'), ('appendix/extra.tex', 1, '\label{tab:extra} \textbf{bold} words')""",
    ),
    "tex_edges": ("parent, child, ord", "('main', 'intro', 1), ('main', 'method', 2), ('method', 'data', 1), ('data', 'main', 1), ('intro', 'data', 1), ('method', 'gone', 2)"),
    "toc_flat": (
        "ord, level, depth, number, title, page, file, line",
        """(1, 'part', 0, 'I', 'Ground', 1, 'main.tex', 2), (2, 'chapter', 1, '1', 'Start', 3, 'a.tex', 1), (3, 'section', 2, '1.1', 'First', 4, 'a.tex', 10),
        (4, 'subsection', 3, '1.1.1', 'Detail', 5, 'a.tex', 20), (5, 'section', 2, '1.2', 'Second', 7, 'a.tex', 40), (6, 'chapter', 1, '2', 'Next', 9, 'b.tex', 1),
        (7, 'subsection', 3, '2.0.1', 'Skipped', 10, 'b.tex', 5), (8, 'section', 2, '2.1', 'Later', 12, 'b.tex', 30), (9, 'part', 0, 'II', 'End', 20, 'main.tex', 8)""",
    ),
    "floats": ("kind, number, page, file, line", "('figure', '1.1', 4, 'a.tex', 12), ('figure', '1.2', 8, '', 0), ('table', '2.1', 11, 'b.tex', 6), ('table', '2.2', 30, '', 0)"),
    "explorations": (
        "s2_id, parent, depth, relevance, year",
        """('seed1', NULL, 0, 'relevant', 2020), ('child1', 'seed1', 1, 'relevant', 2021), ('child2', 'seed1', 1, 'irrelevant', 2022),
        ('grand', 'child1', 2, 'relevant', 2023), ('loop1', 'loop2', 1, 'relevant', 2019), ('loop2', 'loop1', 2, 'unknown', 2018), ('seed2', NULL, 0, 'unknown', 2017)""",
    ),
    "bib_keys": ("key", "('xu2022'), ('xu2022_errata_1'), ('xu2022_retraction'), ('chen2023'), ('chen2023_reply_2'), ('lone2020_comment'), ('smith2001_addendum')"),
    "api_cache": (
        "service, kind, identifier, fetched_at, ttl_days, bytes",
        """('s2', 'paper', 'a', '2024-01-01 00:00:00', 30, 100), ('s2', 'paper', 'b', '2024-02-20 00:00:00', 30, 250), ('s2', 'cites', 'a', 'not a date', 7, 40),
        ('crossref', 'work', '10.1/x', '2024-02-01 12:00:00', 28, 900), ('crossref', 'work', '10.1/y', NULL, 28, 10), ('oa', 'work', 'w1', '2023-02-01 00:00:00', 365, 77)""",
    ),
    "first_source": ("ord, doi, title", "(1, '10.1/A', 'Alpha'), (2, NULL, 'No identifier'), (3, '10.1/c', 'Gamma'), (4, '10.1/e', 'Epsilon')"),
    "second_source": ("ord, doi, title, is_oa", "(1, '10.1/a', 'Alpha again', true), (2, '10.1/B', 'Beta', false), (3, NULL, 'Open only', true), (4, '10.1/C', 'Gamma again', false)"),
    "idx_entries": (
        "term, subterm, page, see_target",
        """('Entropy', NULL, 12, NULL), ('Entropy', NULL, 3, NULL), ('Entropy', 'relative', 7, NULL), ('entropy rate', NULL, 9, NULL), ('Divergence', NULL, 1, 'Entropy'),
        ('Bound', 'entropy bound', 4, NULL), ('Bound', NULL, 4, NULL), ('Bound', NULL, 4, NULL)""",
    ),
    "file_state": ("path, now, was", "('a.tex', 10, 10), ('b.tex', 11, 10), ('c.tex', 12, NULL), ('d.tex', NULL, 9)"),
    "diff_lines": (
        "file, line, text",
        """('a.tex', 1, '--- a/a.tex'), ('a.tex', 2, '@@ -1,3 +1,4 @@'), ('a.tex', 3, ' same'), ('a.tex', 4, '+new'), ('a.tex', 5, '-old'), ('a.tex', 6, '+more'),
        ('a.tex', 7, '@@ -20 +21,2 @@'), ('a.tex', 8, '+tail'), ('b.tex', 1, '@@ -5,2 +5 @@'), ('b.tex', 2, '-gone')""",
    ),
    "meta_files": (
        "file, text",
        """('a.tex', 'Text.\n% === META ===\n% Status: draft\n% Owner: me  \n% no field here\n% Due-Date: 2024-05-01\nmore\n% Late: x\n'), ('b.tex', 'No block\n% Status: none\n')""",
    ),
    "ids": (
        "id",
        r"""('xu2022'), ('xu2022:page3'), ('xu2022:fig2a'), ('xu2022:fig-2'), ('xu2022:fig'), ('a:fig1:page2'), ('10.1000/182'), ('10.1000/182:page7'), ('0123456789abcdef0123456789abcdef01234567'), ('0123456789ABCDEF'), ('a/b'), ('')""",
    ),
    "terms": ("term", r"""('§3.1'), ('2.4'), ('xu2022'), ('\label{fig:a}'), ('\ref{x}'), ('sections/a.tex'), ('%TODO'), ('\fixme'), ('quantum noise'), ('¶ 7'), ('3'), ('\label{x2020}'), ('K_9-2021x')"""),
    "keys": ("key", r"""('xu2022'), ('../etc'), ('a/b'), ('a\b'), ('-dash'), ('ok.key_1-2'), (''), ('Ünder'), ('what:is*this?'), ('9lives')"""),
    "dois": (
        "id, text",
        """(1, 'See doi:10.1103/PhysRevLett.1.2.'), (2, 'https://doi.org/10.1000/abc(1);'), (3, 'bare 10.5555/12345678, then'), (4, 'none here'), (5, 'first 10.1/no 10.1234/yes] x'), (6, 'DOI 10.1016/j.x.2020.01.001),'), (7, 'doi:10.1234/a;b'), (8, 'https://dx.doi.org/10.1234/Q"x'), (9, 'doi10.1234/near')""",
    ),
    "labels_named": ("label", "('fig:a'), ('tab:b'), ('eq:c'), ('sec:d'), ('ch:e'), ('app:f'), ('thm:g'), ('figure'), ('subsec:h'), ('para:i'), ('part:j'), ('fig')"),
    "titles": (
        "id, title",
        """(1, 'Erratum: On Noise'), (2, 'Errata for chapter 2'), (3, 'Retraction and corrigendum'), (4, 'Corrigendum to X'), (5, 'Addendum: data'), (6, 'Comment on Y'), (7, 'A plain title'),
        (8, 'The Quantum Measurement of Things'), (9, 'On the art of new war'), (10, 'An'), (11, 'Deep learning for graphs'), (12, 'Deep learning for trees'), (13, 'Deep learning for grass'), (14, 'Étude über Größen'), (15, 'Retracted: a withdrawal'), (16, 'Response to critics')""",
    ),
    "papers_a": ("id, title, names, year", "(1, 'Noise in quantum dots', 'xu,chen', 2022), (2, 'Graph entropy bounds', 'smith', 2001), (3, 'An of', 'lee', 1999)"),
    "papers_b": ("id, title, names, year", "(7, 'Quantum dots and noise', 'chen,xu', 2022), (8, 'Entropy of graphs', 'jones', 2001), (9, 'Unrelated topic', 'lee', 2005)"),
    "rejected": ("doi, reason", "('10.1/A ', 'withdrawn'), ('10.1/z', 'fake')"),
    "summaries": ("file, updated", "('a.tex', '2024-01-05 00:00:00'), ('b.tex', '2024-01-01 00:00:00'), ('c.tex', 'unknown')"),
    "commits": ("file, made", "('a.tex', '2024-01-02 00:00:00'), ('b.tex', '2024-01-02 00:00:00'), ('b.tex', '2024-01-03 00:00:00'), ('d.tex', '2024-01-03 00:00:00')"),
    "issues": ("n, heading", "(1, '## Search is slow'), (2, '## [RESOLVED] Crash'), (3, 'no heading'), (7, '## Wrong page')"),
    "guides": ("slug, description", "('paper-search', 'find papers'), ('paper', 'one paper'), ('doc-search', 'find in the paper text'), ('notes', 'keep notes')"),
    "meta_sources": (
        "id, crossref, s2, xmp, font, pdf",
        "(1, 'C', 'S', NULL, NULL, 'P'), (2, NULL, ' ', 'X', 'F', NULL), (3, NULL, NULL, NULL, NULL, 'pdf1'), (4, '', NULL, NULL, 'Font', 'P'), (5, NULL, NULL, NULL, NULL, NULL)",
    ),
    "packages": ("name", "('mystyle'), ('amsmath'), ('bookish')"),
    "local_files": ("file", "('mystyle.sty'), ('tex/bookish.cls'), ('main.tex'), ('sections/intro.tex'), ('sections/method.tex'), ('sections/stray.tex'), ('appendix/extra.tex')"),
    "spans": ("doc, size, y, text", "(1, 18.0, 10.0, 'A Large'), (1, 17.5, 20.0, 'Title Here'), (1, 10.0, 30.0, 'body text'), (1, 18.0, 5.0, 'x'), (2, 12.0, 1.0, 'Short'), (2, 11.5, 2.0, 'y')"),
}


def table(spark: SparkSession, name: str, sf: str | None = None) -> DataFrame:
    """The inline rows, and with ``sf`` those derived from shipped tables."""
    columns, rows = TABLES[name]
    text = f"SELECT * FROM VALUES {_spark(rows)} AS t({columns})"
    if sf is not None and name in DERIVED:
        text += " UNION ALL " + DERIVED[name].format_map({t: f"parquet.`{sf}/{t}.parquet`" for t in SHIPPED})
    return spark.sql(text)


def _spark(rows: str) -> str:
    # Spark reads backslashes in literals as escapes (newlines are meant as such in both)
    return rows.replace("\\", "\\\\") if "\\" in rows and "\n%" not in rows else rows


def sql(*names: str) -> str:
    """``WITH`` clauses for DuckDB."""
    parts = []
    for n in names:
        derived = " UNION ALL " + DERIVED[n].format_map({t: t for t in SHIPPED}) if n in DERIVED else ""
        parts.append(f"{n}({TABLES[n][0]}) AS (VALUES {TABLES[n][1]}{derived})")
    return "WITH RECURSIVE " + ", ".join(parts) + " "


SHIPPED = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_B, _K = "chr(92)", "CAST({} AS STRING)".format
#: Rows that both engines derive from shipped tables in the same words, so that every query runs over as many rows as there are.
DERIVED: dict[str, str] = {
    "tex_edges": f"""SELECT CASE WHEN p_partkey < 8 THEN 'main' ELSE 'n' || {_K('CAST(floor(p_partkey / 8) AS INT)')} END, 'n' || {_K('p_partkey')}, CAST(3 + p_partkey % 8 AS INT) FROM {{part}}
        UNION ALL SELECT 'n' || {_K('p_partkey')}, 'n' || {_K('p_partkey * 9')}, CAST(20 + p_partkey % 8 AS INT) FROM {{part}} WHERE p_partkey % 5 = 0""",
    "tex_lines": f"""SELECT 'sections/s' || {_K('o_orderkey % 97')} || '.tex', CAST(100 + o_orderkey AS INT), CASE o_orderkey % 9
        WHEN 0 THEN {_B} || 'section{{{{Part ' || {_K('o_orderkey')} || '}}}}' || {_B} || 'label{{{{sec:' || {_K('o_orderkey')} || '}}}}'
        WHEN 1 THEN 'As ' || {_B} || 'cite{{{{k' || {_K('o_custkey % 50')} || ', k' || {_K('o_custkey % 7')} || ',}}}} and ' || {_B} || 'citealp{{{{no}}}} show'
        WHEN 2 THEN 'In Figure~' || {_B} || 'ref{{{{fig:' || {_K('o_custkey % 300')} || '}}}} and ' || {_B} || 'eqref{{{{eq:' || {_K('o_custkey % 9')} || '}}}}'
        WHEN 3 THEN '  % ' || {_B} || 'cite{{{{hidden}}}} ' || {_B} || 'input{{{{gone}}}}'
        WHEN 4 THEN {_B} || 'citeqp{{{{k' || {_K('o_custkey % 11')} || '}}}} ' || {_B} || 'index{{{{term ' || {_K('o_custkey % 5')} || '}}}}'
        WHEN 5 THEN {_B} || 'label{{{{fig:' || {_K('o_custkey % 400')} || '}}}} ' || {_B} || 'textbf{{{{bold ' || {_B} || 'emph{{{{words}}}} here}}}}'
        WHEN 6 THEN 'plain words $x_1$ and {{{{braces}}}} of ' || {_K('o_custkey')}
        WHEN 7 THEN {_B} || 'input{{{{sections/s' || {_K('(o_orderkey + 1) % 97')} || '}}}}' ELSE '' END FROM {{orders}}""".replace("{{{{", "{{").replace("}}}}", "}}"),
    "ids": f"""SELECT CASE doc_id % 7 WHEN 0 THEN 'slug' || {_K('doc_id')} || ':page' || {_K('doc_id % 9')} WHEN 1 THEN 'slug' || {_K('doc_id')} || ':fig' || {_K('doc_id % 5')} || 'a'
        WHEN 2 THEN '10.1000/' || {_K('doc_id')} WHEN 3 THEN md5(text) || left(md5(source), 8) WHEN 4 THEN 'slug' || {_K('doc_id')} || ':fig-' || {_K('doc_id')}
        WHEN 5 THEN '10.1000/' || {_K('doc_id')} || ':page' || {_K('doc_id % 3')} ELSE source || {_K('doc_id')} END FROM {{documents}}""",
    "terms": f"""SELECT CASE doc_id % 8 WHEN 0 THEN '§' || {_K('doc_id')} WHEN 1 THEN {_K('doc_id % 9')} || '.' || {_K('doc_id % 4')} WHEN 2 THEN lang || '_Key-' || {_K('doc_id + 1000')} || 'b' WHEN 3 THEN {_B} || 'label{{{{fig:' || {_K('doc_id')} || '}}}}'
        WHEN 4 THEN 'sections/' || source || '.tex' WHEN 5 THEN '%' || lang WHEN 6 THEN '¶ ' || {_K('doc_id')} ELSE left(text, 20) END FROM {{documents}}""".replace("{{{{", "{{").replace("}}}}", "}}"),
    "keys": f"SELECT CASE doc_id % 5 WHEN 0 THEN source || '/' || {_K('doc_id')} WHEN 1 THEN lang || '..' || {_K('doc_id')} WHEN 2 THEN source || '_' || {_K('doc_id')} WHEN 3 THEN left(text, 130) ELSE upper(lang) || ':' || {_K('doc_id')} END FROM {{documents}}",
    "dois": f"""SELECT CAST(1000 + doc_id AS INT), CASE doc_id % 5 WHEN 0 THEN left(text, 40) || ' doi: 10.1000/' || source || {_K('doc_id')} || ').' WHEN 1 THEN 'see https://dx.doi.org/10.12345/x' || {_K('doc_id')} || ',y and more'
        WHEN 2 THEN 'bare 10.5555/' || {_K('doc_id')} || '];' WHEN 3 THEN 'DOI10.1103/' || lang || '.' || {_K('doc_id')} || '.' ELSE left(text, 60) END FROM {{documents}}""",
    "labels_named": f"SELECT CASE doc_id % 6 WHEN 0 THEN 'subsec:' WHEN 1 THEN 'para:' WHEN 2 THEN 'part:' WHEN 3 THEN 'ch:' WHEN 4 THEN 'eq:' ELSE 'lemma-' END || {_K('doc_id')} FROM {{documents}}",
    "titles": f"""SELECT CAST(1000 + doc_id AS INT), CASE doc_id % 9 WHEN 0 THEN 'Withdrawal: ' WHEN 1 THEN 'Correction to ' WHEN 2 THEN 'Supplement to ' WHEN 3 THEN 'Reply to ' WHEN 4 THEN 'A Comprehensive Study of ' WHEN 5 THEN 'The ' ELSE '' END
        || left(text, 60) FROM {{documents}}""",
    "authors": f"SELECT CAST(1000 + c_custkey AS INT), CASE c_custkey % 4 WHEN 0 THEN 'Xu' || {_K('c_custkey')} || ', Ada, Jr' WHEN 1 THEN 'Ada M. Xu' || {_K('c_custkey')} WHEN 2 THEN '  ' || c_name || ' ' ELSE 'van Dyck ' || {_K('c_custkey')} || ',' END FROM {{customer}}",
    "bib_keys": f"SELECT DISTINCT 'k' || {_K('o_custkey % 400')} || CASE o_orderkey % 6 WHEN 0 THEN '_errata_' || {_K('o_orderkey % 3')} WHEN 1 THEN '_retraction' WHEN 2 THEN '_comment_errata' ELSE '' END FROM {{orders}}",
    "idx_entries": f"""SELECT 'Term ' || {_K('l_partkey % 500')}, CASE WHEN l_linenumber % 3 = 0 THEN 'entropy ' || {_K('l_suppkey % 9')} END, CAST(l_orderkey % 700 AS INT), CASE WHEN l_orderkey % 50 = 0 THEN 'Term ' || {_K('l_suppkey % 500')} END FROM {{lineitem}}""",
    "diff_lines": f"""SELECT 'd' || {_K('o_orderkey % 40')} || '.tex', CAST(100 + o_orderkey AS INT), CASE o_orderkey % 11 WHEN 0 THEN '@@ -' || {_K('o_orderkey')} || ',2 +' || {_K('o_custkey')} || ' @@' WHEN 1 THEN '+new' WHEN 2 THEN '-old' WHEN 3 THEN '+more' ELSE ' same' END FROM {{orders}}""",
    "api_cache": f"""SELECT CASE event_id % 3 WHEN 0 THEN 's2' WHEN 1 THEN 'crossref' ELSE 'oa' END, event_type, {_K('event_id')}, CASE WHEN event_id % 20 = 0 THEN 'not a date' ELSE CAST(ts AS STRING) END, CAST(user_id % 60 AS INT), CAST(event_id % 1000 AS INT) FROM {{events}}""",
    "file_state": f"SELECT source || '/' || {_K('doc_id')} || '.tex', CAST(CASE WHEN doc_id % 7 <> 0 THEN n_chars END AS INT), CAST(CASE WHEN doc_id % 3 <> 0 THEN n_chars + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END END AS INT) FROM {{documents}}",
    "meta_sources": f"""SELECT CAST(1000 + doc_id AS INT), CASE WHEN doc_id % 2 = 0 THEN left(text, 20) END, CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN source END, CASE WHEN doc_id % 5 = 0 THEN lang END, CAST(NULL AS STRING), CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'a longer pdf title' END FROM {{documents}}""",
    "explorations": f"""SELECT 'e' || {_K('o_orderkey')}, CASE WHEN o_orderkey % 10 = 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'seed1' END ELSE 'e' || {_K('o_orderkey - 1')} END, CAST(o_orderkey % 10 AS INT),
        CASE o_custkey % 4 WHEN 0 THEN 'relevant' WHEN 1 THEN 'irrelevant' WHEN 2 THEN 'deferred' ELSE 'unknown' END, CAST(1990 + o_orderkey % 35 AS INT) FROM {{orders}}""",
    "issues": f"SELECT CAST(10 + o_orderkey AS INT), CASE o_orderkey % 3 WHEN 0 THEN '## ' WHEN 1 THEN '## [RESOLVED] ' ELSE '' END || o_orderpriority FROM {{orders}}",
    "page_scores": f"SELECT 'd' || {_K('label')}, CAST(vec_id AS INT), CAST((vec_id % 97) / 100.0 AS DECIMAL(3, 2)) FROM {{embeddings}}",
    "commits": f"SELECT source || '.tex', '2024-01-' || lpad({_K('1 + doc_id % 28')}, 2, '0') || ' 00:00:00' FROM {{documents}}",
    "summaries": "SELECT DISTINCT source || '.tex', '2024-01-14 00:00:00' FROM {documents} WHERE source IS NOT NULL AND length(source) = 4",
    "spans": f"SELECT CAST(1000 + conv_id AS INT), CAST(10 + (turn * 7) % 5 AS DECIMAL(3, 1)), CAST(turn AS DECIMAL(3, 1)), left(text, 30) FROM {{conversations}}",
    "patches": f"""SELECT 'p' || {_K('p_partkey')}, CASE p_partkey % 4 WHEN 0 THEN '{{{{"title": "New ' || {_K('p_partkey')} || '"}}}}' WHEN 1 THEN '{{{{"doi": "10.1/' || {_K('p_partkey % 6')} || '"}}}}' WHEN 2 THEN 'broken' ELSE '{{{{"year": "2024"}}}}' END FROM {{part}}""".replace("{{{{", "{{").replace("}}}}", "}}"),
    "bib_rows": f"SELECT 'p' || {_K('p_partkey')}, p_name, '2020', CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '10.1/' || {_K('p_partkey % 5')} END, 'valid' FROM {{part}}",
}


TABLES |= {
    "caption_pages": (
        "key, page, text",
        """('p1', 1, 'Intro text that cites Fig. 1 twice, and Figure 2 once. More of it follows.'), ('p1', 2, 'Figure 1: The first setup with two mirrors. As seen in Fig. 1 the light bends.'),
        ('p1', 3, 'Figure 2. Results over time. End.'), ('p2', 1, 'No floats here, though Figure 9 is named.')""",
    ),
    "figures": ("key, figure, num, reason", "('p1', 'fig1', 1, 'setup'), ('p1', 'fig2', 2, 'curve'), ('p2', 'fig7', 7, 'lost')"),
    "freshness": ("kind, newest, built", "('corpus', 20, 10), ('build', 5, 9), ('bib', 7, 7), ('papers', NULL, NULL), ('inbox', 3, NULL), ('index', 4000, 100), ('old', 90000, 10)"),
    "authors": ("id, name", "(1, 'Xu, Ada'), (2, 'Ada Xu'), (3, 'Ada M. Xu'), (4, 'Plato'), (5, 'van Dyck, Anton'), (6, 'Smith, John, Jr.'), (7, ' '), (8, 'Lee,')"),
    "doi_candidates": ("id, title, names, year", "(1, 'Noise in quantum dots', 'xu,chen', 2022), (2, 'Quantum noise', 'lee', 2020), (3, 'Trees and graphs', 'smith', 2001)"),
    "patches": ("key, data", """('xu2022', '{"title": "New title", "doi": "10.1/new"}'), ('chen2023', '{"year": "2024"}'), ('bad', 'not json')"""),
    "bib_rows": ("key, title, year, doi, status", "('xu2022', 'Old', '2022', '10.1/old', 'valid'), ('chen2023', 'Kept', '2023', NULL, 'missing'), ('bad', 'Same', '2020', '10.1/b', 'valid')"),
    "page_scores": ("key, page, score", "('a', 1, 0.1), ('a', 2, 0.7), ('a', 3, 0.5), ('b', 1, 0.2), ('c', 1, 0.95), ('c', 2, 0.51)"),
}
