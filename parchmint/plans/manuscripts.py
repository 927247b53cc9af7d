"""Queries over manuscripts: facts, references, contents, figures, metadata blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchmint.functions import text as tx
from parchmint.operators import contents, figures, graph, search, simjoin, structure
from parchmint.plans.catalogue import _pages, _read, query
from parchmint.plans.fixtures import sql as fix
from parchmint.plans.fixtures import table
from parchmint.sources import readers

# Facts in DuckDB's words, from the rules: nine macros cite, five quote or name a place; comment lines hold nothing.
_FACTS = fix("tex_lines") + r""", n AS (SELECT file, line, text FROM tex_lines WHERE NOT regexp_matches(text, '^\s*%')),
lab AS (SELECT file, line, unnest(regexp_extract_all(text, '\\label\{([^}]+)\}', 1)) AS name FROM n),
rf AS (SELECT file, line, unnest(regexp_extract_all(text, '(Section|Table|Figure|Equation|Supplement|Appendix|Part)?[~\s]*\\(?:ref|autoref|cref|eqref)\{([^}]+)\}', 1)) AS w,
  unnest(regexp_extract_all(text, '(Section|Table|Figure|Equation|Supplement|Appendix|Part)?[~\s]*\\(?:ref|autoref|cref|eqref)\{([^}]+)\}', 2)) AS name FROM n),
ct0 AS (SELECT file, line, unnest(regexp_extract_all(text, '\\(cite|citep|citet|citeauthor|citeq|citeqp|citeqm|mcitebox|mciteboxp)\{([^}]+)\}', 1)) AS extra, unnest(regexp_extract_all(text, '\\(cite|citep|citet|citeauthor|citeq|citeqp|citeqm|mcitebox|mciteboxp)\{([^}]+)\}', 2)) AS ks FROM n),
ct AS (SELECT * FROM (SELECT file, line, extra, trim(unnest(string_split(ks, ','))) AS name FROM ct0) WHERE name <> ''),
sec AS (SELECT file, line, unnest(regexp_extract_all(text, '\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^}]*)\}', 1)) AS extra, unnest(regexp_extract_all(text, '\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^}]*)\}', 2)) AS name FROM n),
inp0 AS (SELECT file, line, unnest(regexp_extract_all(text, '\\(?:input|include)\{([^}]+)\}', 1)) AS name FROM n),
idx AS (SELECT file, line, unnest(regexp_extract_all(text, '\\index\{([^}]+)\}', 1)) AS name FROM n),
lastlab AS (SELECT file, line, list_extract(regexp_extract_all(text, '\\label\{([^}]+)\}', 1), -1) AS l FROM n),
carry AS (SELECT file, line, coalesce(last_value(l IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS near FROM lastlab),
facts0 AS (SELECT file, line, 'label' AS kind, name, CASE WHEN starts_with(name, 'sec:') THEN 'section' WHEN starts_with(name, 'subsec:') THEN 'subsection' WHEN starts_with(name, 'para:') THEN 'paragraph' WHEN starts_with(name, 'tab:') THEN 'table'
   WHEN starts_with(name, 'fig:') THEN 'figure' WHEN starts_with(name, 'eq:') THEN 'equation' WHEN starts_with(name, 'app:') THEN 'appendix' WHEN starts_with(name, 'part:') THEN 'part' ELSE 'unknown' END AS extra FROM lab
 UNION ALL SELECT file, line, 'ref', name, CASE WHEN w = '' OR w IS NULL THEN 'bare' ELSE w END FROM rf UNION ALL SELECT file, line, 'cite', name, extra FROM ct UNION ALL SELECT file, line, 'section', name, extra FROM sec
 UNION ALL SELECT file, line, 'input', CASE WHEN ends_with(name, '.tex') THEN name ELSE name || '.tex' END, NULL FROM inp0 UNION ALL SELECT file, line, 'index', name, NULL FROM idx),
facts AS (SELECT f.*, CASE WHEN kind IN ('ref', 'cite') THEN near END AS near FROM facts0 f JOIN carry USING (file, line))
"""
_DEEP = "('mciteboxp', 'mcitebox', 'citeqp', 'citeq', 'citeqm')"


def _facts(spark, sf):
    return structure.facts(table(spark, "tex_lines", sf))


@query(_FACTS + "SELECT file, line, kind, name, extra, near FROM facts")
def tex_facts(spark, sf):
    return _facts(spark, sf).drop("pos")


@query(_FACTS + "SELECT name, file, line FROM facts WHERE kind = 'ref' AND name NOT IN (SELECT name FROM facts WHERE kind = 'label')")
def undefined_refs(spark, sf):
    return structure.undefined_refs(_facts(spark, sf))


@query(_FACTS + "SELECT name, file, line FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY file DESC, line DESC) AS rn FROM facts WHERE kind = 'label') WHERE rn = 1 AND name NOT IN (SELECT name FROM facts WHERE kind = 'ref')")
def orphan_labels(spark, sf):
    return structure.orphan_labels(_facts(spark, sf))


@query(_FACTS + f"SELECT name, count(*) AS n, string_agg(DISTINCT file, ',' ORDER BY file) AS files FROM facts WHERE kind = 'cite' GROUP BY name HAVING count(*) >= 3 AND NOT bool_or(extra IN {_DEEP})")
def shallow_high_use(spark, sf):
    return structure.shallow_cites(_facts(spark, sf))


@query(_FACTS + "SELECT f.file, f.line, left(t.text, 200) AS context FROM facts f JOIN tex_lines t USING (file, line) WHERE kind = 'cite' AND name IN ('xu2022', 'k3')")
def cite_locations(spark, sf):
    return _facts(spark, sf).where("kind = 'cite' AND name IN ('xu2022', 'k3')").join(table(spark, "tex_lines", sf), ["file", "line"]).select("file", "line", F.left("text", F.lit(200)).alias("context"))


@query(_FACTS + "SELECT DISTINCT name FROM facts WHERE kind = 'cite' AND file IN (WITH RECURSIVE w(f) AS (SELECT 'main.tex' UNION SELECT name FROM facts JOIN w ON file = f WHERE kind = 'input') SELECT f FROM w)")
def document_cites(spark, sf):
    """All citations of a document: of every file that its root includes."""
    found = _facts(spark, sf)
    edges = found.where("kind = 'input'").groupBy(F.col("file").alias("parent"), F.col("name").alias("child")).agg(F.min("line").alias("ord"))
    files = graph.closure(edges, "main.tex")
    return found.where("kind = 'cite'").join(files.select(F.col("node").alias("file")), "file", "left_semi").select("name").distinct()


@query(_FACTS + "SELECT name AS label, file, line FROM facts WHERE kind = 'label' AND (starts_with(name, 'fig:1') OR name = 'sec:intro')")
def locate_labels(spark, sf):
    return _facts(spark, sf).where("kind = 'label' AND (startswith(name, 'fig:1') OR name = 'sec:intro')").select(F.col("name").alias("label"), "file", "line")


@query(fix("local_files") + ", tree(file) AS (VALUES ('main.tex'), ('sections/intro.tex'), ('sections/method.tex')) SELECT file FROM local_files WHERE file NOT IN (SELECT file FROM tree) AND regexp_extract(file, '^(.*)/[^/]*$', 1) IN (SELECT regexp_extract(file, '^(.*)/[^/]*$', 1) FROM tree WHERE contains(file, '/'))")
def orphan_files(spark, sf):
    return structure.orphan_files(table(spark, "local_files", sf), spark.sql("SELECT * FROM VALUES ('main.tex'), ('sections/intro.tex'), ('sections/method.tex') AS t(file)"))


@query(fix("tex_lines") + r""", x AS (SELECT file, line, text, trim(text) AS t FROM tex_lines),
y AS (SELECT file, line, array_to_string(list_filter(list(t) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), lambda s: s <> '' AND NOT starts_with(s, '%')), ' ') AS s FROM x)
SELECT file, line, CASE WHEN length(s) > 200 THEN left(s, 200) || '...' ELSE s END AS snippet FROM y""")
def context_snippets(spark, sf):
    return structure.snippets(table(spark, "tex_lines", sf))


@query(fix("tex_lines") + r""", h AS (SELECT file, line, regexp_extract(text, '\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^}]*)\}', 1) AS l, regexp_extract(text, '\\(part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^}]*)\}', 2) AS t FROM tex_lines)
SELECT file, line, CASE l WHEN 'part' THEN 'Part' WHEN 'chapter' THEN 'Ch' WHEN 'section' THEN '§' WHEN 'subsection' THEN '§§' WHEN 'subsubsection' THEN '§§§' ELSE '¶' END || ' ' || t AS heading FROM h WHERE l <> ''""")
def heading_map(spark, sf):
    return structure.heading_map(table(spark, "tex_lines", sf))


@query(fix("tex_lines") + r""", w AS (SELECT file, string_agg(text, E'\n' ORDER BY line) AS t FROM tex_lines GROUP BY file),
x AS (SELECT file, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?m)^\s*%.*$', '', 'g'), '\\[a-zA-Z]+\*?', ' ', 'g'), '[{}]', ' ', 'g'), '\$[^$]*\$', ' ', 'g'), E' \t\n') AS t FROM w)
SELECT file, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '\s+')) END::INT AS words FROM x""")
def tex_word_count(spark, sf):
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return table(spark, "tex_lines", sf).groupBy("file").agg(whole.alias("t")).select("file", tx.markup_word_count(F.col("t")).alias("words"))


def _unwrap(x: str) -> str:
    return rf"regexp_replace({x}, '\\(?:textbf|textit|textsf|texttt|textsc|textrm|emph|underline|textsubscript|textsuperscript|mbox|text|textcolor\{{[^}}]*\}})\{{([^}}]*)\}}', '\1', 'g')"


_PLAIN = r"regexp_replace(regexp_replace(text, '^%[^\n]*', '', 'g'), '([^\\])%[^\n]*', '\1', 'g')"
_PLAIN = rf"regexp_replace({_PLAIN}, '\\(?:cite[tp]?|mciteboxp?|citeqp?|ref|eqref|pageref|nameref|label|gls[p]?|Gls[p]?|acrshort|acrlong|acrfull|hyperref|hyperlink|hypertarget)(?:\[[^\]]*\])*(?:\{{[^}}]*\}})*', '', 'g')"
for _k in range(4):
    _PLAIN = _unwrap(_PLAIN)
_PLAIN = rf"translate(replace(regexp_replace({_PLAIN}, '\\[a-zA-Z@]+\*?', '', 'g'), '~', ' '), '{{}}$', '')"


@query(fix("tex_lines") + rf"SELECT file, line, trim(regexp_replace({_PLAIN}, '\s+', ' ', 'g')) AS plain FROM tex_lines")
def tex_plain_text(spark, sf):
    return table(spark, "tex_lines", sf).select("file", "line", tx.squeeze(tx.strip_markup(F.col("text"))).alias("plain"))


def _files(spark, sf):
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    return table(spark, "tex_lines", sf).groupBy("file").agg(whole.alias("text"))


_FOUND = _PLAIN.replace("text,", "raw,")


@query(fix("tex_lines") + rf""", f AS (SELECT file, string_agg(text, chr(10) ORDER BY line) AS raw FROM tex_lines GROUP BY file),
n AS (SELECT file, raw, lower(trim(regexp_replace({_FOUND}, '\s+', ' ', 'g'))) AS norm FROM f),
h AS (SELECT *, unnest(list_filter(range(1, length(norm) - 5), lambda i: substr(norm, i, 7) = 'here as')) AS pos FROM n WHERE contains(norm, 'here as')),
o AS (SELECT file, raw, row_number() OVER (PARTITION BY file ORDER BY pos) - 1 AS hit, floor((pos - 1) * (length(raw) / length(norm)))::BIGINT AS a, least(floor((pos + 6) * (length(raw) / length(norm)))::BIGINT, length(raw) - 1) AS z FROM h),
l AS (SELECT file, raw, hit, 1 + length(substr(raw, 1, a)) - length(replace(substr(raw, 1, a), chr(10), '')) AS line_start, 1 + length(substr(raw, 1, z)) - length(replace(substr(raw, 1, z), chr(10), '')) AS line_end FROM o)
SELECT file, hit::INT AS hit, line_start::INT AS line_start, line_end::INT AS line_end, regexp_replace(array_to_string(string_split(raw, chr(10))[greatest(1, line_start - 3):line_end + 3], chr(10)), '^\s+|\s+$', '', 'g') AS context FROM l""")
def grep_tex_lines(spark, sf):
    """A phrase that may wrap over lines, in whole normalised files, with the lines of the source around each hit."""
    return search.find_in_files(_files(spark, sf), "Here\nas", 3)


@query(fix("tex_lines") + r""", g AS (SELECT file, string_agg(text, E'\n' ORDER BY line) AS text, floor(line / 2000)::BIGINT AS chunk FROM tex_lines GROUP BY file, floor(line / 2000)),
x AS (SELECT *, list_filter(list_transform(string_split(text, E'\n'), lambda s: trim(s)), lambda s: s <> '') AS ls, regexp_extract_all(text, '\\(?:eq|auto|c|page)?ref\{([^}]+)\}', 1) AS r,
 list_concat(list_filter(flatten(list_transform(regexp_extract_all(text, '\\cite[a-z]*\{([^}]+)\}', 1), lambda k: list_transform(string_split(k, ','), lambda y: trim(y)))), lambda y: y <> ''), regexp_extract_all(text, '\\mciteboxp?\{([^}]+)\}', 1)) AS c FROM g)
SELECT file, chunk, regexp_extract_all(text, '\\label\{([^}]+)\}', 1) AS labels, list_filter(r, lambda y, i: list_position(r, y) = i) AS refs, list_filter(c, lambda y, i: list_position(c, y) = i) AS cites,
 regexp_extract_all(text, '\\(?:part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^}]+)\}', 1) AS sections,
 CASE WHEN len(ls) > 0 THEN len(list_filter(ls, lambda s: starts_with(s, '%'))) / len(ls) ELSE 0.0 END::DOUBLE AS comment_ratio FROM x""")
def chunk_markers(spark, sf):
    own = table(spark, "tex_lines", sf).withColumn("chunk", F.floor(F.col("line") / 2000)).groupBy("file", "chunk")
    whole = own.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text")).withColumn("id", F.struct("file", "chunk"))
    return structure.markers(whole, "id", "text").select("id.file", "id.chunk", "labels", "refs", "cites", "sections", "comment_ratio")


@query(fix("tex_lines") + r""", l AS (SELECT file, line, unnest(regexp_extract_all(text, '\\label\{([^}]+)\}', 1)) AS label, unnest(range(1, len(regexp_extract_all(text, '\\label\{([^}]+)\}', 1)) + 1)) AS pos FROM tex_lines WHERE contains(text, '\label'))
SELECT file, trim(label) AS label FROM l QUALIFY row_number() OVER (PARTITION BY trim(label) ORDER BY file, line, pos) = 1""")
def all_labels(spark, sf):
    t = table(spark, "tex_lines", sf).select("file", F.col("line").alias("chunk"), F.array_join(F.regexp_extract_all("text", F.lit(r"\\label\{([^}]+)\}"), 1), ",").alias("labels"))
    return structure.all_labels(t.where("labels <> ''"))


# --- contents ------------------------------------------------------------------------------------------------------------

# A table of contents for each nation: parts, sections and so on by order keys; lines as a build leaves them.
_TOC_SQL = """SELECT 'n' || {k1} || '.toc' AS file, CAST(o_orderkey AS INT) AS line, chr(92) || 'contentsline {{' || CASE CAST(o_orderkey AS INT) % 11 WHEN 0 THEN 'part' WHEN 1 THEN 'section' WHEN 6 THEN 'section' WHEN 2 THEN 'subsection' WHEN 4 THEN 'subsection' WHEN 5 THEN 'odd'
 WHEN 7 THEN 'subsubsection' WHEN 8 THEN 'paragraph' ELSE 'subsection' END || '}}{{' || CASE CAST(o_orderkey AS INT) % 11 WHEN 0 THEN 'IV ' ELSE chr(92) || 'numberline {{' || {k2} || '.' || {k3} || '}}' END
 || 'On ' || chr(92) || 'emph {{' || o_orderpriority || '}}~' || {k4} || chr(92) || 'fileinfo {{./s' || {k3} || '.tex}}{{' || {k4} || '}}}}{{' || CASE WHEN o_orderkey % 13 = 0 THEN 'xii' ELSE {k5} END || '}}{{section.' || {k4} || '}}%' AS text FROM {orders}"""


def _toc_sql(orders: str) -> str:
    k = "CAST({} AS STRING)".format
    return _TOC_SQL.format(k1=k("o_custkey % 20"), k2=k("o_custkey % 9"), k3=k("o_custkey % 4"), k4=k("o_orderkey"), k5=k("o_orderkey % 300"), orders=orders)


def _toc(spark, sf):
    # lines are small in bytes and dear to parse: a file of few row groups would be parsed by few tasks
    return contents.tree(readers.toc_lines(simjoin.spread(spark.sql(_toc_sql(f"parquet.`{sf}/orders.parquet`")))))


_TOC = rf"""WITH RECURSIVE t0 AS ({_toc_sql("orders")}), t1 AS (SELECT file AS doc, line AS ord, regexp_extract(text, '^\\contentsline \{{(\w+)\}}', 1) AS level, regexp_extract(text, 'numberline \{{([^}}]*)\}}', 1) AS num, regexp_extract(text, 'emph \{{([^}}]*)\}}~(\d+)', 1) AS pri,
 regexp_extract(text, 'emph \{{([^}}]*)\}}~(\d+)', 2) AS id, regexp_extract(text, 'info \{{\./([^}}]*)\}}\{{(\d+)\}}', 1) AS file, regexp_extract(text, 'info \{{\./([^}}]*)\}}\{{(\d+)\}}', 2)::INT AS line, coalesce(try_cast(regexp_extract(text, '\}}\}}\{{([^}}]*)\}}\{{section', 1) AS INT), 0) AS page FROM t0),
t AS (SELECT doc, ord, level, CASE level WHEN 'part' THEN 0 WHEN 'section' THEN 1 WHEN 'subsection' THEN 2 WHEN 'subsubsection' THEN 3 WHEN 'paragraph' THEN 4 END AS depth, CASE WHEN level = 'part' THEN 'IV' ELSE num END AS number, 'On ' || pri || ' ' || id AS title, page, 'section.' || id AS anchor, file, line FROM t1 WHERE level <> 'odd'),
p AS (SELECT a.*, (SELECT max(b.ord) FROM t b WHERE b.doc = a.doc AND b.ord < a.ord AND b.depth < a.depth) AS parent FROM t a),
up(doc, ord, anc) AS (SELECT doc, ord, parent FROM p WHERE parent IS NOT NULL UNION ALL SELECT up.doc, up.ord, p.parent FROM up JOIN p ON p.doc = up.doc AND p.ord = up.anc WHERE p.parent IS NOT NULL)
"""


@query(_TOC + "SELECT doc, ord, level, depth, number, title, page, anchor, file, line, parent FROM p")
def toc_hierarchy(spark, sf):
    return _toc(spark, sf).select("doc", "ord", "level", "depth", "number", "title", "page", "anchor", "file", "line", "parent")


@query(_TOC + "SELECT p.doc, p.ord, (SELECT count(*) FROM up WHERE up.doc = p.doc AND up.anc = p.ord) AS below FROM p")
def toc_subtree_counts(spark, sf):
    return contents.descendants(_toc(spark, sf)).select("doc", "ord", "below")


@query(_TOC + """, q AS (SELECT doc, ord FROM p WHERE contains(lower(title), 'urgent') OR contains(number, '2.1')), q2 AS (SELECT doc, ord FROM q UNION SELECT up.doc, anc FROM up JOIN q USING (doc, ord)),
g AS (SELECT doc, ord FROM p WHERE page BETWEEN 50 AND 150), g2 AS (SELECT doc, ord FROM g UNION SELECT up.doc, anc FROM up JOIN g USING (doc, ord)),
f AS (SELECT doc, ord FROM p WHERE contains(file, 's2') OR contains(file, 's1')), f2 AS (SELECT doc, ord FROM p WHERE contains(file, '.tex')) SELECT doc, ord FROM q2 JOIN g2 USING (doc, ord)""".replace("contains(lower(title), 'urgent') OR contains(number, '2.1')", "contains(lower(title), '1-urgent')"))
def toc_filtered(spark, sf):
    """Entries that all filters show: those that match or have a match below."""
    return contents.matched(_toc(spark, sf), query="§1-URGENT", file=".tex", pages=(50, 150))


@query(_TOC + ", root AS (SELECT p.doc, p.ord, coalesce((SELECT min(anc) FROM up WHERE up.doc = p.doc AND up.ord = p.ord), p.ord) AS r FROM p) SELECT root.doc, root.ord FROM root JOIN p a ON a.doc = root.doc AND a.ord = root.r WHERE a.level = 'part' AND a.parent IS NULL")
def toc_part(spark, sf):
    return contents.of_part(_toc(spark, sf), "IV").select("doc", "ord")


@query(_TOC + """, x AS (SELECT CASE WHEN o_custkey % 20 < 10 THEN 'figure' ELSE 'table' END AS kind, 'n' || (o_custkey % 20) || '.toc' AS doc, o_orderkey::INT AS ord, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 's' || (o_custkey % 4) || '.tex' END AS file, (o_orderkey + 5)::INT AS line, (o_orderkey % 300)::INT AS page FROM orders WHERE o_orderstatus = 'F'),
y AS (SELECT x.*, (SELECT max(t.ord) FROM t WHERE t.doc = x.doc AND x.file <> '' AND t.file = x.file AND t.line <= x.line) AS own, (SELECT min(t.ord) FROM t WHERE t.doc = x.doc AND t.page > x.page) AS stop FROM x)
SELECT kind, doc, ord, coalesce(own, (SELECT max(t.ord) FROM t WHERE t.doc = y.doc AND (y.stop IS NULL OR t.ord < y.stop))) AS parent FROM y""")
def float_parents(spark, sf):
    o = _read(spark, sf, "orders").where("o_orderstatus = 'F'")
    k = lambda e: F.expr(f"CAST({e} AS STRING)")
    floats = o.select(
        F.expr("CASE WHEN o_custkey % 20 < 10 THEN 'figure' ELSE 'table' END").alias("kind"), F.concat(F.lit("n"), k("o_custkey % 20"), F.lit(".toc")).alias("doc"), F.col("o_orderkey").cast("int").alias("ord"),
        F.when(F.expr("o_orderkey % 3 = 0"), "").otherwise(F.concat(F.lit("s"), k("o_custkey % 4"), F.lit(".tex"))).alias("file"), F.expr("CAST(o_orderkey + 5 AS INT)").alias("line"), F.expr("CAST(o_orderkey % 300 AS INT)").alias("page"),
    )
    return contents.float_parents(floats, _toc(spark, sf)).select("kind", "doc", "ord", "parent")


@query(_TOC + r""", l AS (SELECT 'n' || (o_custkey % 20) || '.toc' AS doc, 'section.' || o_orderkey AS anchor, CASE WHEN o_orderkey % 5 = 0 THEN 'x@y' ELSE 'sec:' || o_orderkey END AS label FROM orders WHERE o_orderkey % 2 = 0)
SELECT p.doc, p.ord, coalesce(l.label, '') AS label FROM p LEFT JOIN (SELECT * FROM l WHERE NOT contains(label, '@')) l USING (doc, anchor)""")
def toc_labels(spark, sf):
    k = "CAST({} AS STRING)".format
    aux = f"""SELECT 'n' || {k('o_custkey % 20')} || '.toc' AS file, CAST(o_orderkey AS INT) AS line, chr(92) || 'newlabel{{' || CASE WHEN o_orderkey % 5 = 0 THEN 'x@y' ELSE 'sec:' || {k('o_orderkey')} END || '}}{{{{1}}{{2}}{{t}}{{section.' || {k('o_orderkey')} || '}}{{}}}}' AS text
      FROM parquet.`{sf}/orders.parquet` WHERE o_orderkey % 2 = 0"""
    return contents.with_labels(_toc(spark, sf), readers.label_lines(spark.sql(aux))).select("doc", "ord", "label")


@query()
def toc_text(spark, sf):
    """The rendered tables, three levels deep. No SQL: tested by brute force over the tree."""
    return contents.render(_toc(spark, sf), depth=2)


# --- figures, abstracts, exploration -------------------------------------------------------------------------------------


def _figure_pages(spark, sf):
    """The inline pages, and conversations with a caption put in by rule."""
    own = _pages(spark, sf).select(F.concat(F.lit("c"), F.col("key").cast("string")).alias("key"), F.col("page").cast("int").alias("page"), F.concat_ws("", "text", F.lit("\nFig. "), F.col("page").cast("string"), F.lit(": About turn "), F.col("page").cast("string"), F.lit(".\n\nSee fig 2 and Figure 12.")).alias("text"))
    return table(spark, "caption_pages", sf).unionByName(own)


_FIGURE_PAGES = "SELECT key, page, text FROM caption_pages UNION ALL SELECT 'c' || conv_id, (turn + 1)::INT, text || E'\\nFig. ' || (turn + 1) || ': About turn ' || (turn + 1) || E'.\\n\\nSee fig 2 and Figure 12.' FROM conversations"


@query(fix("caption_pages", "figures") + rf""", pg AS ({_FIGURE_PAGES}), f AS (SELECT key, figure, num FROM figures UNION ALL SELECT DISTINCT 'c' || conv_id, 'fig2', 2 FROM conversations),
m AS (SELECT key, page, unnest(regexp_extract_all(regexp_replace(text, '(?i)\n(fig|scheme)', E'\n\n\1', 'g') || E'\n\n', '(?is)(?:figure|fig\.?|scheme)\s*(\d+)[.:\s](.+?)\n\n', 1)) AS num, unnest(regexp_extract_all(regexp_replace(text, '(?i)\n(fig|scheme)', E'\n\n\1', 'g') || E'\n\n', '(?is)(?:figure|fig\.?|scheme)\s*(\d+)[.:\s](.+?)\n\n', 2)) AS caption,
  unnest(range(1, 1 + len(regexp_extract_all(regexp_replace(text, '(?i)\n(fig|scheme)', E'\n\n\1', 'g') || E'\n\n', '(?is)(?:figure|fig\.?|scheme)\s*(\d+)[.:\s](.+?)\n\n', 1)))) AS pos FROM pg)
SELECT f.key, f.figure, left(trim(m.caption, E' \t\n\r'), 500) AS caption, m.page FROM f JOIN m ON m.key = f.key AND m.num::BIGINT = f.num QUALIFY row_number() OVER (PARTITION BY f.key, f.figure ORDER BY m.page, m.pos) = 1""")
def figure_captions(spark, sf):
    named = table(spark, "figures", sf).select("key", "figure", F.col("num").cast("int").alias("num"))
    more = _read(spark, sf, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("key"), F.lit("fig2").alias("figure"), F.lit(2).alias("num")).distinct()
    return figures.captions(_figure_pages(spark, sf), named.unionByName(more)).select("key", "figure", "caption", "page")


@query()
def figure_contexts(spark, sf):
    """Where texts name a captioned figure, a hundred characters on either side. No SQL: tested by brute force."""
    return figures.contexts(_figure_pages(spark, sf), table(spark, "figures", sf).select("key", "figure", F.col("num").cast("int").alias("num")))


_CITERS = fix("explorations") + ", citers AS (SELECT s2_id, CASE WHEN abs(depth) % 2 = 0 THEN 'child1' ELSE s2_id || 'x' END AS citing FROM explorations WHERE year % 3 <> 0 UNION ALL SELECT s2_id, 'seed1' FROM explorations WHERE year % 2 = 0)"


@query(_CITERS + ", down(id, seen) AS (SELECT 'seed1', ['seed1'] UNION ALL SELECT s2_id, list_append(seen, s2_id) FROM down JOIN explorations ON parent = id WHERE NOT list_contains(seen, s2_id)) SELECT e.* FROM explorations e WHERE relevance = 'relevant' AND s2_id IN (SELECT id FROM down) AND s2_id IN (SELECT s2_id FROM citers WHERE citing NOT IN (SELECT s2_id FROM explorations))")
def exploration_list(spark, sf):
    nodes = table(spark, "explorations", sf)
    citers = nodes.where("year % 3 <> 0").select("s2_id", F.expr("CASE WHEN abs(depth) % 2 = 0 THEN 'child1' ELSE s2_id || 'x' END").alias("citing")).unionAll(nodes.where("year % 2 = 0").select("s2_id", F.lit("seed1")))
    return graph.explorations(spark, nodes, seed="seed1", expandable=True, citers=citers)


_NODES = "SELECT s2_id, 'T ' || s2_id AS title, year, 'abc' AS abstract, coalesce(parent, '') AS parent, depth, CASE WHEN year % 2 = 0 THEN '2024-01-28 00:00:00' ELSE '2024-01-01 00:00:00' END AS fetched_at, relevance, 'n' AS note FROM explorations"


@query(fix("explorations") + f", o AS ({_NODES}), m AS (SELECT s2_id, CASE depth % 4 WHEN 0 THEN 'deferred' WHEN 1 THEN 'bogus' ELSE 'relevant' END AS r, CASE WHEN depth % 2 = 0 THEN '' ELSE 'why' END AS n FROM explorations WHERE year % 5 <> 0) SELECT o.s2_id, CASE WHEN m.r IS NULL OR m.r = 'bogus' THEN o.relevance ELSE m.r END AS relevance, CASE WHEN m.r <> 'bogus' AND m.n <> '' THEN m.n ELSE o.note END AS note FROM o LEFT JOIN m USING (s2_id)")
def exploration_marks(spark, sf):
    nodes = table(spark, "explorations", sf)
    marks = nodes.where("year % 5 <> 0").select("s2_id", F.expr("CASE depth % 4 WHEN 0 THEN 'deferred' WHEN 1 THEN 'bogus' ELSE 'relevant' END").alias("relevance"), F.expr("CASE WHEN depth % 2 = 0 THEN '' ELSE 'why' END").alias("note"))
    return graph.mark(nodes.withColumn("note", F.lit("n")), marks).select("s2_id", "relevance", "note")


@query(fix("explorations") + f""", o AS ({_NODES}), f AS (SELECT s2_id || CASE WHEN year % 7 = 0 THEN 'new' ELSE '' END AS s2_id, 'Fresh' AS title, year + 1 AS year, repeat('z', 600) AS abstract, '' AS parent, 0 AS depth, '2024-02-01 00:00:00' AS fetched_at FROM explorations WHERE depth % 3 <> 1),
j AS (SELECT o.s2_id AS oid, f.s2_id AS fid, o.*, f.title AS ft, f.year AS fy, f.abstract AS fa, f.fetched_at AS ff, (f.s2_id IS NULL OR coalesce(date_diff('hour', o.fetched_at::TIMESTAMP, TIMESTAMP '2024-02-01') / 24.0 < 7, false)) AS keep FROM o FULL JOIN f ON o.s2_id = f.s2_id)
SELECT coalesce(oid, fid) AS s2_id, CASE WHEN keep THEN title ELSE ft END AS title, CASE WHEN keep THEN year ELSE fy END AS year, length(CASE WHEN keep THEN abstract ELSE left(fa, 500) END) AS n_abstract, parent, coalesce(depth, 0) AS depth, CASE WHEN keep THEN fetched_at ELSE ff END AS fetched_at, coalesce(relevance, 'unknown') AS relevance FROM j""")
def exploration_fetch(spark, sf):
    """Papers fetched anew, and those whose last fetch is young enough to stay."""
    nodes = table(spark, "explorations", sf)
    old = nodes.selectExpr("s2_id", "'T ' || s2_id AS title", "year", "'abc' AS abstract", "coalesce(parent, '') AS parent", "depth", "CASE WHEN year % 2 = 0 THEN '2024-01-28 00:00:00' ELSE '2024-01-01 00:00:00' END AS fetched_at", "relevance", "'n' AS note")
    new = nodes.where("depth % 3 <> 1").selectExpr("s2_id || CASE WHEN year % 7 = 0 THEN 'new' ELSE '' END AS s2_id", "'Fresh' AS title", "year + 1 AS year", "repeat('z', 600) AS abstract", "'' AS parent", "0 AS depth", "'2024-02-01 00:00:00' AS fetched_at")
    out = graph.explore(old, new, "2024-02-01 00:00:00")
    return out.select("s2_id", "title", "year", F.length("abstract").cast("long").alias("n_abstract"), "parent", "depth", "fetched_at", "relevance")


@query("""WITH old AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem WHERE l_linenumber <= 2), new AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem)
SELECT n.* FROM new n JOIN orders ON o_orderkey = n.citing WHERE year(o_orderdate) >= 1998 AND (n.citing, n.cited) NOT IN (SELECT (citing, cited) FROM old)""".replace("(n.citing, n.cited) NOT IN (SELECT (citing, cited) FROM old)", "NOT EXISTS (SELECT 1 FROM old o WHERE o.citing = n.citing AND o.cited = n.cited)"))
def graph_update(spark, sf):
    """Edges that the graph lacks, of young citing papers."""
    li = _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"), "l_linenumber")
    papers = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("citing"), F.year("o_orderdate").alias("year"))
    return graph.new_edges(li.where("l_linenumber <= 2"), li.select("citing", "cited"), papers, 1998)


# --- metadata blocks -------------------------------------------------------------------------------------------------------

_META = "SELECT CAST(doc_id AS {s}) || '.tex' AS file, left(text, 40) || chr(10) || '% === FILE META (machine-readable, not rendered) ===' || chr(10) || '% status: ' || source || chr(10) || '% open: ' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'why ' || lang || ': so' END || chr(10) || '% no field' || chr(10) || 'end' || chr(10) || '% late: x' AS text FROM {t}"


@query(f"WITH f AS ({_META.format(s='STRING', t='documents')}) SELECT file, 'status' AS field, regexp_extract(text, '% status: ([^\\n]*)', 1) AS value FROM f UNION ALL SELECT file, 'open', trim(regexp_extract(text, '% open: ([^\\n]*)', 1)) FROM f")
def file_meta(spark, sf):
    return structure.file_meta(spark.sql(_META.format(s="STRING", t=f"parquet.`{sf}/documents.parquet`")))


@query(f"""WITH f AS ({_META.format(s='STRING', t='documents')}) SELECT file, rtrim(string_split(text, chr(10) || '% === FILE META')[1], chr(10)) || chr(10) || chr(10) || '% === FILE META (machine-readable, not rendered) ===' || chr(10) || '% status: new' || chr(10) || '% also: ' || file || chr(10) AS text FROM f""")
def write_meta(spark, sf):
    files = spark.sql(_META.format(s="STRING", t=f"parquet.`{sf}/documents.parquet`"))
    meta = files.select("file", F.lit("status").alias("field"), F.lit("new").alias("value")).unionAll(files.select("file", F.lit("also"), F.col("file"))).unionAll(files.select("file", F.lit("open"), F.lit("")))
    return structure.write_meta(files, meta, order=("status",))


@query(f"WITH f AS ({_META.format(s='STRING', t='documents')}), g AS (SELECT file, regexp_extract(text, '% status: ([^\\n]*)', 1) AS s, trim(regexp_extract(text, '% open: ([^\\n]*)', 1)) AS o FROM f) SELECT file, 'File: ' || file || chr(10) || CASE WHEN o <> '' THEN 'Open: ' || o || chr(10) ELSE '' END || 'Status: ' || s AS text FROM g")
def flatten_meta(spark, sf):
    return structure.flatten("File", file_meta(spark, sf), "file")
