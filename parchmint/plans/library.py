"""Queries over a library's own state: entries, notes, figures, rejected identifiers, caches, views."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchmint.operators import catalog, library, tasks
from parchmint.plans.catalogue import _pages, _read, query
from parchmint.plans.fixtures import sql as fix
from parchmint.plans.fixtures import table

_SUFFIX = "'^(.+?)_(errata|erratum|retraction|corrigendum|addendum|comment|reply)(?:_([0-9]+))?$'"
_CHILD = f"c AS (SELECT DISTINCT key AS child, regexp_extract(key, {_SUFFIX}, 1) AS parent, regexp_extract(key, {_SUFFIX}, 2) AS kind FROM bib_keys), j AS (SELECT child, parent, kind FROM c WHERE parent <> '' AND parent IN (SELECT key FROM bib_keys))"


@query(fix("bib_keys") + f", {_CHILD} SELECT child AS key, parent AS other, kind AS relation, 'parent' AS direction FROM j UNION ALL SELECT parent, child, kind, 'child' FROM j")
def related_papers(spark, sf):
    return library.related(table(spark, "bib_keys", sf).distinct())


@query("""WITH k AS (SELECT 'xu' || (1990 + c_custkey % 30) || 'slug' || c_custkey AS key FROM customer UNION ALL SELECT 'nokey'), p AS (SELECT o_orderkey AS id, 'xu' || (1990 + o_orderkey % 40) AS prefix FROM orders WHERE o_orderstatus = 'P')
SELECT id, key FROM p JOIN k ON starts_with(key, prefix)""")
def parent_candidates(spark, sf):
    keys = _read(spark, sf, "customer").select(F.expr("'xu' || CAST(1990 + c_custkey % 30 AS STRING) || 'slug' || CAST(c_custkey AS STRING)").alias("key")).unionAll(spark.sql("SELECT 'nokey'"))
    papers = _read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.lit("Xu").alias("surname"), F.expr("1990 + o_orderkey % 40").alias("year"))
    return library.parent_candidates(papers, keys)


_PAPERS = "SELECT 'k' || p_partkey AS key, CASE WHEN p_partkey % 2 = 0 THEN ' 10.1/AB' || (p_partkey % 300) || ' ' END AS doi, md5(p_name || p_partkey) AS s2_id FROM part"


@query(f"WITH p AS ({_PAPERS}), a AS (SELECT '10.1/ab' || (o_orderkey % 700) AS id FROM orders UNION SELECT s2_id FROM p WHERE key LIKE '%7'), d AS (SELECT lower(trim(doi)) AS k, min(key) AS key FROM p WHERE doi IS NOT NULL GROUP BY 1), s AS (SELECT s2_id, min(key) AS key FROM p GROUP BY 1) SELECT a.id, coalesce(d.key, s.key) AS key FROM a LEFT JOIN d ON d.k = lower(a.id) LEFT JOIN s ON s.s2_id = a.id")
def resolve_ids(spark, sf):
    p = _read(spark, sf, "part").selectExpr("'k' || CAST(p_partkey AS STRING) AS key", "CASE WHEN p_partkey % 2 = 0 THEN ' 10.1/AB' || CAST(p_partkey % 300 AS STRING) || ' ' END AS doi", "md5(p_name || CAST(p_partkey AS STRING)) AS s2_id")
    asked = _read(spark, sf, "orders").selectExpr("'10.1/ab' || CAST(o_orderkey % 700 AS STRING) AS id").unionAll(p.where("key LIKE '%7'").select("s2_id")).distinct()
    return library.resolve_ids(asked, p)


# --- entries -----------------------------------------------------------------------------------------------------------------

def _entries(spark, sf):
    fields = F.create_map(F.lit("title"), F.col("p_name"), F.lit("year"), F.col("p_size").cast("string"))
    return _read(spark, sf, "part").select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), F.lit("article").alias("type"), fields.alias("fields"))


@query("""SELECT CASE WHEN p_partkey = 7 THEN 'renamed' ELSE 'k' || p_partkey END AS key, p_name AS title, CASE WHEN p_partkey = 5 THEN NULL ELSE p_size::VARCHAR END AS year, CASE WHEN p_partkey = 3 THEN 'done' END AS status FROM part WHERE p_partkey <> 9
UNION ALL SELECT 'fresh', 'A New One', NULL, NULL""")
def entry_edits(spark, sf):
    """Entries after one edit of each kind: set, remove, add, drop, rename."""
    e = library.set_field(_entries(spark, sf), "k3", "x-status", "done")
    e = library.remove_field(e, "k5", "year")
    e = library.add_entry(e, "fresh", fields={"title": "A New One"})
    e = library.rename_key(library.remove_entry(e, "k9"), "k7", "renamed")
    get = lambda n: F.try_element_at("fields", F.lit(n))
    return e.select("key", get("title").alias("title"), get("year").alias("year"), get("x-status").alias("status"))


# --- notes, figures, rejected ------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT c_name AS key, 'claims' AS field, c_mktsegment AS value FROM customer UNION ALL SELECT c_name, 'open', 'why ' || c_custkey FROM customer), n AS (SELECT c_name AS key, 'claims' AS field, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'new' END AS value FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM o WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n WHERE value <> ''""")
def save_notes(spark, sf):
    c = _read(spark, sf, "customer")
    old = c.select(F.col("c_name").alias("key"), F.lit("claims").alias("field"), F.col("c_mktsegment").alias("value")).unionAll(c.selectExpr("c_name", "'open'", "'why ' || CAST(c_custkey AS STRING)"))
    new = c.where("c_custkey % 2 = 0").selectExpr("c_name AS key", "'claims' AS field", "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'new' END AS value").unionAll(c.where("c_custkey % 2 = 0").selectExpr("c_name", "'bogus'", "'x'"))
    return library.save_notes(old, new, ("claims", "open"))


@query("SELECT c_name AS parent, c_name || '_child' AS key FROM customer WHERE c_custkey % 3 = 0")
def children_from_notes(spark, sf):
    c = _read(spark, sf, "customer")
    notes = c.where("c_custkey % 3 = 0").selectExpr("c_name || '_child' AS key", "'parent' AS field", "c_name AS value").unionAll(c.selectExpr("c_name", "'parent'", "CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END")).unionAll(c.selectExpr("c_name", "'claims'", "'x'"))
    return library.children_from_notes(notes)


@query(r"SELECT doc_id::VARCHAR AS key, 'summary' AS title, CASE WHEN length(t) > 80 THEN left(t, 80) || '...' ELSE t END AS preview FROM (SELECT doc_id, regexp_replace(text, '\s*\n\s*', ' ', 'g') AS t FROM documents)")
def notes_list(spark, sf):
    return library.notes_list(_read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), F.lit("summary").alias("title"), "text"))


_FIGS = "SELECT 'k' || (p_partkey % 200) AS key, 'fig' || p_partkey AS figure, p_size AS page, p_name AS reason, NULL::VARCHAR AS caption, CASE p_partkey % 3 WHEN 0 THEN 'captured' ELSE 'requested' END AS status FROM part"


def _figures(spark, sf):
    return _read(spark, sf, "part").selectExpr("'k' || CAST(p_partkey % 200 AS STRING) AS key", "'fig' || CAST(p_partkey AS STRING) AS figure", "p_size AS page", "p_name AS reason", "CAST(NULL AS STRING) AS caption", "CASE p_partkey % 3 WHEN 0 THEN 'captured' ELSE 'requested' END AS status")


@query(f"""WITH f AS ({_FIGS}), n AS (SELECT 'k' || (s_suppkey % 200) AS key, 'fig' || (s_suppkey * 2) AS figure, NULL::BIGINT AS page, 'need it' AS reason, 'A caption' AS caption FROM supplier), g AS (SELECT 'k' || (s_suppkey % 200) AS key, 'fig' || s_suppkey AS figure, s_name || '.png' AS file FROM supplier WHERE s_suppkey % 2 = 1),
r AS (SELECT coalesce(f.key, n.key) AS key, coalesce(f.figure, n.figure) AS figure, f.page, coalesce(n.reason, f.reason) AS reason, coalesce(n.caption, f.caption) AS caption, CASE WHEN f.status = 'captured' THEN 'captured' WHEN n.key IS NOT NULL THEN 'requested' ELSE f.status END AS status FROM f FULL JOIN n ON f.key = n.key AND f.figure = n.figure)
SELECT coalesce(r.key, g.key) AS key, coalesce(r.figure, g.figure) AS figure, page::BIGINT AS page, reason, caption, CASE WHEN g.key IS NOT NULL THEN 'captured' ELSE status END AS status, g.file FROM r FULL JOIN g ON g.key = r.key AND g.figure = r.figure""")
def figure_updates(spark, sf):
    """Figures after requests and captures."""
    s = _read(spark, sf, "supplier")
    new = s.selectExpr("'k' || CAST(s_suppkey % 200 AS STRING) AS key", "'fig' || CAST(s_suppkey * 2 AS STRING) AS figure", "CAST(NULL AS LONG) AS page", "'need it' AS reason", "'A caption' AS caption")
    files = s.where("s_suppkey % 2 = 1").selectExpr("'k' || CAST(s_suppkey % 200 AS STRING) AS key", "'fig' || CAST(s_suppkey AS STRING) AS figure", "s_name || '.png' AS file")
    out = library.register_figures(library.request_figures(_figures(spark, sf), new), files)
    return out.select("key", "figure", F.col("page").cast("long").alias("page"), "reason", "caption", "status", "file")


@query(f"SELECT key, count(*) AS open FROM ({_FIGS}) WHERE status = 'requested' GROUP BY key")
def open_requests(spark, sf):
    return _figures(spark, sf).where("status = 'requested'").groupBy("key").agg(F.count("*").alias("open"))


@query("""WITH o AS (SELECT '10.1/A' || p_partkey AS doi, 'k' AS key, 'old' AS reason, '2023-01-01' AS date FROM part), n AS (SELECT ' 10.1/a' || (s_suppkey * 3) || ' ' AS doi, '' AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'fake' ELSE '' END AS reason FROM supplier UNION ALL SELECT '10.9/new' || s_suppkey, 'z', '' FROM supplier),
j AS (SELECT o.doi AS d, o.key AS k, o.reason AS r, o.date, trim(n.doi) AS nd, n.key AS nk, n.reason AS nr FROM o FULL JOIN n ON lower(trim(o.doi)) = lower(trim(n.doi)))
SELECT coalesce(d, nd) AS doi, coalesce(nullif(nk, ''), k, '') AS key, coalesce(nullif(nr, ''), r, 'DOI does not resolve') AS reason, coalesce(date, '2024-02-01') AS date FROM j WHERE lower(coalesce(d, nd)) <> '10.1/a5'""")
def rejected_updates(spark, sf):
    s = _read(spark, sf, "supplier")
    old = _read(spark, sf, "part").selectExpr("'10.1/A' || CAST(p_partkey AS STRING) AS doi", "'k' AS key", "'old' AS reason", "'2023-01-01' AS date")
    new = s.selectExpr("' 10.1/a' || CAST(s_suppkey * 3 AS STRING) || ' ' AS doi", "'' AS key", "CASE WHEN s_suppkey % 2 = 0 THEN 'fake' ELSE '' END AS reason").unionAll(s.selectExpr("'10.9/new' || CAST(s_suppkey AS STRING)", "'z'", "''"))
    return library.unreject(library.reject(old, new, "2024-02-01"), " 10.1/a5")


# --- cache -------------------------------------------------------------------------------------------------------------------

_CACHE = "SELECT CASE event_id % 3 WHEN 0 THEN 's2' WHEN 1 THEN 'crossref' ELSE 'openalex' END AS service, CASE event_id % 3 WHEN 0 THEN CASE WHEN event_id % 2 = 0 THEN 'paper' ELSE 'search' END WHEN 1 THEN '' ELSE 'doi' END AS kind, 'ID' || {k1} AS identifier, CASE WHEN event_id % 50 = 0 THEN 'unknown' ELSE CAST(ts AS {s}) END AS fetched_at, event_type || {k2} AS data FROM {t}"


def _envelopes(spark, sf):
    k = "CAST({} AS STRING)".format
    return spark.sql(_CACHE.format(k1=k("event_id % 2000"), k2=k("event_id"), s="STRING", t=f"parquet.`{sf}/events.parquet`"))


_PUT = "e AS (" + _CACHE.format(k1="(event_id % 2000)", k2="event_id", s="VARCHAR", t="events") + "), c AS (SELECT *, left(sha256(lower(trim(identifier))), 16) AS cache_key, CASE service WHEN 's2' THEN CASE kind WHEN 'paper' THEN 30 ELSE 7 END ELSE 30 END AS ttl_days FROM e QUALIFY row_number() OVER (PARTITION BY service, kind, lower(trim(identifier)) ORDER BY fetched_at DESC, data) = 1)"


def _cache(spark, sf):
    empty = spark.createDataFrame([], "service string, kind string, identifier string, cache_key string, fetched_at string, ttl_days int, data string")
    return library.cache_put(empty, _envelopes(spark, sf))


@query(f"WITH {_PUT} SELECT service, kind, identifier, cache_key, fetched_at, ttl_days::INT AS ttl_days, data FROM c")
def cache_put(spark, sf):
    return _cache(spark, sf)


@query(f"WITH {_PUT}, a AS (SELECT DISTINCT service, kind, lower(identifier) AS identifier FROM c UNION ALL SELECT 's2', 'paper', 'none') SELECT a.service, a.kind, a.identifier, c.data FROM a LEFT JOIN (SELECT * FROM c WHERE NOT coalesce((epoch_us(TIMESTAMP '2024-02-10') - epoch_us(try_cast(fetched_at AS TIMESTAMP))) / 86400000000 > ttl_days, false)) c ON c.service = a.service AND c.kind = a.kind AND c.cache_key = left(sha256(a.identifier), 16)")
def cache_get(spark, sf):
    cache = _cache(spark, sf)
    asked = cache.select("service", "kind", F.lower("identifier").alias("identifier")).unionAll(spark.sql("SELECT 's2', 'paper', 'none'"))
    return library.cache_get(cache, asked, "2024-02-10 00:00:00")


@query(f"WITH {_PUT} SELECT service, kind, count(*) AS n FROM c WHERE NOT (service = 's2' AND kind = 'paper') AND service <> 'openalex' AND NOT (service = 'crossref' AND kind = '' AND identifier = 'ID7') GROUP BY ALL")
def cache_drop(spark, sf):
    c = library.cache_drop(library.cache_drop(_cache(spark, sf), "s2", "paper"), "openalex")
    return library.cache_drop(c, "crossref", "", "id7 ").groupBy("service", "kind").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT CASE WHEN user_id % 2 = 0 THEN 's2' ELSE 'crossref' END AS service, epoch_us(ts) / 1000000.0 / 60 + event_id / 1e9 AS t FROM events), g AS (SELECT *, CASE service WHEN 's2' THEN 1.0 ELSE 0.1 END AS gap, row_number() OVER (PARTITION BY service ORDER BY t) AS i FROM c)
SELECT service, count(*) AS calls, count_if(w > 0)::BIGINT AS waited FROM (SELECT service, round(i * gap + max(t - i * gap) OVER (PARTITION BY service ORDER BY t ROWS UNBOUNDED PRECEDING) - t, 3) AS w FROM g) GROUP BY service""")
def throttled_calls(spark, sf):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000000.0) / 60 + F.col("event_id") / F.lit(1e9)
    calls = _read(spark, sf, "events").select(F.when(F.col("user_id") % 2 == 0, "s2").otherwise("crossref").alias("service"), at.alias("at"))
    return library.throttled(calls, 3).groupBy("service").agg(F.count("*").alias("calls"), F.count_if(F.col("waits") > 0).alias("waited"))


# --- views -------------------------------------------------------------------------------------------------------------------


@query(fix("bib_keys") + f""", {_CHILD}, k AS (SELECT DISTINCT key FROM bib_keys), f AS (SELECT key, string_agg(DISTINCT figure, ',' ORDER BY figure) AS figures FROM ({_FIGS}) GROUP BY key), pg AS (SELECT 'k' || conv_id AS key, count(*) AS pages FROM conversations GROUP BY 1),
r AS (SELECT key, count(*) AS n FROM (SELECT child AS key FROM j UNION ALL SELECT parent FROM j) GROUP BY key), w AS (SELECT parent AS key, string_agg(child, ', ' ORDER BY child) AS w FROM j WHERE kind = 'retraction' GROUP BY parent)
SELECT k.key, coalesce(f.figures, '') AS figures, coalesce(pages, 0) AS pages, coalesce(r.n, 0) AS related, 'RETRACTED: ' || w.w AS warning FROM k LEFT JOIN f USING (key) LEFT JOIN pg USING (key) LEFT JOIN r USING (key) LEFT JOIN w USING (key)""")
def paper_view(spark, sf):
    papers = table(spark, "bib_keys", sf).distinct().withColumn("doi_status", F.lit(None).cast("string"))
    none = spark.createDataFrame([], "key string, title string")
    extras = spark.createDataFrame([], "key string, s2_id string, citation_count int, abstract string")
    pages = _pages(spark, sf).select(F.concat(F.lit("k"), F.col("key").cast("string")).alias("key"))
    v = library.paper_view(papers, _figures(spark, sf), none, pages, extras)
    return v.select("key", F.array_join("figures", ",").alias("figures"), "pages", F.coalesce(F.size("related"), F.lit(0)).cast("long").alias("related"), "warning")


@query("""WITH a AS (SELECT conv_id AS key, turn + 1 AS page, text FROM conversations WHERE conv_id % 3 <> 0), r AS (SELECT conv_id AS key, turn + 1 AS page, 'raw ' || text AS text FROM conversations WHERE conv_id % 2 = 0), q AS (SELECT DISTINCT conv_id AS key, 2 AS page FROM conversations UNION ALL SELECT DISTINCT conv_id, 999 FROM conversations),
n AS (SELECT key, count(*) AS n FROM a GROUP BY key), m AS (SELECT key, count(*) AS m FROM r GROUP BY key)
SELECT q.key, q.page, coalesce(n, m) AS total_pages, coalesce(a.text, r.text) AS text, CASE WHEN coalesce(n, m) IS NULL THEN 'not extracted' WHEN coalesce(a.text, r.text) IS NULL THEN 'out of range (1-' || coalesce(n, m) || ')' END AS problem
FROM q LEFT JOIN a USING (key, page) LEFT JOIN r USING (key, page) LEFT JOIN n USING (key) LEFT JOIN m USING (key)""")
def page_view(spark, sf):
    p = _pages(spark, sf)
    keys = p.select("key").distinct()
    asked = keys.withColumn("page", F.lit(2)).unionAll(keys.withColumn("page", F.lit(999)))
    return library.page_view(p.where("key % 3 <> 0"), p.where("key % 2 = 0").withColumn("text", F.concat(F.lit("raw "), "text")), asked)


@query("WITH d AS (SELECT doc_id, left(text, 200) AS line, sum(octet_length(encode(left(text, 200)))) OVER (ORDER BY doc_id) AS b FROM documents WHERE text <> '') SELECT doc_id, line FROM d WHERE b <= 48000")
def capped_response(spark, sf):
    return library.capped(_read(spark, sf, "documents").select("doc_id", F.left("text", F.lit(200)).alias("line")), ["doc_id"], "line")


@query(fix("issues") + "SELECT count_if(starts_with(heading, '## ') AND NOT starts_with(heading, '## [RESOLVED]'))::BIGINT AS open_issues, lpad((max(n) + 1)::VARCHAR, greatest(3, length((max(n) + 1)::VARCHAR))::INT, '0') AS next_number FROM issues")
def open_issues(spark, sf):
    n = (F.max("n") + 1).cast("string")
    number = F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)
    return table(spark, "issues", sf).agg(F.count_if(F.col("heading").rlike(r"^## (?!\[RESOLVED\])")).alias("open_issues"), number.alias("next_number"))


@query(fix("issues") + ", new AS (SELECT row_number() OVER (ORDER BY p_partkey) AS rn, p_name AS h FROM part), m AS (SELECT max(n) AS m FROM issues) SELECT n::BIGINT AS n, heading FROM issues UNION ALL SELECT m + rn, '## ' || h FROM new, m")
def append_issues(spark, sf):
    """New issues numbered on from the greatest number."""
    old = table(spark, "issues", sf).select(F.col("n").cast("long").alias("n"), "heading")
    return tasks.append_numbered(old, _read(spark, sf, "part").select(F.concat(F.lit("## "), "p_name").alias("heading"), "p_partkey"), "n", "p_partkey").select("n", "heading")


_NOW = "TIMESTAMP '2024-02-01'"


@query(fix("freshness") + ", a AS (SELECT CASE WHEN kind = 'papers' AND newest IS NULL THEN 'papers_empty' WHEN kind = 'inbox' AND newest > 0 THEN 'inbox_pending' WHEN newest > built THEN kind || '_stale' END AS category, newest - built AS behind FROM freshness) SELECT category, CASE WHEN behind IS NULL THEN NULL WHEN behind < 60 THEN behind || 's' WHEN behind < 3600 THEN (behind // 60) || 'm' ELSE (behind // 3600) || 'h' END AS delta FROM a WHERE category IS NOT NULL")
def freshness_advice(spark, sf):
    return tasks.advice(table(spark, "freshness", sf))


@query("""WITH t AS (SELECT * FROM (VALUES ('review', 'src1*', 24.0), ('spell', 'src?', 0.0), ('all', '*', 100.0)) v(task, "glob", cadence)), f AS (SELECT DISTINCT source AS file FROM documents), d AS (SELECT 'src' || (user_id % 9) AS file, CASE WHEN event_type = 'click' THEN 'review' ELSE 'all' END AS task, max(ts) AS done FROM events GROUP BY 1, 2)
SELECT t.task, f.file, round(CASE WHEN done IS NULL THEN 1000.0::DOUBLE WHEN cadence > 0 THEN (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(done)) / 3600000000 / cadence ELSE 0.0::DOUBLE END, 6) AS score FROM t JOIN f ON regexp_full_match(f.file, replace(replace(replace(t."glob", '.', '\\.'), '*', '.*'), '?', '.')) LEFT JOIN d USING (task, file) WHERE CASE WHEN done IS NULL THEN 1000.0 WHEN cadence > 0 THEN 1.0 ELSE 0.0 END > 0 ORDER BY score DESC, file, task LIMIT 40""")
def tasks_by_glob(spark, sf):
    """Tasks meet the files that their globs name (a stated list of tasks, block by block), then their completions."""
    defined = spark.sql("SELECT * FROM VALUES ('review', 'src1*', 24.0D), ('spell', 'src?', 0.0D), ('all', '*', 100.0D) AS t(task, glob, cadence)")
    files = _read(spark, sf, "documents").select(F.col("source").alias("file")).distinct()
    done = _read(spark, sf, "events").groupBy(F.concat(F.lit("src"), (F.col("user_id") % 9).cast("string")).alias("file"), F.when(F.col("event_type") == "click", "review").otherwise("all").alias("task")).agg(F.max("ts").cast("timestamp").alias("done"))
    items = tasks.by_glob(defined, files).join(done, ["task", "file"], "left")
    score = tasks.task_score(F.col("done"), F.expr(_NOW), F.col("cadence"), F.lit(False))
    return tasks.rank(items.withColumn("score", score), 40).select("task", "file", F.round("score", 6).alias("score"))


@query("""WITH e AS (SELECT user_id::VARCHAR AS task, event_type AS file, ts, event_id FROM events) SELECT task || '::' || file AS id, task, file, ts AS done FROM e QUALIFY row_number() OVER (PARTITION BY task, file ORDER BY ts DESC, event_id DESC) = 1""")
def task_state(spark, sf):
    ev = _read(spark, sf, "events").select(F.col("user_id").cast("string").alias("task"), F.col("event_type").alias("file"), F.col("ts").alias("done"), "event_id")
    return tasks.mark_done(ev.where("false").select("task", "file", "done"), ev, ["done", "event_id"])


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 THEN 'new' ELSE o_orderpriority END AS summary, CASE WHEN o_orderkey % 2 = 0 THEN 'later' ELSE o_orderstatus END AS status FROM orders""")
def summary_set(spark, sf):
    o = _read(spark, sf, "orders")
    old = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("summary"), F.col("o_orderstatus").alias("status"))
    new = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, "new").otherwise("").alias("summary"), F.lit("later").alias("status"))
    return tasks.keep_unless_given(old, new, "id", ["summary", "status"])


@query("""WITH c AS (SELECT vec_id, label, CASE WHEN vec_id % 3 <> 0 THEN embedding END AS e FROM embeddings) SELECT vec_id, label, coalesce(e[1], 0.5::FLOAT) AS first FROM c""")
def rebuilt_vectors(spark, sf):
    """An index rebuilt from stored chunks: stored vectors are kept, chunks without one are embedded again (here all to the
    same vector, so that SQL can say it)."""
    from parchmint.functions import register

    own = _read(spark, sf, "embeddings").select("vec_id", "label", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"), F.lit("text").alias("text"))
    out = register.rebuild(own, "text", "embedding", _half)
    return out.select("vec_id", "label", F.col("embedding")[0].cast("float").alias("first"))


def _half(texts: list[str]):
    import numpy as np

    return np.full((len(texts), 4), 0.5)


@query("SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS pages, min(page_id) OVER (PARTITION BY regexp_extract(url, '^[a-z]+://([^/]+)', 1)) AS first FROM pages")
def archive_listing(spark, sf):
    w = _read(spark, sf, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first"))
    return w.orderBy("host")


_LISTED = "SELECT DISTINCT key, 'On ' || repeat(key || ' ', 12) AS title, 1990 + length(key) AS year, length(key) % 2 = 0 AS has_pdf, CASE WHEN length(key) % 5 = 0 THEN 'missing' ELSE 'valid' END AS doi_status FROM bib_keys"


@query(fix("bib_keys") + f""", l AS ({_LISTED}), m AS (SELECT *, nullif(regexp_extract(key, {_SUFFIX}, 2), '') AS related, nullif(regexp_extract(key, {_SUFFIX}, 1), '') AS parent FROM l WHERE doi_status = 'valid' AND (contains(key, '1') OR contains(key, 'xu'))),
r AS (SELECT *, row_number() OVER (ORDER BY key) AS rn, count(*) OVER () AS total FROM m)
SELECT key, left(title, 80) AS title, year::INT AS year, has_pdf, doi_status, related, parent, coalesce(key IN (SELECT parent FROM m WHERE related = 'retraction'), false) AS retracted, total FROM r WHERE rn BETWEEN 51 AND 100""")
def library_list_flags(spark, sf):
    """A page of the library list with its related documents and retractions, whatever page these are on."""
    t = table(spark, "bib_keys", sf).distinct()
    words = F.filter(F.array(F.when(F.contains("key", F.lit("1")), "one"), F.when(F.contains("key", F.lit("xu")), "xu")), lambda x: x.isNotNull())
    papers = t.select("key", F.concat(F.lit("On "), F.repeat(F.concat("key", F.lit(" ")), F.lit(12))).alias("title"), (F.lit(1990) + F.length("key")).alias("year"), (F.length("key") % 2 == 0).alias("has_pdf"), F.when(F.length("key") % 5 == 0, "missing").otherwise("valid").alias("doi_status"), words.alias("tags"))
    return catalog.library_list(papers, ["key"], 2, tags=["one", "xu"], status="valid").drop("tags")
