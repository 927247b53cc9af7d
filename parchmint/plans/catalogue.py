"""All registered queries of the analytics engine, with equivalent SQL for DuckDB.

Papers stand on ``documents`` (and ``part`` as a library), citations on distinct ``lineitem (l_orderkey, l_partkey)``,
citing papers on ``orders``, project links on ``orders`` and ``customer``, paged texts on ``conversations``, chunk vectors
on ``embeddings``, completions and logs on ``events``; the rest on inline tables that both engines read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.functions import ids, register
from parchmint.functions import text as tx
from parchmint.operators import catalog, gates, graph, ordered, search, simjoin, structure, tasks, vectors
from parchmint.plans import fixtures
from parchmint.plans.fixtures import sql as fix
from parchmint.plans.fixtures import table
from parchmint.sources.staging import shared_folder, tasks_for
from parchmint.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = "2024-02-01 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("citing"), F.col("l_partkey").alias("cited"))


# --- graph ---------------------------------------------------------------------------------------------------------



@query("""
SELECT citing, count(*) AS shared FROM (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part))
GROUP BY citing HAVING count(*) >= 2 ORDER BY shared DESC, citing LIMIT 100""")
def shared_citers(spark, sf):
    return graph.shared_citers(_edges(spark, sf), _read(spark, sf, "part").select(F.col("p_partkey").alias("cited")), 2, 100)


@query("""
WITH hit AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 10),
new AS (SELECT * FROM hit WHERE citing NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')),
s AS (SELECT citing, list_sort(list(cited)) AS shared_keys, count(*) AS n_shared FROM new GROUP BY citing HAVING count(*) >= 2),
y AS (SELECT s.*, coalesce(year(o_orderdate), 0)::INT AS year FROM s LEFT JOIN orders ON o_orderkey = citing)
SELECT citing, shared_keys, n_shared, year,
  round(n_shared * CASE WHEN year = 0 THEN 0.5 ELSE greatest(0.1::DOUBLE, 1.0::DOUBLE - 0.1::DOUBLE * (2001 - year)) END, 2) AS score
FROM y ORDER BY score DESC, year DESC, citing LIMIT 100""")
def discover_new_scored(spark, sf):
    orders = _read(spark, sf, "orders")
    papers = orders.select(F.col("o_orderkey").alias("citing"), F.year("o_orderdate").alias("year"))
    library = _read(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("cited"))
    known = orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("citing"))
    return graph.discover_new(_edges(spark, sf), papers, library, known, 2001, 2, 100).select("citing", "shared_keys", "n_shared", "year", "score")


@query("""
WITH hit AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 10),
new AS (SELECT * FROM hit WHERE citing NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT') AND citing NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 1)),
s AS (SELECT citing, count(*) AS n_shared FROM new GROUP BY citing HAVING count(*) >= 2)
SELECT citing, n_shared, doi FROM s JOIN (SELECT o_orderkey AS citing, CASE WHEN o_orderkey % 4 <> 0 THEN '10.1/X' || o_custkey END AS doi FROM orders) USING (citing)
WHERE doi IS NULL OR lower(doi) NOT IN (SELECT '10.1/x' || p_partkey FROM part WHERE p_size <= 10)""")
def discover_new_excluding(spark, sf):
    """Candidates that the library has neither by id nor by DOI and that weren't dismissed."""
    orders = _read(spark, sf, "orders")
    papers = orders.select(F.col("o_orderkey").alias("citing"), F.year("o_orderdate").alias("year"), F.when(F.col("o_orderkey") % 4 != 0, F.concat(F.lit("10.1/X"), "o_custkey")).alias("doi"))
    library = _read(spark, sf, "part").where("p_size <= 10").select(F.col("p_partkey").alias("cited"), F.concat(F.lit("10.1/x"), "p_partkey").alias("doi"))
    known, gone = (orders.where(x).select(F.col("o_orderkey").alias("citing")) for x in ("o_orderpriority = '1-URGENT'", "o_orderkey % 6 = 1"))
    every = orders.count()  # no limit: all candidates
    return graph.discover_new(_edges(spark, sf), papers, library.select("cited"), known, 2001, 2, every, dismissed=gone, held=library.select("doi")).select("citing", "n_shared", "doi")


_NEIGHBOURS = """
WITH e AS (SELECT DISTINCT l_orderkey AS citing, l_partkey AS cited FROM lineitem),
r AS (SELECT {key0} AS key, {other} AS other, count(*) OVER (PARTITION BY {key0}) AS total, row_number() OVER (PARTITION BY {key0} ORDER BY {other}) AS rn FROM e)
SELECT key, other, total, {meta} AS info FROM r LEFT JOIN {table} ON {id} = other WHERE rn <= 50"""



@query(_NEIGHBOURS.format(key0="cited", other="citing", meta="o_orderstatus", table="orders", id="o_orderkey"))
def citers_with_metadata(spark, sf):
    papers = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("citing"), F.col("o_orderstatus").alias("info"))
    of = _read(spark, sf, "part").select(F.col("p_partkey").alias("key"))
    return graph.neighbours(_edges(spark, sf), of, papers, "citing", 50).select("key", "other", "total", "info")


@query(_NEIGHBOURS.format(key0="citing", other="cited", meta="p_name", table="part", id="p_partkey"))
def references_with_metadata(spark, sf):
    papers = _read(spark, sf, "part").select(F.col("p_partkey").alias("cited"), F.col("p_name").alias("info"))
    of = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    return graph.neighbours(_edges(spark, sf), of, papers, "cited", 50).select("key", "other", "total", "info")


@query("SELECT (SELECT count(*) FROM part) AS papers, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) AS citations")
def graph_stats(spark, sf):
    e = _edges(spark, sf).distinct().agg(F.count("*").alias("citations"))
    return _read(spark, sf, "part").agg(F.count("*").alias("papers")).crossJoin(e)


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey IN (5, 17, 99, 1000000)")
def graph_lookup_many(spark, sf):
    return _read(spark, sf, "part").where(F.col("p_partkey").isin(5, 17, 99, 1000000)).select("p_partkey", "p_name", "p_brand")


@query("""
WITH last AS (SELECT user_id::VARCHAR AS key, max(ts) AS t FROM events WHERE event_type = 'purchase' GROUP BY 1),
k AS (SELECT DISTINCT user_id::VARCHAR AS key FROM events)
SELECT k.key, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(t)) / 86400000000 AS age_days FROM k LEFT JOIN last USING (key)
WHERE t IS NULL OR (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(t)) / 86400000000 > 3""")
def find_stale(spark, sf):
    ev = _read(spark, sf, "events").withColumn("key", F.col("user_id").cast("string"))
    seen = ev.where("event_type = 'purchase'").groupBy("key").agg(F.max("ts").alias("last_checked"))
    return graph.find_stale(ev.select("key").distinct(), seen, NOW, 3)


@query(fix("tex_edges") + """, walk(node, depth, path, seen) AS (SELECT 'main', 0, '', ['main'] UNION ALL
  SELECT child, depth + 1, path || lpad(ord::VARCHAR, 9, '0') || '/', list_append(seen, child) FROM walk JOIN tex_edges ON parent = node WHERE NOT list_contains(seen, child))
SELECT node, arg_min(depth, path) AS depth, min(path) AS path FROM walk GROUP BY node""")
def include_tree(spark, sf):
    return graph.reach(spark, table(spark, "tex_edges", sf), "main")


_DOWN = ", down(id, seen) AS (SELECT 'seed1', ['seed1'] UNION ALL SELECT s2_id, list_append(seen, s2_id) FROM down JOIN explorations ON parent = id WHERE NOT list_contains(seen, s2_id)) "



@query(fix("explorations") + _DOWN + "SELECT s2_id, s2_id IN (SELECT id FROM down) AS below FROM explorations")
def exploration_ancestry(spark, sf):
    nodes = table(spark, "explorations", sf)
    down = graph.descendants(spark, nodes.select(F.col("s2_id").alias("id"), "parent"), "seed1").select(F.col("id").alias("s2_id"), F.lit(True).alias("below"))
    return nodes.select("s2_id").join(down, "s2_id", "left").select("s2_id", F.coalesce("below", F.lit(False)).alias("below"))


# --- catalogue -----------------------------------------------------------------------------------------------------

_CATALOG = "SELECT d.doc_id, d.lang, d.source, d.n_chars, CASE l.quality WHEN 1 THEN 'verified' WHEN 0 THEN 'manual' ELSE 'review' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)"


def _catalog(spark, sf):
    labels = _read(spark, sf, "labels").select("doc_id", "quality")
    status = F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "manual").otherwise("review")
    return _read(spark, sf, "documents").join(labels, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", status.alias("status"))


@query(f"SELECT * FROM ({_CATALOG}) WHERE status = 'verified' AND lang = 'de'")
def catalog_list_filtered(spark, sf):
    return catalog.catalog_list(_catalog(spark, sf), "doc_id", {"status": "verified", "lang": "de", "source": None})


@query(f"SELECT count(*) AS total, count(*) FILTER (status = 'verified') AS n_verified, count(*) FILTER (status = 'manual') AS n_manual, count(*) FILTER (status = 'review') AS n_review, count(source) AS with_doi FROM ({_CATALOG})")
def catalog_stats(spark, sf):
    return catalog.catalog_stats(_catalog(spark, sf), "status", ("verified", "manual", "review"), "source")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 17")
def catalog_lookup(spark, sf):
    return _read(spark, sf, "documents").where("doc_id = 17").select("doc_id", "lang", "source")


@query("SELECT c_custkey AS content_hash, c_name AS key, o_orderkey AS project_doc FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '2-HIGH'")
def project_papers(spark, sf):
    links = _read(spark, sf, "orders").select(F.col("o_custkey").alias("content_hash"), F.col("o_orderkey").alias("project_doc"), F.col("o_orderpriority").alias("project_id"))
    docs = _read(spark, sf, "customer").select(F.col("c_custkey").alias("content_hash"), F.col("c_name").alias("key"))
    return catalog.project_papers(links, docs, "2-HIGH").select("content_hash", "key", "project_doc")


@query(f"""
WITH f AS (SELECT c.doc_id, left(d.text, 80) AS title, status, list_has_any([c.lang, c.source], ['de', 'src3']) AS tagged FROM ({_CATALOG}) c JOIN documents d USING (doc_id)),
g AS (SELECT doc_id, title FROM f WHERE tagged AND status <> 'manual'),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id)::INT AS rn, count(*) OVER () AS total FROM g)
SELECT * FROM r WHERE rn BETWEEN 51 AND 100""")
def library_list_page(spark, sf):
    text = _read(spark, sf, "documents").select("doc_id", F.left("text", F.lit(80)).alias("title"))
    rows = _catalog(spark, sf).where(F.arrays_overlap(F.array("lang", "source"), F.array(F.lit("de"), F.lit("src3"))) & (F.col("status") != "manual"))
    return ordered.page(rows.join(text, "doc_id").select("doc_id", "title"), ["doc_id"], 2, 50)


@query("SELECT DISTINCT key FROM (SELECT 'Brand#11' AS key UNION ALL SELECT 'extra' UNION ALL SELECT p_name FROM part WHERE p_brand IN ('Brand#12', 'Brand#13'))")
def resolve_keys_union(spark, sf):
    tags = _read(spark, sf, "part").select(F.col("p_name").alias("key"), F.array("p_brand").alias("tags"))
    return catalog.resolve_keys(tags, ["Brand#11", "extra"], None, ["Brand#12", "Brand#13"])


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_hash_dedup(spark, sf):
    return catalog.duplicate_content(_read(spark, sf, "documents"), "doc_id", "text")


@query(fix("first_source", "second_source") + """,
b AS (SELECT a.ord AS oa, s.ord AS ob, coalesce(a.doi, s.doi) AS doi, coalesce(a.title, s.title) AS title, s.is_oa FROM first_source a FULL JOIN second_source s ON lower(a.doi) = lower(s.doi))
SELECT doi, title, is_oa, CASE WHEN oa IS NOT NULL THEN 'first' ELSE 'second' END AS origin FROM b ORDER BY oa NULLS LAST, ob NULLS LAST, title LIMIT 6""")
def federated_merge(spark, sf):
    return catalog.federated_merge(table(spark, "first_source", sf), table(spark, "second_source", sf), 6)


@query(fix("first_source", "second_source") + "SELECT s.doi, s.title, coalesce(lower(s.doi) IN (SELECT lower(doi) FROM first_source WHERE doi IS NOT NULL), false) AS in_library FROM second_source s")
def in_library_flag(spark, sf):
    return catalog.in_library(table(spark, "second_source", sf), table(spark, "first_source", sf)).select("doi", "title", "in_library")


@query(fix("first_source", "rejected") + "SELECT doi, title FROM first_source WHERE lower(trim(doi)) IN (SELECT lower(trim(doi)) FROM rejected)")
def rejected_check(spark, sf):
    bad = table(spark, "rejected", sf).select(ids.normal_doi(F.col("doi")).alias("k"))
    return table(spark, "first_source", sf).withColumn("k", ids.normal_doi(F.col("doi"))).join(bad, "k", "left_semi").select("doi", "title")


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN a.doc_id IS NULL THEN 'removed' WHEN a.n_chars = b.was THEN 'unchanged' ELSE 'changed' END AS change
FROM (SELECT * FROM documents WHERE doc_id % 7 <> 0) a FULL JOIN (SELECT doc_id, n_chars + (doc_id % 5 = 0)::INT AS was FROM documents WHERE doc_id % 3 <> 0) b USING (doc_id)""")
def corpus_sync_classify(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", "n_chars")
    was = d.where("doc_id % 3 <> 0").withColumn("n_chars", F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0))
    return catalog.sync_classify(d.where("doc_id % 7 <> 0"), was, "doc_id", "n_chars")


@query(fix("file_state") + "SELECT path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN now = was THEN 'unchanged' ELSE 'changed' END AS change FROM file_state WHERE now IS NOT NULL OR was IS NOT NULL")
def file_sync_classify(spark, sf):
    t = table(spark, "file_state", sf)
    return catalog.sync_classify(t.where("now IS NOT NULL").select("path", F.col("now").alias("s")), t.where("was IS NOT NULL").select("path", F.col("was").alias("s")), "path", "s")




@query("SELECT coalesce(s_suppkey, p_partkey) AS id, CASE WHEN s_suppkey IS NULL THEN p_name ELSE s_name END AS name FROM supplier FULL JOIN part ON s_suppkey = p_partkey")
def lookup_by_priority(spark, sf):
    first = _read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return catalog.prefer([first, _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))], ["id"])


@query("SELECT count_if(p_name LIKE '% %')::BIGINT AS spaced, count_if(p_name LIKE '% - %')::BIGINT AS dashed, count_if(regexp_matches(p_name, '^[0-9]{2} '))::BIGINT AS numbered, count_if(p_brand IS NULL)::BIGINT AS no_brand FROM part")
def bad_keys(spark, sf):
    n = F.col("p_name")
    return _read(spark, sf, "part").agg(F.count_if(n.like("% %")).alias("spaced"), F.count_if(n.like("% - %")).alias("dashed"), F.count_if(n.rlike("^[0-9]{2} ")).alias("numbered"), F.count_if(F.col("p_brand").isNull()).alias("no_brand"))


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT vec_id FROM embeddings)")
def documents_without_vectors(spark, sf):
    return _read(spark, sf, "documents").select("doc_id").join(_read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang")
def counts_by_type(spark, sf):
    return _read(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


# --- vectors -------------------------------------------------------------------------------------------------------

_DIST = "round(list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)"


def _vector(spark, sf) -> list[float]:
    return _read(spark, sf, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _knn_sql(where: str) -> str:
    return f"SELECT e.vec_id, e.label, {_DIST} AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE {where} ORDER BY distance, vec_id LIMIT 20"


@query(_knn_sql("true"))
def vector_topk(spark, sf):
    return search.nearest(_read(spark, sf, "embeddings"), _vector(spark, sf), 20)


@query(_knn_sql("true"))
def vector_topk_by_cells(spark, sf):
    """The nearest rows by the inverted file: its nearest cells, then those that may hold a nearer row."""
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    vectors.build(_read(spark, sf, "embeddings"), path)
    return vectors.Cells(spark, path).exact(_vector(spark, sf), 20)


@query(_knn_sql("e.label = 3"))
def vector_topk_filtered(spark, sf):
    return search.nearest(_read(spark, sf, "embeddings"), _vector(spark, sf), 20, where=F.col("label") == 3)


@query(_knn_sql("e.label IN (1, 4) AND NOT coalesce(CASE WHEN e.vec_id % 4 = 0 THEN true END, false)"))
def vector_topk_isin(spark, sf):
    rows = _read(spark, sf, "embeddings").withColumn("heavy", F.when(F.col("vec_id") % 4 == 0, True))
    return search.nearest(rows, _vector(spark, sf), 20, where=F.col("label").isin(1, 4) & search.not_true("heavy")).drop("heavy")


@query(f"SELECT * FROM (SELECT * FROM ({_knn_sql('e.label < 5')}) UNION ALL SELECT * FROM ({_knn_sql('e.label >= 5')})) ORDER BY distance, vec_id LIMIT 20")
def merged_search(spark, sf):
    rows, q = _read(spark, sf, "embeddings"), _vector(spark, sf)
    return search.merged([search.nearest(rows, q, 20, where=F.col("label") < 5), search.nearest(rows, q, 20, where=F.col("label") >= 5)], 20, "vec_id")


@query("SELECT label, count(*) AS chunks, max(vec_id) AS last_id FROM embeddings GROUP BY label")
def indexed_files(spark, sf):
    return _read(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("chunks"), F.max("vec_id").alias("last_id"))


# --- text ----------------------------------------------------------------------------------------------------------

# on the shipped texts the compatibility form is the composed one
_NORM = r"trim(regexp_replace(lower(regexp_replace(nfc_normalize(text), '-\s*\n\s*', '', 'g')), '\s+', ' ', 'g'))"



@query(f"""
WITH d AS (SELECT doc_id, text, {_NORM} AS n FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, text, n, unnest(list_filter(range(1, length(n) - 4), lambda i: substr(n, i, 6) = 'th the')) AS pos0 FROM d WHERE contains(n, 'th the')),
s AS (SELECT *, greatest(0, floor((pos0 - 1) * (length(text) / length(n)))::BIGINT - 20) AS a, least(length(text), floor((pos0 + 5) * (length(text) / length(n)))::BIGINT + 20) AS z FROM h)
SELECT doc_id, (pos0 - 1)::INT AS "offset", regexp_replace(substr(text, a + 1, z - a), '^\\s+|\\s+$', '', 'g') AS context FROM s""")
def grep_overlapping(spark, sf):
    return search.grep(_read(spark, sf, "documents"), "th the", ["doc_id"], "text", 20)


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_verification(spark, sf):
    return search.verify_quotes(_read(spark, sf, "benchmark"), _read(spark, sf, "documents"), "item_id", "text", "doc_id", "text")


_PAGED = "(SELECT conv_id AS key, (turn + 1)::BIGINT AS page, text FROM conversations)"


def _pages(spark, sf):
    return _read(spark, sf, "conversations").select(F.col("conv_id").alias("key"), (F.col("turn") + 1).alias("page"), "text")




@query("SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) ELSE 0.0 END, 3) AS ascii_ratio, length(trim(text)) >= 50 AS enough FROM documents")
def quality_gate(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.round(tx.ascii_ratio(F.col("text")), 3).alias("ascii_ratio"), (F.length(F.trim("text")) >= 50).alias("enough"))


@query(fix("keys") + r"""SELECT key, regexp_replace(key, '[/\\:*?"<>|]', '', 'g') AS clean, CASE WHEN regexp_matches(lower(substr(key, 1, 1)), '^[a-z0-9]$') THEN lower(substr(key, 1, 1)) ELSE '_' END AS shard,
 CASE WHEN key = '' THEN 'empty' WHEN length(key) > 100 THEN 'long' WHEN contains(key, '..') THEN 'parent' WHEN regexp_matches(key, '[/\\]') THEN 'separator' WHEN NOT regexp_matches(key, '^[A-Za-z0-9][A-Za-z0-9._-]*$') THEN 'characters' END AS problem FROM keys""")
def key_safety(spark, sf):
    k = F.col("key")
    return table(spark, "keys", sf).select("key", ids.sanitize_key(k).alias("clean"), ids.shard(k).alias("shard"), ids.key_problem(k).alias("problem"))



_TT = r"list_distinct(list_filter(string_split_regex(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2))"
_JAC = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"



_STOP = ", ".join(f"'{w}'" for w in ids.STOP_WORDS)



@query("SELECT p_partkey AS id, left(sha256(p_name), 16) AS cache_key FROM part")
def cache_keys(spark, sf):
    return _read(spark, sf, "part").select(F.col("p_partkey").alias("id"), ids.cache_key(F.col("p_name")).alias("cache_key"))


_SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"WITH s AS (SELECT doc_id, {_SENT} AS s FROM documents) SELECT doc_id, len(s)::INT AS sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::INT AS longest FROM s")
def sentence_split_stats(spark, sf):
    s = tx.sentences(F.col("text"))
    return _read(spark, sf, "documents").select("doc_id", s.alias("s")).select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0)).alias("longest"))


@query()
def chunk_text(spark, sf):
    return search.chunks(_read(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text")


@query(r"""
WITH r AS (SELECT conv_id, turn, unnest(string_split_regex(replace(text, '. ', E'.\n\n'), '\n\s*\n')) AS p, generate_subscripts(string_split_regex(replace(text, '. ', E'.\n\n'), '\n\s*\n'), 1) - 1 AS idx FROM conversations)
SELECT conv_id, turn, idx::INT AS idx, trim(p) AS para FROM r WHERE length(trim(p)) >= 40 AND length(regexp_replace(trim(p), '[^\p{L}]', '', 'g')) / length(trim(p)) >= 0.4""")
def paragraph_segment(spark, sf):
    rows = _read(spark, sf, "conversations").select("conv_id", "turn", F.explode(tx.paragraphs(F.replace("text", F.lit(". "), F.lit(".\n\n")))).alias("x"))
    return rows.select("conv_id", "turn", "x.idx", "x.para")


@query("""SELECT conv_id, turn, list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS around FROM conversations""")
def context_expansion(spark, sf):
    return ordered.around(_read(spark, sf, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"], "turn", 1, "around")



@query(f"SELECT doc_id, {_NORM} AS norm FROM documents")
def normalize_text(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", tx.normalize(F.col("text")).alias("norm"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '-\s*\n\s*', '', 'g'), '\s+', ' ', 'g')) AS quote FROM documents")
def normalize_unicode(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", tx.clean_for_quote(F.col("text")).alias("quote"))


def _proximity_sql(rows: str, words: tuple[str, ...]) -> str:
    """DuckDB: share of words found, less the wider the least window of all found (``rows``: id, text)."""
    last = ", ".join(f"max(CASE WHEN tok = '{w}' THEN i END) OVER (PARTITION BY id ORDER BY i) AS l{k}" for k, w in enumerate(words))
    n = len(words)
    return f"""r AS ({rows}), w AS (SELECT id, list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '') AS ws FROM r),
u AS (SELECT id, unnest(ws) AS tok, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM w), h AS (SELECT * FROM u WHERE tok IN {words}),
f AS (SELECT id, count(DISTINCT tok) AS found, max(n) AS n FROM h GROUP BY id), l AS (SELECT id, i, {last} FROM h),
b AS (SELECT l.id, f.found, min(i - least({", ".join(f"l{k}" for k in range(n))}) + 1) AS best FROM l JOIN f USING (id) WHERE {" + ".join(f"(l{k} IS NOT NULL)::INT" for k in range(n))} = f.found GROUP BY l.id, f.found),
s AS (SELECT id, CASE WHEN found = 1 THEN 0.3::DOUBLE / {n} ELSE found / {n} * least(1.0::DOUBLE, ln(found + 1) / ln(best + 1)) END AS score FROM b)"""


@query("WITH " + _proximity_sql("SELECT doc_id AS id, text FROM documents", ("the", "and", "of", "with")) + " SELECT id AS doc_id, round(score, 6) AS score FROM s WHERE round(score, 6) >= 0.3")
def token_proximity(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", F.round(search.proximity("the and of with", F.col("text")), 6).alias("score")).where("score >= 0.3")


@query()
def fuzzy_title_dedup(spark, sf):
    """Titles of every fiftieth page, as new ones, against those of all other pages: the first that is much the same. No SQL:
    tested by brute force."""
    titles = _read(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    new = titles.where("page_id % 50 = 0")
    first = simjoin.first_hits(new, "page_id", "title", titles, "page_id", "title", other=True)
    return new.select("page_id").join(first, "page_id", "left").select("page_id", "known_key", "ratio", F.coalesce("hits", F.lit(0)).alias("hits"))



@query("""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS ws FROM documents)
SELECT doc_id, array_to_string(ws, ' ') AS abstract FROM w""")
def inverted_index_reconstruct(spark, sf):
    d = _read(spark, sf, "documents").select("doc_id", "text")
    # texts are shuffled once, whole; words then meet where they lie, in parts of some 16 MB
    n = max(tasks_for(d), -(-(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // (16 << 20)))
    d = d.repartition(n, "doc_id").select("doc_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("at", "word"))
    inverted = d.groupBy("doc_id", "word").agg(F.collect_list("at").alias("positions"))
    return structure.rebuild_abstract(inverted, "doc_id")


# --- ordered -------------------------------------------------------------------------------------------------------


@query("SELECT c.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON c.user_id = v.user_id AND c.ts >= v.ts")
def asof_nearest(spark, sf):
    ev = _read(spark, sf, "events")
    clicks = ev.where("event_type = 'click'").select("user_id", "ts", "event_id")
    views = ev.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return ordered.asof(clicks, views, ["user_id"], "ts", ["view_id"]).select("event_id", "view_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM events")
def forward_fill(spark, sf):
    ev = _read(spark, sf, "events").withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return ordered.forward_fill(ev, ["user_id"], ["ts", "event_id"], "mark", "carried").select("event_id", "carried")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_wins(spark, sf):
    return ordered.keep_one(_read(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def last_wins(spark, sf):
    return ordered.keep_one(_read(spark, sf, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).drop("ts")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' ELSE p_name END AS p_name FROM part UNION ALL SELECT -1, 'added'")
def upsert_catalog(spark, sf):
    old = _read(spark, sf, "part").select("p_partkey", "p_name")
    new = old.where("p_partkey % 3 = 0").select("p_partkey", F.lit("new").alias("p_name")).unionAll(spark.sql("SELECT -1L AS p_partkey, 'added' AS p_name"))
    return ordered.upsert(old, new, ["p_partkey"], ["p_name"])



_AT = r"'^@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@'"
_HUNKS = f""", c AS (SELECT *, sum(regexp_matches(text, {_AT})::INT) OVER (PARTITION BY file ORDER BY line) AS hunk FROM diff_lines), g AS (SELECT *, regexp_matches(text, {_AT}) AS b FROM c WHERE hunk > 0),
k AS (SELECT file, hunk::BIGINT AS hunk, max(CASE WHEN b THEN regexp_extract(text, {_AT}, 3)::BIGINT END) AS start, max(CASE WHEN b THEN coalesce(nullif(regexp_extract(text, {_AT}, 4), ''), '1')::BIGINT END) AS lines,
 max(CASE WHEN b THEN regexp_extract(text, {_AT}, 1)::BIGINT END) AS old_start, max(CASE WHEN b THEN coalesce(nullif(regexp_extract(text, {_AT}, 2), ''), '1')::BIGINT END) AS old_lines,
 count_if(starts_with(text, '+') AND NOT starts_with(text, '+++'))::BIGINT AS added, count_if(starts_with(text, '-') AND NOT starts_with(text, '---'))::BIGINT AS removed FROM g GROUP BY file, hunk)"""


@query(fix("diff_lines") + _HUNKS + " SELECT * FROM k")
def diff_hunks(spark, sf):
    return structure.diff_hunks(table(spark, "diff_lines", sf))


@query(fix("diff_lines") + _HUNKS + " SELECT file, count(*) AS hunks, sum(added)::BIGINT AS added, sum(removed)::BIGINT AS removed FROM k GROUP BY ROLLUP (file)")
def diff_totals(spark, sf):
    return structure.diff_totals(structure.diff_hunks(table(spark, "diff_lines", sf)))


# --- tasks and freshness ---------------------------------------------------------------------------------------------

_TASKS = """
WITH c AS (SELECT user_id::VARCHAR AS task, event_type AS file, max(ts) AS done FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2),
p AS (SELECT DISTINCT user_id::VARCHAR AS task, event_type AS file, user_id % 4 * 24 AS cadence, user_id % 5 = 0 AS changed FROM events),
h AS (SELECT p.*, c.done, (epoch_us(TIMESTAMP '2024-02-01') - epoch_us(c.done)) / 3600000000 AS hours FROM p LEFT JOIN c USING (task, file)),
s AS (SELECT task, file, CASE WHEN done IS NULL THEN 1000.0 WHEN changed THEN 100.0::DOUBLE + CASE WHEN cadence > 0 THEN hours / cadence ELSE 0.0::DOUBLE END ELSE CASE WHEN cadence > 0 THEN hours / cadence ELSE 0.0::DOUBLE END END AS score FROM h)
SELECT task, file, round(score, 6)::DOUBLE AS score FROM s WHERE score > 0 ORDER BY s.score DESC, file, task LIMIT 50"""


@query(_TASKS)
def task_ranking(spark, sf):
    ev = _read(spark, sf, "events").withColumn("task", F.col("user_id").cast("string")).withColumn("file", F.col("event_type"))
    done = ev.where("ts < TIMESTAMP '2024-01-20'").groupBy("task", "file").agg(F.max("ts").cast("timestamp").alias("done"))
    items = ev.select("task", "file", (F.col("user_id") % 4 * 24).alias("cadence"), (F.col("user_id") % 5 == 0).alias("changed")).distinct()
    score = tasks.task_score(F.col("done"), F.lit(NOW).cast("timestamp"), F.col("cadence"), F.col("changed"))
    return tasks.rank(items.join(done, ["task", "file"], "left").withColumn("score", score), 50).select("task", "file", F.round("score", 6).alias("score"))


@query(fix("api_cache") + "SELECT service, kind, identifier, coalesce((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(try_cast(fetched_at AS TIMESTAMP))) / 86400000000 > ttl_days, false) AS expired FROM api_cache")
def ttl_expired(spark, sf):
    e = tasks.expired(F.col("fetched_at"), F.col("ttl_days"), F.lit("2024-03-01").cast("timestamp"))
    return table(spark, "api_cache", sf).select("service", "kind", "identifier", e.alias("expired"))


@query(fix("api_cache") + "SELECT service, kind, count(*) AS entries, sum(bytes)::BIGINT AS bytes FROM api_cache GROUP BY ROLLUP (service, kind)")
def cache_stats(spark, sf):
    return tasks.cache_stats(table(spark, "api_cache", sf), "service", "kind", "bytes")


@query(fix("summaries", "commits") + """, f AS (SELECT DISTINCT file FROM (SELECT file FROM summaries UNION ALL SELECT file FROM commits)), c AS (SELECT f.file, s.file IS NOT NULL AS has, try_cast(s.updated AS TIMESTAMP) AS t FROM f LEFT JOIN summaries s USING (file)),
n AS (SELECT c.file, has, t, coalesce(count_if(k.made::TIMESTAMP > t), 0)::BIGINT AS later FROM c LEFT JOIN commits k USING (file) GROUP BY ALL)
SELECT file, CASE WHEN NOT has THEN 'missing' WHEN t IS NULL THEN 'unknown' WHEN later > 0 THEN 'stale' ELSE 'fresh' END AS status, later FROM n""")
def summary_staleness(spark, sf):
    s, c = table(spark, "summaries", sf), table(spark, "commits", sf).withColumn("made", F.to_timestamp("made"))
    files = s.select("file").union(c.select("file")).distinct()
    own = files.join(s.select("file", F.lit(True).alias("has"), F.try_to_timestamp("updated").alias("t")), "file", "left").join(c, "file", "left")
    n = own.groupBy("file", "has", "t").agg(F.count_if(F.col("made") > F.col("t")).alias("later"))
    status = F.when(F.col("has").isNull(), "missing").when(F.col("t").isNull(), "unknown").when(F.col("later") > 0, "stale").otherwise("fresh")
    return n.select("file", status.alias("status"), "later")



@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS calls, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def log_window_counts(spark, sf):
    w = _read(spark, sf, "events").groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.col("window.start").alias("hour"), "calls", "total")


@query("SELECT event_type, user_id, value, rn FROM (SELECT *, row_number() OVER (ORDER BY value DESC, event_id)::INT AS rn, count(*) OVER () AS n FROM events) WHERE rn <= 30")
def truncated_result(spark, sf):
    ev = _read(spark, sf, "events")
    return ordered.page(ev, [F.desc("value"), "event_id"], 1, 30).select("event_type", "user_id", "value", "rn")


# --- structure -----------------------------------------------------------------------------------------------------


@query(fix("packages", "local_files") + ", c AS (SELECT name, unnest([name || '.sty', 'tex/' || name || '.sty', name || '.cls', 'tex/' || name || '.cls']) AS file FROM packages) SELECT name, file FROM c WHERE file IN (SELECT file FROM local_files)")
def local_packages(spark, sf):
    n = F.col("name")
    c = table(spark, "packages", sf).select("name", F.explode(F.array(*(F.concat(F.lit(d), n, F.lit(e)) for e in (".sty", ".cls") for d in ("", "tex/")))).alias("file"))
    return c.join(table(spark, "local_files", sf), "file", "left_semi").select("name", "file")


@query(fix("idx_entries") + "SELECT term, coalesce(subterm, '') AS subterm, coalesce(string_agg(DISTINCT CASE WHEN see_target IS NULL THEN page END::VARCHAR, ',' ORDER BY page::VARCHAR) FILTER (see_target IS NULL), '') AS pages, coalesce(string_agg(DISTINCT see_target, ',' ORDER BY see_target), '') AS see FROM (SELECT * FROM idx_entries) GROUP BY 1, 2".replace("string_agg(DISTINCT CASE WHEN see_target IS NULL THEN page END::VARCHAR, ',' ORDER BY page::VARCHAR) FILTER (see_target IS NULL)", "array_to_string(list_sort(list(DISTINCT page) FILTER (see_target IS NULL)), ',')"))
def index_build(spark, sf):
    return structure.build_index(table(spark, "idx_entries", sf))


@query(fix("idx_entries") + ", t AS (SELECT DISTINCT term, coalesce(subterm, '') AS s FROM idx_entries), g AS (SELECT term, contains(lower(term), 'entropy') AS own, coalesce(string_agg(s, ',' ORDER BY s) FILTER (contains(lower(s), 'entropy')), '') AS subs FROM t GROUP BY term) SELECT term, CASE WHEN own THEN '' ELSE subs END AS matched_subterms FROM g WHERE own OR subs <> ''")
def index_search(spark, sf):
    return structure.search_index(structure.build_index(table(spark, "idx_entries", sf)), "entropy")



@query(r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS heading,
 len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INT AS links, len(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)))::INT AS distinct_links FROM pages""")
def html_headings_links(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    return _read(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1[^>]*>([^<]*)</h1>", 1).alias("heading"), F.size(links).alias("links"), F.size(F.array_distinct(links)).alias("distinct_links"))


@query(fix("guides") + """, r AS (SELECT slug, CASE WHEN slug = 'paper' THEN 1 WHEN starts_with(slug, 'paper') THEN 2 WHEN contains(slug, 'paper') THEN 3 WHEN contains(description, 'paper') THEN 4 END AS rank FROM guides) SELECT slug, rank FROM r WHERE rank IS NOT NULL ORDER BY rank, slug LIMIT 1""")
def guide_topic(spark, sf):
    s = F.col("slug")
    rank = F.when(s == "paper", 1).when(s.startswith("paper"), 2).when(s.contains("paper"), 3).when(F.col("description").contains("paper"), 4)
    return table(spark, "guides", sf).select("slug", rank.alias("rank")).where("rank IS NOT NULL").orderBy("rank", "slug").limit(1)



@query(fix("spans") + ", m AS (SELECT *, max(size) FILTER (length(trim(text)) >= 3) OVER (PARTITION BY doc) AS top FROM spans), t AS (SELECT doc, string_agg(trim(text), ' ' ORDER BY y) AS title FROM m WHERE size >= top - 1 AND length(trim(text)) >= 3 GROUP BY doc) SELECT doc, title FROM t WHERE length(title) BETWEEN 10 AND 500")
def title_by_font_size(spark, sf):
    s = table(spark, "spans", sf).where(F.length(F.trim("text")) >= 3).withColumn("top", F.max("size").over(Window.partitionBy("doc")))
    t = s.where("size >= top - 1").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("title"))
    return t.where(F.length("title").between(10, 500))



@query("SELECT key, text FROM (SELECT conv_id AS key, turn, text FROM conversations) WHERE turn = 0")
def first_page_text(spark, sf):
    return _pages(spark, sf).where("page = 1").select("key", "text")


@query("SELECT conv_id AS key, string_agg(text, E'\\n\\n' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def read_all_pages(spark, sf):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]), "\n\n")
    return _pages(spark, sf).groupBy("key").agg(joined.alias("text"))


@query("SELECT user_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS v, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY 1, 2")
def json_shaping(spark, sf):
    m = F.from_json("props", "map<string,string>")
    first = F.element_at(F.map_values(m), 1)
    return _read(spark, sf, "events").where("props IS NOT NULL").groupBy("user_id", first.alias("v")).agg(F.count("*").alias("n"))


# --- composed reads --------------------------------------------------------------------------------------------------




@query(fix("patches", "bib_rows") + """, p AS (SELECT key, CASE WHEN json_valid(data) THEN json_extract_string(data, '$.title') END AS t, CASE WHEN json_valid(data) THEN json_extract_string(data, '$.year') END AS y, CASE WHEN json_valid(data) THEN json_extract_string(data, '$.doi') END AS d FROM patches)
SELECT b.key, coalesce(t, title) AS title, coalesce(y, year) AS year, coalesce(d, doi) AS doi, CASE WHEN d IS NOT NULL AND d IS DISTINCT FROM doi THEN 'unchecked' ELSE status END AS status FROM bib_rows b LEFT JOIN p USING (key)""")
def metadata_patch(spark, sf):
    p = table(spark, "patches", sf).select("key", F.from_json("data", "title string, year string, doi string").alias("p"))
    own = table(spark, "bib_rows", sf).join(p, "key", "left")
    changed = F.col("p.doi").isNotNull() & ~F.col("p.doi").eqNullSafe(F.col("doi"))
    return own.select("key", F.coalesce("p.title", "title").alias("title"), F.coalesce("p.year", "year").alias("year"), F.coalesce("p.doi", "doi").alias("doi"), F.when(changed, "unchecked").otherwise(F.col("status")).alias("status"))




_PARAS = "SELECT doc_id, unnest(string_split(text, chr(10))) AS para, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS nth FROM documents"


@query(f"""WITH p0 AS ({_PARAS}), p AS (SELECT doc_id, nth, para, contains(lower(trim(regexp_replace(nfc_normalize(para), '\\s+', ' ', 'g'))), 'of the and') AS exact FROM p0 WHERE length(para) >= 40),
q AS (SELECT *, max(exact::INT) OVER (PARTITION BY doc_id) = 1 AS verbatim FROM p), """ + _proximity_sql("SELECT {'d': doc_id, 'a': nth} AS id, para AS text FROM q WHERE NOT verbatim", ("of", "the", "and")) + """
SELECT doc_id, para, 1.0::DOUBLE AS score FROM q WHERE exact UNION ALL SELECT q.doc_id, q.para, round(s.score, 6) FROM q JOIN s ON s.id.d = q.doc_id AND s.id.a = q.nth WHERE round(s.score, 6) >= 0.3""")
def two_tier_search(spark, sf):
    """Paragraphs that hold the query verbatim; only where a document has none, those with enough of its words close by."""
    rows = _read(spark, sf, "documents").select("doc_id", F.explode(F.split("text", r"\n")).alias("para")).where(F.length("para") >= 40)
    exact = F.when(F.contains(tx.normalize(F.col("para")), F.lit("of the and")), 1.0).otherwise(0.0)
    rows = rows.withColumn("exact", exact).withColumn("best", F.max("exact").over(Window.partitionBy("doc_id")))
    near = search.proximity("of the and", F.col("para"))
    scored = rows.where("exact = 1.0 OR best = 0.0").withColumn("score", F.round(F.when(F.col("exact") == 1.0, F.lit(1.0)).otherwise(near), 6))
    return scored.where("score >= 0.3").select("doc_id", "para", "score")



@query(r"""
WITH t0 AS (SELECT conv_id, (turn + 1)::BIGINT AS page, string_split_regex(replace(text, '. ', chr(46) || chr(10) || chr(10)), '\n\s*\n') AS ps FROM conversations),
u0 AS (SELECT conv_id, page, unnest(ps) AS p, unnest(range(0, len(ps))) AS idx FROM t0), v0 AS (SELECT conv_id, page, idx, trim(p) AS para FROM u0 WHERE length(trim(p)) >= 40 AND length(regexp_replace(trim(p), '[^\p{L}]', '', 'g')) / length(trim(p)) >= 0.4),
o0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY page, idx) AS nth, trim(regexp_replace(regexp_replace(nfc_normalize(para), '-\s*\n\s*', '', 'g'), '\s+', ' ', 'g')) AS clean FROM v0),
q0 AS (SELECT *, contains(lower(clean), 'of the') AS exact FROM o0), f0 AS (SELECT *, max(exact::INT) OVER (PARTITION BY conv_id) = 1 AS verbatim FROM q0), """ + _proximity_sql("SELECT {'c': conv_id, 'n': nth} AS id, lower(clean) AS text FROM f0 WHERE NOT verbatim", ("of", "the")) + r""",
h0 AS (SELECT conv_id, nth, page, 1.0::DOUBLE AS score FROM f0 WHERE exact UNION ALL SELECT conv_id, nth, page, s.score FROM f0 JOIN s ON s.id.c = conv_id AND s.id.n = nth WHERE NOT verbatim AND s.score >= 0.3),
k0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, nth)::INT AS rank FROM h0),
g0 AS (SELECT k0.conv_id, k0.rank, k0.page, k0.score, f0.page AS pg, string_agg(f0.clean, chr(10) || chr(10) ORDER BY f0.nth) AS says FROM k0 JOIN f0 ON f0.conv_id = k0.conv_id AND f0.nth BETWEEN k0.nth - 1 AND k0.nth + 1 WHERE rank <= 5 GROUP BY ALL)
SELECT conv_id, rank, page, round(score, 3) AS score, list(pg ORDER BY pg) AS pages, list(says ORDER BY pg) AS texts FROM g0 GROUP BY conv_id, rank, page, score""")
def paragraph_context(spark, sf):
    """The best paragraphs of each document for a query, with the paragraphs around them by page."""
    pages = _pages(spark, sf).select(F.col("key").alias("conv_id"), "page", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text"))
    return search.paragraph_matches(pages, "conv_id", "page", "text", "of the", 3)


@query()
def semantic_chunk_pages(spark, sf):
    """Pages cut where neighbouring sentences differ. No SQL: tested by brute force."""
    return register.semantic_pages(_pages(spark, sf), "key", "page", "text", register.hashing_embedder(64), 40, 0.1)


_STORE = """, u AS (SELECT doc_id, CASE WHEN doc_id % 14 = 3 THEN 'xx' ELSE lang END AS lang, n_chars + CASE WHEN doc_id % 11 = 0 AND doc_id % 14 <> 3 THEN 1 ELSE 0 END AS n FROM documents WHERE doc_id % 7 <> 3 OR doc_id % 14 = 3),
r AS (SELECT 'catalog' AS name, doc_id AS key, lang || ' ' || n AS val FROM u UNION ALL SELECT 'bib', doc_id, CASE WHEN doc_id % 11 = 0 THEN 2 ELSE quality END::VARCHAR FROM labels WHERE doc_id % 7 <> 3
UNION ALL SELECT 'raw', doc_id, left(text, 30) FROM documents WHERE doc_id % 7 <> 3 UNION ALL SELECT 'archive', page_id, url FROM pages WHERE page_id % 7 <> 3
UNION ALL SELECT 'vectors', vec_id, label::VARCHAR FROM embeddings WHERE vec_id % 7 <> 3 UNION ALL SELECT 'manifest', doc_id, source FROM documents WHERE doc_id % 7 <> 3)
SELECT name, key, val FROM r"""


@query("WITH none AS (SELECT 1)" + _STORE)
def store_cascade(spark, sf):
    """Six tables after an upsert into two, a removal from all, and a paper that comes back, resolved at read."""
    read = lambda t: _read(spark, sf, t)
    docs, labels = read("documents"), read("labels")
    row = "key long, val string"
    tables = {
        "catalog": docs.select(F.col("doc_id").alias("key"), F.concat_ws(" ", "lang", "n_chars").alias("val")),
        "bib": labels.select(F.col("doc_id").alias("key"), F.col("quality").cast("string").alias("val")),
        "raw": docs.select(F.col("doc_id").alias("key"), F.left("text", F.lit(30)).alias("val")),
        "archive": read("pages").select(F.col("page_id").alias("key"), F.col("url").alias("val")),
        "vectors": read("embeddings").select(F.col("vec_id").alias("key"), F.col("label").cast("string").alias("val")),
        "manifest": docs.select(F.col("doc_id").alias("key"), F.col("source").alias("val")),
    }
    s = Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", {n: ("key", row) for n in tables})
    s.upsert(tables)
    changed = docs.where("doc_id % 11 = 0").select(F.col("doc_id").alias("key"), F.concat_ws(" ", "lang", F.col("n_chars") + 1).alias("val"))
    s.upsert({"catalog": changed, "bib": labels.where("doc_id % 11 = 0").select(F.col("doc_id").alias("key"), F.lit("2").alias("val"))})
    every = docs.select(F.col("doc_id").alias("key")).unionAll(read("pages").select("page_id")).unionAll(read("embeddings").select("vec_id"))
    s.remove(every.where("key % 7 = 3").distinct())
    s.compact("raw")
    s.upsert({"catalog": docs.where("doc_id % 14 = 3").select(F.col("doc_id").alias("key"), F.concat_ws(" ", F.lit("xx"), "n_chars").alias("val"))})
    out = None
    for n in tables:
        part = s.read(n).select(F.lit(n).alias("name"), "key", "val")
        out = part if out is None else out.unionAll(part)
    return out


@query()
def quote_score(spark, sf):
    """Best token-set ratio of each whole benchmark item among all sentences of each document, from 0.8."""
    quotes = _read(spark, sf, "benchmark").select(F.concat(F.lit("q"), F.col("item_id")).alias("k"), F.col("text").alias("t"))
    texts = _read(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id")).alias("k2"), "text")
    return search.score_quotes(quotes, texts, "k", "t", "k2", "text", 0.8)


from parchmint.plans import intake, library, manuscripts  # noqa: E402, F401  (they register their queries)
