"""A library's own state as tables: bibliography entries, notes, figures, rejected identifiers, cached responses, paper view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import ids
from parchmint.operators.catalog import DuplicateKey


class UnknownKey(KeyError):
    """A key that the table lacks."""


# --- bibliography entries: key, type, fields map -----------------------------------------------------------------------


def set_field(entries: DataFrame, key: str, field: str, value: str) -> DataFrame:
    new = F.map_concat(F.map_filter("fields", lambda k, _: k != field), F.create_map(F.lit(field), F.lit(value)))
    return entries.withColumn("fields", F.when(F.col("key") == key, new).otherwise(F.col("fields")))


def remove_field(entries: DataFrame, key: str, field: str) -> DataFrame:
    return entries.withColumn("fields", F.when(F.col("key") == key, F.map_filter("fields", lambda k, _: k != field)).otherwise(F.col("fields")))


def _has(entries: DataFrame, key: str) -> bool:
    return not entries.where(F.col("key") == key).limit(1).isEmpty()


def add_entry(entries: DataFrame, key: str, kind: str = "article", fields: Mapping[str, str] | None = None) -> DataFrame:
    """``entries`` with one more; an existing key raises ``DuplicateKey``."""
    if _has(entries, key):
        raise DuplicateKey(key)
    new = entries.sparkSession.createDataFrame([(key, kind, dict(fields or {}))], "key string, type string, fields map<string,string>")
    return entries.unionByName(new, allowMissingColumns=True)


def remove_entry(entries: DataFrame, key: str) -> DataFrame:
    if not _has(entries, key):
        raise UnknownKey(key)
    return entries.where(F.col("key") != key)


def rename_key(entries: DataFrame, old: str, new: str) -> DataFrame:
    """``entries`` with ``old`` as ``new``: raises ``UnknownKey`` or ``DuplicateKey``."""
    if not _has(entries, old):
        raise UnknownKey(old)
    if _has(entries, new):
        raise DuplicateKey(new)
    return entries.withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key")))


def doi_status(doi: Column, registry_title: Column, title_passed: Column) -> Column:
    """missing, verified (the registry's title is in the document), mismatch, or unchecked (the registry gave none)."""
    return F.when(F.coalesce(doi, F.lit("")) == "", "missing").when(F.coalesce(registry_title, F.lit("")) == "", "unchecked").when(F.coalesce(title_passed, F.lit(False)), "verified").otherwise("mismatch")


# --- related documents and keys ----------------------------------------------------------------------------------------


def related(keys: DataFrame) -> DataFrame:
    """``key, other, relation, direction``: for every key the parent that its suffix names, and its children, where they
    exist. One equi-join."""
    child = keys.select("key", F.regexp_extract("key", ids.RELATED_SUFFIX, 1).alias("parent"), F.regexp_extract("key", ids.RELATED_SUFFIX, 2).alias("relation")).where("parent <> ''")
    both = child.join(keys.select(F.col("key").alias("parent")).distinct(), "parent")
    up = both.select("key", F.col("parent").alias("other"), "relation", F.lit("parent").alias("direction"))
    return up.unionAll(both.select(F.col("parent").alias("key"), F.col("key").alias("other"), "relation", F.lit("child").alias("direction")))


def parent_candidates(papers: DataFrame, keys: DataFrame, parts: int = 4) -> DataFrame:
    """``id, key`` of keys that begin with a paper's surname and year (``papers(id, surname, year)``). Both sides meet on the
    beginnings of keys that are as long as a paper's. All pairs are asked for, so the few prefixes are cut into ``parts``
    of papers by ``parts`` of keys and dealt over all tasks."""
    tasks = max(papers.sparkSession.sparkContext.defaultParallelism, int(papers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = papers.select("id", F.concat(F.lower("surname"), F.col("year").cast("string")).alias("prefix"))
    head = keys.join(F.broadcast(own.select(F.length("prefix").alias("n")).distinct()), F.length("key") >= F.col("n")).select("key", F.col("key").substr(F.lit(1), F.col("n")).alias("prefix"))
    every, part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))), lambda c: F.pmod(F.hash(c), F.lit(parts))
    cell = ["prefix", "paper_part", "key_part"]
    own = own.withColumn("paper_part", part("id")).withColumn("key_part", every)
    head = head.withColumn("key_part", part("key")).withColumn("paper_part", every)
    return own.repartition(tasks, *cell).join(head.repartition(tasks, *cell), cell).select("id", "key")


def children_from_notes(notes: DataFrame) -> DataFrame:
    """``parent, key`` from notes (``key, field, value``) whose field ``parent`` names another key."""
    return notes.where("field = 'parent' AND value <> '' AND value <> key").select(F.col("value").alias("parent"), "key")


def resolve_ids(asked: DataFrame, papers: DataFrame) -> DataFrame:
    """``asked (id)`` to ``id, key``: by identifier (without case, trimmed), else by the graph service's id; the least key
    where several papers hold one."""
    by_doi = papers.where("doi IS NOT NULL").groupBy(ids.normal_doi(F.col("doi")).alias("k")).agg(F.min("key").alias("by_doi"))
    by_s2 = papers.where("s2_id IS NOT NULL").groupBy(F.col("s2_id").alias("id")).agg(F.min("key").alias("by_s2"))
    return asked.withColumn("k", ids.normal_doi(F.col("id"))).join(by_doi, "k", "left").join(by_s2, "id", "left").select("id", F.coalesce("by_doi", "by_s2").alias("key"))


# --- notes, figures, rejected identifiers --------------------------------------------------------------------------------


def save_notes(notes: DataFrame, new: DataFrame, allowed: Sequence[str] | None = None) -> DataFrame:
    """Notes (``key, field, value``) with a key's fields replaced by its new ones: empty values go, and so do keys all of
    whose new values are empty; fields outside of ``allowed`` are left out."""
    good = new.where("value <> ''")
    if allowed is not None:
        good = good.where(F.col("field").isin(*allowed))
    return notes.join(new.select("key").distinct(), "key", "left_anti").unionByName(good.select(*notes.columns))


def request_figures(figures: DataFrame, new: DataFrame) -> DataFrame:
    """Figures (``key, figure, page, reason, caption, status``) with requests: one that is captured already stays, another is
    ``requested`` anew; what a request leaves out is kept."""
    n = new.select("key", "figure", *(F.col(c).alias(f"__{c}") for c in ("page", "reason", "caption")), F.lit(True).alias("__new"))
    both = figures.join(n, ["key", "figure"], "full_outer")
    keep = lambda c: F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c)
    status = F.when(F.col("status") == "captured", "captured").when(F.col("__new"), "requested").otherwise(F.col("status"))
    return both.select("key", "figure", keep("page"), keep("reason"), keep("caption"), status.alias("status"))


def register_figures(figures: DataFrame, files: DataFrame) -> DataFrame:
    """Figures with captured files (``key, figure, file``): a request becomes ``captured``, an unknown figure is added."""
    f = files.select("key", "figure", F.col("file").alias("__file"))
    out = (figures if "file" in figures.columns else figures.withColumn("file", F.lit(None).cast("string"))).join(f, ["key", "figure"], "full_outer")
    return out.withColumns({"status": F.when(F.col("__file").isNotNull(), "captured").otherwise(F.col("status")), "file": F.coalesce("__file", "file")}).drop("__file")


def reject(rejected: DataFrame, new: DataFrame, today: str) -> DataFrame:
    """Rejected identifiers (``doi, key, reason, date``) with new ones: one that is there keeps its date and spelling and takes
    a reason and key that aren't empty; a new one has today's date and a reason of its own or the usual one. Case doesn't
    count."""
    n = new.select(ids.normal_doi(F.col("doi")).alias("k"), F.trim("doi").alias("__doi"), F.coalesce("key", F.lit("")).alias("__key"), F.coalesce("reason", F.lit("")).alias("__reason")).where("k IS NOT NULL")
    both = rejected.withColumn("k", ids.normal_doi(F.col("doi"))).join(n.dropDuplicates(["k"]), "k", "full_outer")
    given = lambda c, usual: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c), F.lit(usual)).alias(c)
    return both.select(F.coalesce("doi", "__doi").alias("doi"), given("key", ""), given("reason", "DOI does not resolve"), F.coalesce("date", F.lit(today)).alias("date"))


def unreject(rejected: DataFrame, doi: str) -> DataFrame:
    return rejected.where(~F.coalesce(ids.normal_doi(F.col("doi")) == doi.strip().lower(), F.lit(False)))


# --- cached API responses ------------------------------------------------------------------------------------------------

# Days that a cached response of a service and kind stays good, and seconds between two calls.
TTL_DAYS = {"crossref": 30, "s2/paper": 30, "s2/search": 7, "s2/citations": 14, "s2/references": 14, "openalex/doi": 30, "openalex/search": 7}
USUAL_TTL = 30
THROTTLE_SECONDS = {"crossref": 0.1, "s2": 1.0, "openalex": 0.1}


def ttl(service: Column, kind: Column, given: Column | None = None) -> Column:
    """Days that a response stays good: what is given, else by service and kind."""
    table = F.create_map(*(F.lit(x) for kv in TTL_DAYS.items() for x in kv))
    name = F.when(F.coalesce(kind, F.lit("")) == "", service).otherwise(F.concat_ws("/", service, kind))
    usual = F.coalesce(F.try_element_at(table, name), F.lit(USUAL_TTL))
    return usual if given is None else F.coalesce(given, usual)


def cache_put(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Envelopes (``service, kind, identifier, fetched_at, data``) with newly fetched ones in place of old ones of the same
    key (identifiers without case); of several new ones the last fetched. ``ttl_days`` and ``cache_key`` are filled in."""
    keys = ["service", "kind", "cache_key"]
    own = fetched.withColumns({"cache_key": ids.cache_key(ids.normal_doi(F.col("identifier"))), "ttl_days": ttl(F.col("service"), F.col("kind"))})
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("fetched_at"), "data"))
    fresh = own.withColumn("__rn", last).where("__rn = 1").drop("__rn")
    return cache.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*cache.columns))


def cache_get(cache: DataFrame, asked: DataFrame, now: str) -> DataFrame:
    """``asked (service, kind, identifier)`` with ``data``: null where the cache has none or what it has is too old; a date
    that can't be read counts as fresh."""
    own = asked.withColumn("cache_key", ids.cache_key(ids.normal_doi(F.col("identifier"))))
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.try_to_timestamp("fetched_at"))) / 86_400_000_000
    good = cache.where(~F.coalesce(age > F.col("ttl_days"), F.lit(False))).select("service", "kind", "cache_key", "data")
    return own.join(good, ["service", "kind", "cache_key"], "left").select("service", "kind", "identifier", "data")


def cache_drop(cache: DataFrame, service: str = "", kind: str = "", identifier: str = "") -> DataFrame:
    """The cache without one entry, a kind, a service, or all."""
    gone = F.lit(True)
    if service:
        gone = gone & (F.col("service") == service)
    if service and kind:
        gone = gone & (F.col("kind") == kind)
    if identifier:
        gone = gone & (F.col("cache_key") == ids.cache_key(F.lit(identifier.strip().lower())))
    return cache.where(~F.coalesce(gone, F.lit(False)))


def throttled(calls: DataFrame, digits: int = 6) -> DataFrame:
    """``calls (service, at double)`` with ``waits``: how long each would have had to wait for its service's interval, rounded
    once. A call that waits moves those behind it: start(i) = max(at(i), start(i - 1) + interval) = i * interval + max over
    j <= i of at(j) - j * interval, a running maximum. Intervals are decimals, so their multiples are exact."""
    table = F.create_map(*(F.lit(x) for k, v in THROTTLE_SECONDS.items() for x in (k, Decimal(str(v)))))
    w = Window.partitionBy("service").orderBy("at")
    own = calls.withColumns({"gap": F.coalesce(F.try_element_at(table, F.col("service")), F.lit(Decimal("0.0"))), "i": F.row_number().over(w)})
    own = own.withColumn("gaps", (F.col("i") * F.col("gap")).cast("double"))
    start = F.col("gaps") + F.max(F.col("at") - F.col("gaps")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return own.select("service", "at", F.round(start - F.col("at"), digits).alias("waits"))


# --- views -----------------------------------------------------------------------------------------------------------------


def paper_view(papers: DataFrame, figures: DataFrame, notes: DataFrame, pages: DataFrame, extras: DataFrame) -> DataFrame:
    """One row a paper (``key, title, tags, doi_status, has_pdf``): figures, notes' titles, pages, the graph's extras
    (``key, s2_id, citation_count, abstract``), related papers, and a warning for those with a retraction. Every side is
    aggregated by key before it is joined."""
    list_ = lambda df, c, to: df.groupBy("key").agg(F.array_sort(F.collect_set(c)).alias(to))
    rel = related(papers.select("key")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("direction", "relation", "other"))).alias("related"))
    out = papers.join(list_(figures, "figure", "figures"), "key", "left").join(list_(notes, "title", "note_titles"), "key", "left")
    out = out.join(pages.groupBy("key").agg(F.count("*").alias("pages")), "key", "left").join(extras, "key", "left").join(rel, "key", "left")
    withdrawn = F.filter("related", lambda x: (x["direction"] == "child") & (x["relation"] == "retraction"))
    warning = F.when(F.size(withdrawn) > 0, F.concat(F.lit("RETRACTED: "), F.array_join(F.transform(withdrawn, lambda x: x["other"]), ", ")))
    none = F.array().cast("array<string>")
    return out.withColumns({"figures": F.coalesce("figures", none), "note_titles": F.coalesce("note_titles", none), "pages": F.coalesce("pages", F.lit(0)), "doi_status": F.coalesce("doi_status", F.lit("missing")), "warning": warning})


def page_view(archive: DataFrame, raw: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked (key, page)`` with ``total_pages, text, problem``: from the archive, else from the raw texts; a page beyond the
    paper's says so. Only the asked keys' pages are counted."""
    keys = asked.select("key").distinct()
    total = lambda df, to: df.join(keys, "key", "left_semi").groupBy("key").agg(F.count("*").alias(to))
    out = asked.join(archive.select("key", "page", F.col("text").alias("__a")), ["key", "page"], "left").join(raw.select("key", "page", F.col("text").alias("__r")), ["key", "page"], "left")
    out = out.join(total(archive, "__n"), "key", "left").join(total(raw, "__m"), "key", "left")
    n = F.coalesce("__n", "__m")
    text = F.coalesce("__a", "__r")
    problem = F.when(n.isNull(), "not extracted").when(text.isNull(), F.concat(F.lit("out of range (1-"), n.cast("string"), F.lit(")")))
    return out.select("key", "page", n.alias("total_pages"), text.alias("text"), problem.alias("problem"))


def notes_list(notes: DataFrame, most: int = 80) -> DataFrame:
    """``key, title, preview`` of notes (``key, title, text``), line breaks as spaces."""
    one = F.regexp_replace("text", r"\s*\n\s*", " ")
    return notes.select("key", "title", F.when(F.length(one) > most, F.concat(F.left(one, F.lit(most)), F.lit("..."))).otherwise(one).alias("preview")).orderBy("key", "title")


@dataclass
class Bag:
    """What a list of search terms asks for."""

    route: str  # cited_by, cites, list, online, local
    key: str = ""
    query: str = ""
    offset: int = 0


def search_bag(terms: Sequence[str], size: int = 20) -> Bag:
    """Route of a bag of search terms: ``cited_by:key`` or ``cites:key`` wherever it stands; else the words without ``online``
    and ``page:N`` (an offset), of which none or ``*`` lists the library."""
    for t in terms:
        for route in ("cited_by", "cites"):
            if t.startswith(route + ":"):
                return Bag(route, key=t.split(":", 1)[1])
    offset = 0
    for t in terms:
        if t.startswith("page:") and t[5:].lstrip("-").isdigit():
            offset = (int(t[5:]) - 1) * size
    query = " ".join(t for t in terms if t != "online" and not t.startswith("page:"))
    if not query or query == "*":
        return Bag("list")
    return Bag("online" if "online" in terms else "local", query=query, offset=offset)


def capped(rows: DataFrame, order: Sequence[Column | str], text: str, most: int = 48_000) -> DataFrame:
    """The first rows whose texts' UTF-8 bytes fit into ``most`` together, in a total order: the feature of a capped response.
    A row holds a byte at least, so a top-k of ``most`` rows bounds what is ranked."""
    own = rows.where(F.octet_length(text) > 0).orderBy(*order).limit(most)
    total = F.sum(F.octet_length(text).cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("__bytes", total).where(F.col("__bytes") <= most).drop("__bytes")
