"""Ingest validation: text metrics, gates, reports, best metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions import ids
from parchmint.functions import text as tx
from parchmint.operators import fuzzy, simjoin

# Types of document that need no identifier, and gates that only warn.
EXEMPT_TYPES = ("patent", "datasheet", "book", "thesis", "standard", "report")
ADVISORY_GATES: tuple[str, ...] = ()
# What counts as a numbered reference, an author and year, a figure, a table; where an abstract begins and ends.
NUMBERED, AUTHOR_YEAR = r"\[(\d{1,3})\]", r"(\([A-Z][a-z]+(?:\s+(?:et\s+al\.?|and\s+[A-Z]))?[,\s]+\d{4}\))"
FIGURE, TABLE = r"(?i)(?:Figure|Fig\.?)\s+(\d+)", r"(?i)Table\s+(\d+)"
ABSTRACT = r"(?m)(?:^|\n)\s*(?:Abstract|ABSTRACT)\s*[:.]?\s*\n?"
INTRODUCTION = r"(?:^|\n)\s*(?:1\.?\s+)?(?:Introduction|INTRODUCTION|Keywords|KEYWORDS)\s*\n"


def text_metrics(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """Words, readable pages, ASCII share of the first two pages, references (greatest ``[n]``, else author-year
    citations), figures, tables and abstract of each document. ``pages`` are rows; documents are put together in page
    order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda x: x[text])
    docs = pages.groupBy(key).agg(F.count("*").alias("pages"), F.count_if(F.length(F.trim(text)) > 50).alias("readable_pages"), listed.alias("l"))
    docs = docs.select(key, "pages", "readable_pages", F.array_join("l", "\n\n").alias("t"), F.array_join(F.slice("l", 1, 2), "\n").alias("h"))
    numbers = F.transform(F.regexp_extract_all("t", F.lit(NUMBERED), 1), lambda x: x.cast("int"))
    count = lambda p: F.size(F.array_distinct(F.regexp_extract_all("t", F.lit(p), 1))).cast("long")
    upto = F.regexp_extract("t", "(?s)" + ABSTRACT.replace("\\n?", "\\n?+").replace("\\s*[:.]?\\s*", "\\s*+[:.]?\\s*+") + "(.*?)" + INTRODUCTION, 1)
    bounded = F.col("t").rlike("(?s)" + ABSTRACT + ".*?" + INTRODUCTION)
    rest = F.left(F.regexp_extract("t", "(?s)" + ABSTRACT + "(.{0,2000})", 1), F.lit(2000))
    strip = lambda c: F.btrim(c, F.lit(" \t\n\r\f\u000b"))
    has = F.col("t").rlike(ABSTRACT)
    return docs.select(
        key,
        "pages",
        "readable_pages",
        tx.word_count(F.col("t")).cast("long").alias("word_count"),
        F.round(tx.ascii_ratio(F.col("h")), 3).alias("ascii_ratio"),
        F.coalesce(F.array_max(numbers), F.size(F.array_distinct(F.regexp_extract_all("t", F.lit(AUTHOR_YEAR), 1)))).cast("long").alias("ref_count"),
        count(FIGURE).alias("figure_count"),
        count(TABLE).alias("table_count"),
        has.alias("has_abstract"),
        F.when(has, F.left(strip(F.when(bounded, upto).otherwise(rest)), F.lit(2000))).alias("abstract"),
        F.lit("en").alias("language"),
    )


def paper_type(pages: Column, words: Column, refs: Column) -> Column:
    return F.when((pages <= 4) & (words < 4000), "letter").when((refs > 80) & (words > 8000), "review").otherwise("article")


def _gate(number: int, name: str, ok: Column, good: Column, bad: Column) -> Column:
    return F.struct(F.lit(number).alias("ord"), F.lit(name).alias("gate"), ok.alias("passed"), F.when(ok, good).otherwise(bad).alias("message"))


def gate_rows(documents: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """(key, ord, gate, passed, message) of the gates that need no search, in their order.

    ``documents(key, content_hash, pages array, doi)``: the texts of all pages; ``known(key, content_hash, doi)`` is the
    catalogue. A document without a page stops at the first gate; text quality is judged where the first page has text,
    the identifier where there is one."""
    held = known.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min("key").alias("__h"))
    dois = known.where("doi IS NOT NULL").groupBy(F.lower("doi").alias("__doi")).agg(F.min("key").alias("__d"))
    own = documents.withColumn("__doi", F.lower("doi")).join(held, "content_hash", "left").join(dois, "__doi", "left")
    n = F.coalesce(F.size("pages"), F.lit(0))
    first = F.coalesce(F.try_element_at("pages", F.lit(1)), F.lit(""))
    length, share = F.length(F.btrim(first, F.lit(" \t\n\r\f\u000b"))), tx.ascii_ratio(first)
    two = F.format_string("%.2f", share)
    whole = _gate(1, "pdf_integrity", n > 0, F.concat(n.cast("string"), F.lit(" pages")), F.lit("PDF has 0 pages"))
    rest = F.array_compact(
        F.array(
            _gate(2, "dedup", F.col("__h").isNull(), F.lit("No duplicate found"), F.concat(F.lit("Duplicate: already in vault as '"), "__h", F.lit("'"))),
            _gate(3, "text_extractable", length >= 50, F.concat(F.lit("First page: "), length.cast("string"), F.lit(" chars")), F.concat(F.lit("First page has only "), length.cast("string"), F.lit(" chars (need 50+). Scanned PDF?"))),
            F.when(first != "", _gate(4, "text_quality", share >= 0.5, F.concat(F.lit("Text quality: "), two), F.concat(F.lit("Text quality "), two, F.lit(" below threshold 0.5")))),
            F.when(F.coalesce("doi", F.lit("")) != "", _gate(5, "doi_duplicate", F.col("__d").isNull(), F.lit("DOI not in vault"), F.concat(F.lit("DOI already in vault as '"), "__d", F.lit("'")))),
        )
    )
    all_ = F.when(n > 0, F.concat(F.array(whole), rest)).otherwise(F.array(whole))
    return own.select(key, F.explode(all_).alias("g")).select(key, "g.*")


def search_gates(documents: DataFrame, key: str, known: DataFrame, least: float = 0.6, title_least: float = 0.9) -> DataFrame:
    """(key, ord, gate, passed, message) of the gates that search texts: the registry's title and authors in the pages, and
    catalogued titles that are much the same.

    ``documents(key, pages array, title, registry_title, registry_authors array)``, ``known(key, title)``. A gate whose input
    is missing isn't run. Title: found in the pages' text, else like the extracted title. Authors: a full name, turned too,
    else a surname of two letters and more. Titles: the first catalogued key with a ratio of ``title_least`` and more; case
    counts there."""
    two = lambda c: F.format_string("%.2f", c)
    have = F.coalesce(F.size("pages"), F.lit(0)) > 0
    own = documents.where(have)
    asked = own.where(F.coalesce("registry_title", F.lit("")) != "").select(key, "pages", "title", "registry_title", fuzzy.needle_array(F.col("registry_title")).alias("n"))
    found = fuzzy.search_pages(asked, "n", "pages", "f")
    like = F.coalesce(fuzzy.set_ratio(F.lower("title"), F.lower("registry_title")), F.lit(0.0))
    titled = found.withColumn("s", like).select(
        key,
        F.when(F.col("f.score") >= least, _gate(6, "doi_title_match", F.lit(True), F.concat(F.lit("Title found in text (score "), two("f.score"), F.lit(")")), F.lit("")))
        .otherwise(
            _gate(
                6,
                "doi_title_match",
                F.col("s") >= least,
                F.concat(F.lit("Title match score: "), two("s")),
                F.concat(F.lit("Title mismatch (score "), two("s"), F.lit("): PDF='"), F.left(F.coalesce("title", F.lit("")), F.lit(80)), F.lit("' vs CrossRef='"), F.left("registry_title", F.lit(80)), F.lit("'")),
            )
        )
        .alias("g"),
    )
    named = own.where(F.coalesce(F.size("registry_authors"), F.lit(0)) > 0)
    named = named.select(key, "pages", F.flatten(F.transform("registry_authors", lambda a: ids.name_variants(a))).alias("n"), F.filter(F.transform("registry_authors", lambda a: ids.first_surname(a)), lambda a: F.length(a) >= 2).alias("last"))
    named = fuzzy.search_pages(named, ["n", "last"], "pages", ["f", "l"])
    best = F.greatest("f.score", "l.score")
    authored = named.select(
        key,
        F.when(F.col("f.score") >= least, _gate(7, "doi_author_match", F.lit(True), F.concat(F.lit("Author '"), "f.needle", F.lit("' found (score "), two("f.score"), F.lit(")")), F.lit("")))
        .otherwise(
            _gate(
                7,
                "doi_author_match",
                best >= least,
                F.concat(F.lit("Author surname '"), "l.needle", F.lit("' found (score "), two("l.score"), F.lit(")")),
                F.concat(F.lit("No CrossRef author found in text (best "), two(best), F.lit(" for '"), F.when(F.col("l.score") > F.col("f.score"), F.col("l.needle")).otherwise(F.col("f.needle")), F.lit("')")),
            )
        )
        .alias("g"),
    )
    extracted = own.where(F.coalesce("title", F.lit("")) != "").select(F.col(key).alias("__key"), "title")
    catalogued = known.where(F.coalesce("title", F.lit("")) != "")
    near = simjoin.first_hits(extracted, "__key", "title", catalogued, "key", "title", title_least)
    near = near.select(F.col("__key").alias("__k"), F.struct(F.col("known_key").alias("key"), "ratio").alias("m"))
    dedup = extracted.join(near, F.col("__key") == F.col("__k"), "left").select(
        F.col("__key").alias(key), _gate(8, "title_dedup", F.col("m").isNull(), F.lit("No similar titles found"), F.concat(F.lit("Similar title in vault: '"), F.col("m.key"), F.lit("' (score "), two("m.ratio"), F.lit(")"))).alias("g")
    )
    return titled.unionByName(authored).unionByName(dedup).select(key, "g.*")


def injection_rows(scores: DataFrame, documents: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """(key, ord, gate, passed, message) by pages' scores (``key, page, score``; see ``injection_scores``). A document that
    has no score passes: a scanner that can't run must not block."""
    flagged = F.array_sort(F.collect_list(F.when(F.col("score") > least, F.col("page"))))
    s = scores.groupBy(key).agg(F.max("score").alias("top"), flagged.alias("flagged"))
    own = documents.select(key).distinct().join(s, key, "left")
    shown = F.concat(F.lit("["), F.array_join(F.transform("flagged", lambda p: p.cast("string")), ", "), F.lit("]"))
    clean = F.coalesce(F.size("flagged") == 0, F.lit(True))
    good = F.when(F.col("top").isNull(), "Scanner unavailable").otherwise(F.concat(F.lit("Clean (max score: "), F.format_string("%.2f", F.coalesce("top", F.lit(0.0))), F.lit(")")))
    bad = F.concat(F.lit("Prompt injection detected on page(s) "), shown, F.lit(" (max score: "), F.format_string("%.2f", F.coalesce("top", F.lit(0.0))), F.lit(")"))
    return own.select(key, _gate(9, "prompt_injection", clean, good, bad).alias("g")).select(key, "g.*")


# Phrases that address a reading model instead of a reader; a rule-based stand-in where no classifier is at hand.
INJECTIONS = (
    r"(?i)\b(?:ignore|disregard|forget)\b[^.\n]{0,40}\b(?:previous|prior|above|earlier|all)\b[^.\n]{0,40}\b(?:instructions?|prompts?|rules?|context)\b",
    r"(?i)\byou are now\b[^.\n]{0,60}\b(?:assistant|model|mode|agent|dan)\b",
    r"(?i)\b(?:reveal|print|repeat|show)\b[^.\n]{0,40}\b(?:system prompt|hidden instructions?|your instructions?)\b",
    r"(?i)\b(?:as an? (?:ai|language model)|dear (?:ai|llm|reviewer model))\b[^.\n]{0,80}\b(?:must|should|please)\b",
    r"(?i)<\|?(?:im_start|system|endoftext)\|?>",
)


def injection_scores(pages: DataFrame, key: str, page: str, text: str, least: int = 20) -> DataFrame:
    """``key, page, score`` of pages with at least ``least`` characters: 1 less a half for each kind of phrase found. A trained
    classifier goes in its place with the same columns."""
    kinds = sum((F.col(text).rlike(p).cast("int") for p in INJECTIONS), F.lit(0))
    own = pages.where(F.length(F.trim(text)) >= least)
    return own.select(key, page, F.round(F.lit(1.0) - F.pow(F.lit(0.5), kinds * 2), 6).alias("score"))


def validate(documents: DataFrame, key: str, known: DataFrame) -> DataFrame:
    """All gates of documents, in their order; documents as for ``gate_rows`` and ``search_gates``."""
    return gate_rows(documents, key, known).unionByName(search_gates(documents, key, known))


def report(gates: DataFrame, key: str, types: DataFrame | None = None, advisory: Sequence[str] = ADVISORY_GATES) -> DataFrame:
    """All passed; whether the document can be taken without a person; messages of failed gates in order; share passed.

    A document is taken if all blocking gates passed; of a type (``types(key, doc_type)``, ``article`` where it has none)
    that needs an identifier, only if the registry's title has been found as well."""
    blocking = ~F.col("gate").isin(*advisory) if advisory else F.lit(True)
    title = F.when(F.col("gate") == "doi_title_match", F.col("passed"))
    failed = F.transform(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.struct("ord", "message")))), lambda x: x["message"])
    out = gates.groupBy(key).agg(
        F.bool_and("passed").alias("all_passed"),
        F.bool_and(F.col("passed") | ~blocking).alias("__blocking"),
        F.coalesce(F.bool_and(title), F.lit(False)).alias("__title"),
        F.array_join(failed, "; ").alias("issues"),
        F.round(F.avg(F.col("passed").cast("double")), 2).alias("confidence"),
    )
    kind = F.lit("article")
    if types is not None:
        out = out.join(types, key, "left")
        kind = F.coalesce("doc_type", F.lit("article"))
    taken = F.col("__blocking") & (kind.isin(*EXEMPT_TYPES) | F.col("__title"))
    return out.select(key, "all_passed", taken.alias("auto_accept"), "issues", "confidence")


def resolve_metadata(documents: DataFrame, by_doi: DataFrame, by_title: DataFrame) -> DataFrame:
    """``documents(key, doi, title)`` with the registry's row: by the document's identifier, else the graph service's best hit
    for its title (``by_title(key, title, doi, year)``, one row a document). An identifier that only the service knows is
    taken over; rows that a service failed to give are null and nothing more."""
    r = by_doi.select(F.lower("doi").alias("__doi"), F.col("title").alias("registry_title"), F.col("year").alias("registry_year"), F.col("authors").alias("registry_authors"))
    s = by_title.select("key", F.col("title").alias("service_title"), F.col("doi").alias("service_doi"), F.col("year").alias("service_year"))
    own = documents.withColumn("__doi", F.lower("doi")).join(r, "__doi", "left").join(s, "key", "left")
    return own.select(
        "key",
        F.coalesce(F.col("doi"), F.when(F.col("registry_title").isNull(), F.col("service_doi"))).alias("doi"),
        F.coalesce("registry_title", "service_title", "title").alias("title"),
        F.coalesce("registry_year", "service_year").alias("year"),
        F.coalesce("registry_authors", F.array().cast("array<string>")).alias("authors"),
        F.when(F.col("registry_title").isNotNull(), "crossref").when(F.col("service_title").isNotNull(), "s2").alias("source"),
    )


def cover_year(date: Column) -> Column:
    """The first four characters as a year; null where they are none."""
    return F.left(date, F.lit(4)).try_cast("int")


def best_metadata(sources: Mapping[str, Column]) -> tuple[Column, Column]:
    """(value, source name) of the first source that isn't blank, in the order given."""
    named = [F.when(F.trim(c) != "", F.struct(F.trim(c).alias("v"), F.lit(n).alias("s"))) for n, c in sources.items()]
    first = F.coalesce(*named)
    return first["v"], first["s"]
