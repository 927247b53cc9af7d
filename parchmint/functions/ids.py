"""Keys, identifiers and titles as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Common words of English that a title's slug leaves out; callers may pass a list of their own.
COMMON_WORDS = tuple(
    """about above after again against all also although always among and another any are around because been before
    being below between both but can cannot could did does doing done down during each either else every few for from
    further had has have having her here hers herself him himself his how however into its itself just least less like made
    many may might more most much must myself neither never new nor not now off once one only other others our ours ourselves out over
    own per rather same several shall she should since some such than that the their theirs them themselves then there these
    they this those through thus too toward towards two under until upon use used using various very via was were what when
    where whether which while who whom whose why will with within without would yet you your yours yourself yourselves""".split()
)
# Words of academic titles that a slug leaves out.
ACADEMIC_WORDS = (
    "advances", "analysis", "based", "efficient", "highly", "improved", "investigation", "review", "study", "comprehensive", "overview", "approach", "method", "methods",
    "preliminary", "experimental", "theoretical", "computational", "proposed", "systematic", "comparative", "general", "applied",
)
STOP_WORDS = (*COMMON_WORDS, *ACADEMIC_WORDS)
# Kinds of related documents by what their titles say, in order of precedence.
RELATED_KINDS = {
    "retraction": ("retraction", "retracted", "withdrawal"),
    "corrigendum": ("corrigendum", "corrigenda", "correction to"),
    "errata": ("erratum", "errata"),
    "addendum": ("addendum", "addenda", "supplement to"),
    "comment": ("comment on", "reply to", "response to"),
}
RELATED_SUFFIX = r"^(.+?)_(errata|erratum|retraction|corrigendum|addendum|comment|reply)(?:_(\d+))?$"
# Label prefixes and what they name.
LABEL_KINDS = {"sec:": "section", "subsec:": "subsection", "para:": "paragraph", "tab:": "table", "fig:": "figure", "eq:": "equation", "app:": "appendix", "part:": "part"}
# What a PDF's own title begins with when it says nothing.
GENERIC_TITLES = ("microsoft word", "untitled", "document", "powerpoint")


@F.pandas_udf(T.StringType())
def _fold_ascii(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def ascii_fold(text: Column) -> Column:
    """Compatibility decomposition without what isn't ASCII; ASCII text never leaves the JVM."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, _fold_ascii(F.when(other, text))).otherwise(text)


def sanitize_key(key: Column) -> Column:
    """Without the characters that file systems forbid."""
    return F.regexp_replace(key, r'[/\\:*?"<>|\x00]', "")


def shard(key: Column) -> Column:
    """First character in lower case if it is an ASCII letter or digit, else ``_``."""
    first = F.lower(F.substring(key, 1, 1))
    return F.when(first.rlike("^[a-z0-9]$"), first).otherwise(F.lit("_"))


def key_problem(key: Column) -> Column:
    """Why a key is unsafe; null for a safe one."""
    return (
        F.when(key.isNull() | (key == ""), "empty")
        .when(F.length(key) > 100, "long")
        .when(key.contains(".."), "parent")
        .when(key.rlike(r"[/\\\x00]"), "separator")
        .when(~key.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), "characters")
    )


def path_problem(path: Column) -> Column:
    """Why a relative path is unsafe; null for a safe one."""
    return (
        F.when(path.isNull() | (path == ""), "empty")
        .when(F.contains(path, F.lit("\x00")), "null byte")
        .when(path.startswith("/"), "absolute")
        .when(F.array_contains(F.split(path, "/"), ".."), "parent")
    )


def resolved(path: Column) -> Column:
    """An absolute path without empty parts, ``.`` and ``..`` (which can't lead above the root); by its spelling, links aside."""
    step = lambda a, x: F.when(x.isin("", "."), a).when(x == "..", F.regexp_replace(a, "/[^/]*$", "")).otherwise(F.concat(a, F.lit("/"), x))
    return F.aggregate(F.split(path, "/"), F.lit(""), step)


def within(path: Column, root: Column) -> Column:
    """Whether an absolute path stays in ``root`` (or is it)."""
    inner, outer = resolved(path), resolved(root)
    return (inner == outer) | F.startswith(inner, F.concat(outer, F.lit("/")))


def classify_id(text: Column) -> Column:
    """struct(kind, id, part): page, figure, doi, s2 (40 hex digits) or slug."""
    page, figure = r"^(.+):page(\d+)$", r"^(.+):(fig[\p{L}\p{N}_]+)$"
    null = F.lit(None).cast("string")
    kind = lambda k, i, p: F.struct(F.lit(k).alias("kind"), i.alias("id"), p.alias("part"))
    return (
        F.when(text.rlike(page), kind("page", F.regexp_extract(text, page, 1), F.regexp_extract(text, page, 2)))
        .when(text.rlike(figure), kind("figure", F.regexp_extract(text, figure, 1), F.regexp_extract(text, figure, 2)))
        .when(text.contains("/"), kind("doi", text, null))
        .when(text.rlike("^[0-9a-fA-F]{40}$"), kind("s2", text, null))
        .otherwise(kind("slug", text, null))
    )


def classify_term(term: Column) -> Column:
    """What a search term asks for: heading, cite, label, file, marker or semantic."""
    return (
        F.when(term.rlike(r"^[§¶]\d") | term.rlike(r"^\d+(\.\d+)+$"), "heading")
        .when(term.rlike(r"(?i)^[a-z][a-z0-9_-]*\d{4}"), "cite")
        .when(term.rlike(r"^\\(label|ref)\{"), "label")
        .when(term.contains(".tex"), "file")
        .when(term.rlike(r"^[%\\]"), "marker")
        .otherwise("semantic")
    )


# A DOI behind its name or resolver, and by itself.
DOI_BODY = r"(10\.\d{4,9}/[^\s,;\"'}\]]+)"
DOI_NAMED, DOI_BARE = r"(?i)(?:doi[:\s]*|https?://(?:dx\.)?doi\.org/)" + DOI_BODY, r"\b" + DOI_BODY


def extract_doi(text: Column) -> Column:
    """The first DOI behind ``doi`` or a resolver's address, else the first bare one; trailing ``. , ; ) ]`` stripped in this
    order."""
    named = F.regexp_extract(text, DOI_NAMED, 1)
    found = F.when(named != "", named).otherwise(F.regexp_extract(text, DOI_BARE, 1))
    for mark in ".,;)]":
        found = F.rtrim(found, F.lit(mark))
    return F.nullif(found, F.lit(""))


def generic_title(title: Column) -> Column:
    """Whether a file's own title says nothing about the paper."""
    low = F.lower(F.btrim(title, F.lit(" \t\n\r")))
    out = F.lit(False)
    for p in GENERIC_TITLES:
        out = out | low.startswith(p)
    return out


def title_line(text: Column, lines: int = 10) -> Column:
    """The first of the first lines that may be a title: ten characters and more, no digit in front, no short line in
    capitals, no address, no university; null where there is none."""
    blank = F.lit(" \t\n\r\f\u000b")
    own = F.transform(F.slice(F.split(F.btrim(text, blank), "\n"), 1, lines), lambda x: F.btrim(x, blank))
    capitals = lambda x: x.rlike(r"\p{Lu}") & ~x.rlike(r"\p{Ll}") & (F.length(x) < 50)
    good = F.filter(own, lambda x: (F.length(x) >= 10) & ~x.rlike(r"^\p{Nd}") & ~capitals(x) & ~F.contains(x, F.lit("@")) & ~F.contains(F.lower(x), F.lit("university")))
    return F.try_element_at(good, F.lit(1))


def identify(subject: Column, title: Column, first_page: Column) -> Column:
    """struct(doi, doi_source, title): the DOI of the file's subject, else of its first page; the file's own title unless it
    says nothing, else the first page's likely one."""
    own, text = extract_doi(F.coalesce(subject, F.lit(""))), extract_doi(F.coalesce(first_page, F.lit("")))
    source = F.when(own.isNotNull(), "metadata").when(text.isNotNull(), "text")
    good = (F.coalesce(title, F.lit("")) != "") & ~generic_title(F.coalesce(title, F.lit("")))
    return F.struct(F.coalesce(own, text).alias("doi"), source.alias("doi_source"), F.when(good, title).otherwise(title_line(F.coalesce(first_page, F.lit("")))).alias("title"))


def surname(author: Column) -> Column:
    """``Last, First`` or ``First Last`` to the last name in lower case."""
    own = F.trim(author)
    return F.lower(F.when(own.contains(","), F.trim(F.split(own, ",")[0])).otherwise(F.try_element_at(F.split(own, r"\s+"), F.lit(-1))))


def first_surname(authors: Column) -> Column:
    """Last name of the first of several authors (parted by ``and`` or ``;``), as it is written."""
    first = F.trim(F.split(F.split(authors, " and ")[0], ";")[0])
    return F.when(first.contains(","), F.trim(F.split(first, ",")[0])).when(first == "", F.trim(authors)).otherwise(F.try_element_at(F.split(first, r"\s+"), F.lit(-1)))


def name_variants(name: Column) -> Column:
    """A name as it is, and turned: ``Last, First`` to ``First Last``; ``First Last`` to ``Last, First`` and ``Last First``."""
    own = F.btrim(name, F.lit(" \t\n\r"))
    last, rest = F.trim(F.substring_index(own, ",", 1)), F.trim(F.regexp_replace(own, r"^[^,]*,", ""))
    words = F.filter(F.split(own, r"\s+"), lambda w: w != "")
    tail, head = F.try_element_at(words, F.lit(-1)), F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return (
        F.when(own.contains(",") & (last != "") & (rest != ""), F.array(own, F.concat_ws(" ", rest, last)))
        .when(~own.contains(",") & (F.size(words) >= 2), F.array(own, F.concat_ws(", ", tail, head), F.concat_ws(" ", tail, head)))
        .otherwise(F.array(own))
    )


def title_tokens(title: Column) -> Column:
    """Distinct lower-case words of more than two characters; letters and digits of any script are words."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either side is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def tokens_score(tokens_a: Column, tokens_b: Column, names_a: Column, names_b: Column, year_a: Column, year_b: Column) -> Column:
    """``match_score`` of titles whose ``title_tokens`` are at hand (distinct ones, so the union needn't be made)."""
    year = F.when((year_a == year_b) & (year_a != 0), 0.15).otherwise(0.0)
    shared = F.array(F.size(F.array_intersect(tokens_a, tokens_b)))
    title = F.when((F.size(tokens_a) > 0) & (F.size(tokens_b) > 0), F.transform(shared, lambda n: n / (F.size(tokens_a) + F.size(tokens_b) - n))[0]).otherwise(F.lit(0.0))
    return F.lit(0.6) * title + F.lit(0.25) * jaccard(names_a, names_b) + year


def match_score(title_a: Column, title_b: Column, names_a: Column, names_b: Column, year_a: Column, year_b: Column) -> Column:
    """0.6 title overlap + 0.25 surname overlap + 0.15 for equal years (0 is no year)."""
    return tokens_score(title_tokens(title_a), title_tokens(title_b), names_a, names_b, year_a, year_b)


def read_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """A word list for ``slug`` from a text file, one word a line (lines that begin with ``#`` aside), with the academic words.
    Lists have a few thousand words and reach the driver."""
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> '' AND NOT startswith(w, '#')")
    return (*sorted({r.w for r in rows.collect()}), *ACADEMIC_WORDS)


def slug(title: Column, stop: tuple[str, ...] = STOP_WORDS, most: int = 2) -> Column:
    """First telling word of a title, alone if it has eight letters or more, else joined to those that follow, ``most`` in all;
    empty without any. Which words tell nothing is a parameter, and a longer list changes slugs: libraries pass their own."""
    found = F.filter(F.regexp_extract_all(F.lower(ascii_fold(title)), F.lit("([a-z]{3,})"), 1), lambda w: ~w.isin(*stop))
    first = F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))
    return F.when(F.length(first) >= 8, first).otherwise(F.array_join(F.slice(found, 1, most), ""))


def make_key(surname_: Column, year: Column, title: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Surname's letters in lower case, year, slug."""
    return F.concat(F.lower(F.regexp_replace(ascii_fold(surname_), "[^a-zA-Z]", "")), year.cast("string"), slug(title, stop))


def related_kind(*titles: Column) -> Column:
    """Kind of related document that titles (registry's, file's) name; null where none does."""
    low = F.lower(F.concat_ws(" ", *titles))
    out = None
    for kind, words in RELATED_KINDS.items():
        test = low.rlike("|".join(words))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def label_kind(label: Column) -> Column:
    out = None
    for prefix, kind in LABEL_KINDS.items():
        test = label.startswith(prefix)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("unknown")


def attribution(authors: Column, year: Column, label: Column) -> Column:
    """What stands under a reproduced figure: first surname, ``et al.`` for more, year, figure or scheme and its number."""
    first = F.get(authors, F.lit(0))
    last = F.when(first.contains(","), F.trim(F.split(first, ",")[0])).otherwise(F.try_element_at(F.split(F.trim(first), r"\s+"), F.lit(-1)))
    who = F.when(F.coalesce(F.size(authors), F.lit(0)) < 1, "Unknown").when(F.size(authors) > 1, F.concat(last, F.lit(" et al."))).otherwise(last)
    number = F.regexp_extract(label, r"(?i)^(?:fig|figure|scheme)(\d+)", 1)
    name = F.when(number == "", label).otherwise(F.concat(F.when(F.contains(F.lower(label), F.lit("scheme")), "Scheme ").otherwise("Figure "), number))
    return F.concat(F.lit("Reproduced from "), who, F.lit(" ("), year.cast("string"), F.lit("), "), name)


def figure_number(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, r"(\d+)", 1), F.lit("")).cast("int")


def cache_key(identifier: Column) -> Column:
    return F.left(F.sha2(identifier, 256), F.lit(16))


def normal_doi(doi: Column) -> Column:
    return F.nullif(F.lower(F.trim(doi)), F.lit(""))
