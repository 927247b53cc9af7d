"""Text as Column expressions: everything stays in the JVM unless its docstring says otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Quotes, dashes and ligatures that search text is folded over.
FOLD_FROM = "\u2018\u2019\u201c\u201d\u2013\u2014"
FOLD_TO = "''\"\"--"
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
SOFT_HYPHEN = "\u00ad"


@F.pandas_udf(T.StringType())
def _compat(text: pd.Series) -> pd.Series:
    """Unicode compatibility form; SQL has no function for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def compat(text: Column) -> Column:
    """NFKC; ASCII text, which it doesn't change, never leaves the JVM."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), _compat(F.when(text.rlike(r"[^\x00-\x7F]"), text))).otherwise(text)


def _fold(text: Column) -> Column:
    joined = F.regexp_replace(text, r"-\s*\n\s*", "")
    out = F.translate(joined, FOLD_FROM + SOFT_HYPHEN, FOLD_TO)
    for mark, letters in LIGATURES.items():
        out = F.replace(out, F.lit(mark), F.lit(letters))
    return out


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_ascii(text: Column) -> Column:
    """``normalize`` for text known to be ASCII."""
    return squeeze(F.lower(_fold(text)))


def normalize(text: Column) -> Column:
    """Search form: compatibility form, line-break hyphens joined, quotes and dashes folded, lower case, single spaces."""
    return normalize_ascii(compat(text))


def normal_form(text: str) -> str:
    """``normalize`` of one string, for functions that run outside the JVM."""
    out = re.sub(r"-\s*\n\s*", "", unicodedata.normalize("NFKC", text))
    fold = dict(zip(FOLD_FROM, FOLD_TO, strict=True)) | LIGATURES | {SOFT_HYPHEN: ""}
    return " ".join(out.translate(str.maketrans(fold)).lower().split())


def clean_for_quote(text: Column) -> Column:
    """As ``normalize`` with case kept and zero-width characters removed."""
    return squeeze(F.translate(_fold(compat(text)), "\u200b\u200c\u200d\ufeff", ""))


def sentences(text: Column) -> Column:
    """Split on white space after ``. ! ?``; stripped, empties dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    core = F.btrim(text, F.lit(" \t\n\u000b\f\r"))
    return F.when(core == "", 0).otherwise(F.size(F.split(core, r"\s+")))


def ascii_ratio(text: Column) -> Column:
    """Share of ASCII characters, 0 for the empty text."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / n).otherwise(F.lit(0.0))


def _bound(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, however often ``f`` uses it."""
    return F.transform(F.array(x), f)[0]


def running(values: Column, block: int = 256) -> Column:
    """Running sums of an int array. A fold that appends to an array copies it every time, so sums are made in blocks: the
    work grows with length times block, and not with the square of the length."""
    append = lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n))
    none = F.array().cast("array<int>")
    count = lambda v: F.ceil(F.size(v) / block).cast("int")

    def blocks(v: Column) -> Column:
        return F.when(F.size(v) > 0, F.transform(F.sequence(F.lit(0), F.greatest(count(v) - 1, F.lit(0))), lambda k: F.aggregate(F.slice(v, k * block + 1, block), none, append))).otherwise(F.array().cast("array<array<int>>"))

    def joined(b: Column) -> Column:
        bases = F.aggregate(F.transform(b, lambda x: F.element_at(x, -1)), F.array(F.lit(0)), append)
        return _bound(bases, lambda base: F.flatten(F.transform(b, lambda x, k: F.transform(x, lambda n: n + F.get(base, k)))))

    return _bound(_bound(values, blocks), joined)


def occurrences(text: Column, needle: str) -> Column:
    """1-based places of all occurrences of ``needle``, overlapping ones too."""
    lengths = F.transform(F.split(text, f"(?={_quote(needle)})"), lambda p: F.length(p))
    starts = lambda ends: F.transform(F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0)))), lambda x: x + 1)
    # a part begins at every occurrence; the first part only if the text begins with one
    return _bound(_bound(running(lengths), starts), lambda at: F.when(F.startswith(text, F.lit(needle)), at).otherwise(F.slice(at, 2, F.size(at))))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def pieces(text: Column, size: int = 512) -> Column:
    """The text in pieces of ``size`` characters (the last may be shorter), for ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def cut(parts: Column, begin: Column, end: Column, size: int = 512) -> Column:
    """Characters ``begin`` to ``end`` (from 0, end exclusive) of a text in pieces: a text isn't walked from its beginning
    for each place that is cut out of it."""
    first = F.floor(begin / size).cast("int")
    near = F.array_join(F.slice(parts, first + 1, F.greatest(F.lit(0), F.ceil(end / size).cast("int") - first)), "")
    return F.substring(near, (begin - first * size + 1).cast("int"), F.greatest(F.lit(0), end - begin).cast("int"))


def _quote(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def paragraphs(text: Column, least: int = 40, letters: float = 0.4) -> Column:
    """(index, text) of blank-line separated paragraphs of at least ``least`` characters with that share of letters."""
    raw = F.transform(F.split(text, r"\n\s*\n"), lambda p, i: F.struct(i.alias("idx"), F.trim(p).alias("para")))
    share = lambda p: F.length(F.regexp_replace(p, r"[^\p{L}]", "")) / F.length(p)
    return F.filter(raw, lambda x: (F.length(x["para"]) >= least) & (share(x["para"]) >= letters))


# Commands that go with their arguments, that become a space, that leave their argument.
DROPPED = (
    "cite[tp]?", "mciteboxp?", "citeqp?", "ref", "eqref", "pageref", "nameref", "label", "gls[p]?", "Gls[p]?", "acrshort", "acrlong", "acrfull",
    "hyperref", "hyperlink", "hypertarget",
)
SPACED = (
    "par", "newline", "noindent", "clearpage", "newpage", "vspace", "hspace", "medskip", "bigskip", "smallskip", "vfill", "hfill", "centering", "raggedright", "raggedleft",
    "maketitle", "tableofcontents", "listoffigures", "listoftables", "appendix", "frontmatter", "mainmatter", "backmatter",
)
KEPT = ("textbf", "textit", "textsf", "texttt", "textsc", "textrm", "emph", "underline", "textsubscript", "textsuperscript", "mbox", "text", r"textcolor\{[^}]*\}")
# What a heading's markup turns into, in this order.
HEADING_MARKUP = (
    (r"\\ignorespaces\s*", ""), (r"\\[Gg]lspl?\s*\{([^}]*)\}", "$1"), (r"\\textbf\s*\{([^}]*)\}", "$1"), (r"\\textit\s*\{([^}]*)\}", "$1"), (r"\\emph\s*\{([^}]*)\}", "$1"),
    (r"\\hspace\s*\{[^}]*\}", " "), (r"\\text[a-z]+\s*\{([^}]*)\}", "$1"), (r"\\[a-zA-Z]+\s*\{([^}]*)\}", "$1"), (r"\\[,;~]", " "), ("~", " "), (r"\s+", " "),
)
_KEEP = r"\\(?:" + "|".join(KEPT) + r")\{([^}]*)\}"


@F.pandas_udf(T.StringType())
def _kept(text: pd.Series) -> pd.Series:
    """Until no such command is left."""
    pattern = re.compile(_KEEP)

    def one(t: str | None) -> str | None:
        while t is not None and pattern.search(t):
            t = pattern.sub(r"\1", t)
        return t

    return text.map(one)


def strip_markup(text: Column, passes: int = 3) -> Column:
    """TeX source to plain text: comments, commands with what becomes of their arguments, other commands, delimiters. Kept
    arguments are unwrapped until none is left: ``passes`` times in the JVM, and only deeper ones elsewhere."""
    out = F.regexp_replace(text, r"(?<!\\)%[^\n]*", "")
    out = F.regexp_replace(out, r"\\(?:" + "|".join(DROPPED) + r")(?:\[[^\]]*\])*(?:\{[^}]*\})*", "")
    out = F.regexp_replace(out, r"\\(?:" + "|".join(SPACED) + r")\b\*?(?:\{[^}]*\}|\[[^\]]*\])*", " ")
    for _ in range(passes):
        out = F.regexp_replace(out, _KEEP, "$1")
    out = F.when(out.rlike(_KEEP), _kept(F.when(out.rlike(_KEEP), out))).otherwise(out)
    out = F.regexp_replace(out, r"\\[a-zA-Z@]+\*?", "")
    return F.translate(F.replace(out, F.lit("~"), F.lit(" ")), "{}$", "")


def normalize_markup(text: Column) -> Column:
    """TeX source in the form that search text has."""
    return normalize(strip_markup(text))


def clean_heading(text: Column) -> Column:
    """A heading of a table of contents without its markup."""
    out = text
    for pattern, to in HEADING_MARKUP:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def markup_word_count(text: Column) -> Column:
    """Words of TeX source: comment lines out, commands, braces and inline math to spaces in this order."""
    out = F.regexp_replace(text, r"(?m)^\s*%.*$", "")
    out = F.regexp_replace(out, r"\\[a-zA-Z]+\*?", " ")
    out = F.regexp_replace(out, r"[{}]", " ")
    out = F.regexp_replace(out, r"\$[^$]*\$", " ")
    return word_count(out)
