"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

High-recall generators propose spans that may overlap: numbers with and without blanks in them, addresses written out with
"at" and "dot", colon groups, account numbers. Boosted trees score each by its format (digits, groups, separators, check
sums) and its context (neighbouring characters, words that announce it). Thresholds by kind, set on labelled candidates that
the trees haven't seen, select what is added to the spans of the base patterns, which always stay.

The trees are fitted on candidates in windows of the corpus' own words into which spans of known forms, personal and
ordinary, are written; a proposed span is right where it is exactly the one written. The fitted trees become one SQL expression,
so all documents are scanned in one projection: nothing is shuffled, exploded or gathered, whatever a text holds.

Patterns use possessive loops and look behind instead of trying every position of a run anew, which finds the same matches in
time that grows with the text and without deep recursion.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.llm._scratch import discard, stage

#: Kinds in the order in which spans of one start are listed; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
EMAIL, IP, CARD, PHONE, IBAN, SSN = range(6)
_LOCAL = "A-Za-z0-9._%+-"
#: The base patterns, fixed by the contract.
BASE = {
    EMAIL: rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "spaced": r"[+(]?[0-9](?:[\x20()./-]{0,2}[0-9])++",
    "number": r"[0-9](?:[./-]?[0-9])++",
    "mail": rf"(?i)(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++(?:\x20?[@]\x20?|\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "colons": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
}
#: Longer spans aren't proposed: no form that is looked for has so many characters. (Base spans have any length.)
LONGEST = 72
#: Words before a span that announce its kind, and such as announce ordinary numbers.
CUES = {
    EMAIL: "e-?mail|mail|contact|write|reach|address",
    IP: "ip|host|server|addr|address|peer|client",
    CARD: "card|visa|master|amex|credit|debit|payment|pay",
    PHONE: "tel|phone|call|mobile|cell|fax|sms",
    IBAN: "iban|account|bank|konto|transfer",
    SSN: "ssn|social|security|tax",
}
ORDINARY = "order|invoice|version|isbn|page|build|serial|item|ref|release|figure|section"
_MARK, _BLANKED = "￿", "￾"
_CHUNK = 64


def _bind(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with ``value`` evaluated once."""
    return F.transform(F.array(value), then)[0]


def _marked(text: Column, pattern: str) -> Column:
    """The text cut before and after every match: matches stand at odd places. The mark is a character that the patterns can't
    match; where a text has it, another such stands in."""
    return F.split(F.regexp_replace(F.translate(text, _MARK, _BLANKED), pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _sums(sizes: Column, first: Column) -> Column:
    """``first`` and all running sums."""
    return F.aggregate(sizes, F.array(first), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def _starts(parts: Column) -> Column:
    """Where each part begins: running sums within chunks and over chunks, so that long texts don't cost the square."""
    sizes = F.transform(parts, lambda p: F.length(p).cast("long"))
    zero = F.lit(0).cast("long")

    def chunks(s: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _CHUNK).cast("int")), lambda c: F.slice(s, c * _CHUNK + 1, _CHUNK))
        return _bind(cut, lambda k: _bind(_sums(F.transform(k, lambda x: F.aggregate(x, zero, lambda a, y: a + y)), zero), lambda at: F.flatten(F.transform(k, lambda x, i: F.slice(_sums(x, F.get(at, i)), 1, F.size(x))))))

    return _bind(sizes, chunks)


def _spans(parts: Column) -> Column:
    """``start, end, s, pre, post`` of the matches; ``pre`` and ``post`` are the characters beside them, up to the next match."""

    def cut(p: Column) -> Column:
        def one(at: Column) -> Column:
            span = lambda i: F.struct(F.get(at, i).alias("start"), F.get(at, i + 1).alias("end"), F.get(p, i).alias("s"), F.right(F.get(p, i - 1), F.lit(24)).alias("pre"), F.left(F.get(p, i + 1), F.lit(2)).alias("post"))
            return F.transform(F.sequence(F.lit(1), F.size(p) - 2, F.lit(2)), span)

        return _bind(_starts(p), one)

    none = "array<struct<start:bigint,end:bigint,s:string,pre:string,post:string>>"
    return F.when(F.size(parts) > 1, cut(parts)).otherwise(F.array().cast(none))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string fits."""
    every = F.split(F.reverse(digits), "")
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    value = F.transform(every, lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


_OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.(?!$)|$)){4}$"


def _valid(kind: int, s: Column) -> Column:
    """What a base match must fulfil besides its pattern."""
    n = F.length(_digits(s))
    if kind == IP:
        return F.regexp_like(s, F.lit(_OCTETS))
    if kind == CARD:
        return F.when(n.between(14, 19), _luhn(_digits(s))).otherwise(False)
    return n.between(10, 15) if kind == PHONE else F.lit(True)


def _mod97(s: Column) -> Column:
    """The remainder of an account number with its first four characters moved to the end, letters as 10 to 35."""
    bare = F.upper(F.regexp_replace(s, "[^0-9A-Za-z]", ""))
    turned = F.filter(F.split(F.concat(F.substring(bare, 5, LONGEST), F.left(bare, F.lit(4))), ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(turned, F.lit(0), step)


def _beside(c: Column) -> Column:
    """0 nothing or blank, 1 letter, 2 digit, 3 other."""
    return F.when((c == "") | F.regexp_like(c, F.lit(r"^\s")), 0).when(F.regexp_like(c, F.lit(r"^\p{L}")), 1).when(F.regexp_like(c, F.lit("^[0-9]")), 2).otherwise(3)


def _kind(generator: str, s: Column) -> Column:
    if generator in ("mail", "colons", "account"):
        return F.lit({"mail": EMAIL, "colons": IP, "account": IBAN}[generator])
    n = F.length(_digits(s))
    dots = F.regexp_like(s, F.lit(r"^[0-9]+(?:\.[0-9]+){3}$")) & (n <= 12)
    return F.when(dots, IP).when(n > 12, CARD).when(F.regexp_like(s, F.lit("^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), SSN).otherwise(PHONE)


def _features(x: Column) -> list[Column]:
    """Format and context of a candidate ``kind, s, pre, post``, as numbers."""
    s, n = x["s"], F.length(_digits(x["s"]))
    groups = F.transform(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), lambda g: F.length(g))
    count = lambda chars: F.length(F.regexp_replace(s, f"[^{chars}]", ""))
    has = lambda c, p: F.regexp_like(c, F.lit(p)).cast("int")
    announced = F.lit(0)
    for kind, words in CUES.items():
        announced = F.when(x["kind"] == kind, has(x["pre"], rf"(?i)(?<!\p{{L}})(?:{words})\P{{L}}{{0,8}}$")).otherwise(announced)
    return [
        x["kind"],
        F.length(s),
        n,
        F.size(groups),
        F.coalesce(F.array_max(groups), F.lit(0)),
        F.coalesce(F.array_min(groups), F.lit(0)),
        F.coalesce(F.get(groups, 0), F.lit(0)),
        F.when(F.size(groups) > 0, F.element_at(groups, -1)).otherwise(0),
        has(s, r"^\+"),
        count("("),
        count(r"\-"),
        count("."),
        count(" "),
        count("/"),
        F.when(n > 11, _luhn(_digits(s)).cast("int")).otherwise(0),
        has(s, r"^\(?0"),
        has(s, _OCTETS),
        F.when(x["kind"] == IBAN, _mod97(s)).otherwise(0),
        F.length(F.regexp_extract(s, "[A-Za-z]+$", 0)),
        has(s, "@"),
        count(":"),
        _beside(F.right(x["pre"], F.lit(1))),
        _beside(x["post"]),
        announced,
        has(x["pre"], rf"(?i)(?<!\p{{L}})(?:{ORDINARY})\P{{L}}{{0,8}}$"),
        has(s, r"^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{2,4})$"),
    ]


N_FEATURES = 26


def _proposed(rows: DataFrame, text: str, to: str) -> DataFrame:
    """``rows`` with ``to``: all candidates ``start, end, kind, f`` (features as an array), nearest first."""
    parts = {f"{to}_{g}": _marked(F.col(text), p) for g, p in GENERATORS.items()}
    out = rows.withColumns(parts)

    def by(g: str) -> Column:
        short = F.filter(_spans(F.col(f"{to}_{g}")), lambda x: F.length(x["s"]) <= LONGEST)
        return F.transform(short, lambda x: F.struct(x["start"], x["end"], _kind(g, x["s"]).alias("kind"), x["s"], x["pre"], x["post"]))

    every = map(by, GENERATORS)
    whole = F.array_distinct(F.transform(F.concat(*every), lambda x: F.struct(x["start"], x["end"], x["kind"], F.array(*(f.cast("double") for f in _features(x))).alias("f"))))
    return out.withColumn(to, whole).drop(*parts)


def based(rows: DataFrame, text: str, to: str) -> DataFrame:
    """``rows`` with ``to``: the base spans ``start, kind, end``, sorted."""
    parts = {f"{to}_{k}": _marked(F.col(text), p) for k, p in BASE.items()}

    def by(k: int) -> Column:
        return F.transform(F.filter(_spans(F.col(f"{to}_{k}")), lambda x: _valid(k, x["s"])), lambda x: F.struct(x["start"], F.lit(k).alias("kind"), x["end"]))

    kept = map(by, BASE)
    return rows.withColumns(parts).withColumn(to, F.sort_array(F.concat(*kept))).drop(*parts)


@dataclass(frozen=True)
class Fit:
    """Bounds of what the trees are fitted on: at most ``contexts`` windows of words (about; documents are chosen by hash), each
    with all forms. ``precision`` is asked of the added spans of each kind on windows that the trees haven't seen."""

    contexts: int = 600
    trees: int = 24
    depth: int = 4
    precision: float = 0.99
    seed: int = 17


@dataclass(frozen=True)
class Model:
    """The fitted trees as (weight, nested (feature, threshold, left, right) or value), and the least margin by kind."""

    trees: tuple
    least: tuple[float, ...]

    def margin(self, f: Column) -> Column:
        def grow(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(node)
            k, at, left, right = node
            return F.when(F.get(f, k) <= at, grow(left)).otherwise(grow(right))

        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + F.lit(weight) * grow(root)
        return total

    def accepts(self, kind: Column, margin: Column) -> Column:
        return margin >= F.get(F.array(*map(F.lit, self.least)), kind)


def _forms(h: Column) -> Column:
    """Spans by rule from 64 hexadecimal digits: ``label, kind, cue, s``; ``cue`` is 2 where the span is personal only if it is
    announced, 1 where it may be announced."""
    digits = F.translate(h, "abcdef", "012345")
    d = lambda at, n: F.substring(digits, at, n)
    word = lambda at, n: F.translate(F.substring(h, at, n), "0123456789", "ghijklmnop")
    cat = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    one = lambda at, *p: F.get(F.array(*map(F.lit, p)), (F.ascii(F.substring(h, at, 1)) % len(p)).cast("int"))
    last = lambda body, fits: cat(body, F.filter(F.array(*(F.lit(str(i)) for i in range(10))), lambda c: _luhn(F.concat(body, c)) == fits)[0])
    card, wrong = last(cat("4", d(1, 14)), True), last(cat("4", d(1, 14)), False)
    quad = lambda c, sep: cat(F.substring(c, 1, 4), sep, F.substring(c, 5, 4), sep, F.substring(c, 9, 4), sep, F.substring(c, 13, 4))
    bare = cat("DE00", d(20, 18))
    iban = cat("DE", F.lpad((98 - _mod97(bare)).cast("string"), 2, "0"), d(20, 18))
    false_iban = cat("DE", F.lpad((97 - _mod97(bare) % 90).cast("string"), 2, "0"), d(20, 18))
    fours = lambda c: F.rtrim(F.regexp_replace(c, "(.{4})", "$1 "))
    x = lambda at: F.substring(h, at, 4)
    tld = one(60, "com", "org", "net", "de", "io")
    octet = lambda at: (F.pmod(F.xxhash64(h, F.lit(at)), F.lit(255))).cast("string")
    personal = [
        (EMAIL, 1, cat(word(1, 5), ".", word(7, 4), "@", word(12, 7), ".", tld)),
        (EMAIL, 1, cat(word(1, 6), one(2, " at ", " [at] ", " (at) ", "(at)", "[at]"), word(12, 7), one(3, " dot ", " [dot] ", " (dot) ", "[dot]", "."), tld)),
        (EMAIL, 1, cat(word(1, 6), one(2, " @ ", " @", "@ "), word(12, 7), ".", tld)),
        (EMAIL, 1, cat(word(1, 4), d(5, 2), " at ", word(12, 5), " dot ", word(20, 4), " dot ", tld)),
        (IP, 1, cat(octet(1), ".", octet(2), ".", octet(3), ".", octet(4))),
        (IP, 1, cat("2", F.substring(h, 1, 3), ":", x(5), ":", x(9), ":", x(13), ":", x(17), ":", x(21), ":", x(25), ":", x(29))),
        (IP, 1, cat("2", F.substring(h, 1, 3), ":", F.substring(h, 5, 3), ":", x(9), "::", F.substring(h, 17, 2))),
        (CARD, 1, card),
        (CARD, 1, quad(card, one(30, " ", "-"))),
        (CARD, 1, quad(card, one(30, ".", "/"))),
        (PHONE, 1, cat("+", d(1, 2), " (", d(4, 3), ") ", d(8, 3), "-", d(12, 4))),
        (PHONE, 1, cat("(", d(4, 3), ") ", d(8, 3), "-", d(12, 4))),
        (PHONE, 1, cat(d(4, 3), "-", d(8, 3), "-", d(12, 4))),
        (PHONE, 2, cat(d(4, 3), one(9, ".", " ", "/"), d(8, 3), one(9, ".", " ", "-"), d(12, 4))),
        (PHONE, 1, cat("00", d(1, 2), " ", d(4, 3), " ", d(8, 3), one(9, "", " "), d(12, 4))),
        (PHONE, 2, cat("0", d(1, 3), one(9, " ", "/", "-"), d(6, 7))),
        (PHONE, 2, d(1, 10)),
        (IBAN, 1, iban),
        (IBAN, 1, fours(iban)),
        (SSN, 1, cat(d(1, 3), "-", d(4, 2), "-", d(6, 4))),
    ]
    ordinary = [
        (CARD, wrong),
        (CARD, quad(wrong, one(30, " ", "-", ".", "/"))),
        (PHONE, cat("1", d(1, 8))),
        (PHONE, d(1, 10)),
        (PHONE, F.left(d(1, 12), 5 + F.ascii(h) % 7)),
        (CARD, d(1, 13)),
        (PHONE, cat("20", d(1, 2), "-", d(3, 2), "-", d(5, 2))),
        (PHONE, cat(d(1, 2), one(9, ".", "/"), d(3, 2), one(9, ".", "/"), "20", d(5, 2))),
        (PHONE, cat(d(1, 1), ".", d(2, 1), ".", d(3, 2))),
        (PHONE, cat(d(1, 3), ".", d(4, 2))),
        (IP, cat("3", d(1, 2), ".4", d(3, 2), ".", d(5, 3), ".", d(8, 2))),
        (PHONE, cat(d(1, 3), "-", d(4, 3))),
        (PHONE, cat(d(1, 4), "-", d(5, 4))),
        (PHONE, cat("978-", d(1, 1), "-", d(2, 4), "-", d(6, 4), "-", d(10, 1))),
        (PHONE, cat(d(1, 3), " ", d(4, 3), " ", d(7, 2))),
        (PHONE, cat("1", d(1, 1), ":", d(2, 2), ":", d(4, 2), ":", d(6, 2), ":", d(8, 2))),
        (IP, cat("1", d(1, 1), ":", d(2, 2), ":", d(4, 2), ":", d(6, 2))),
        (IBAN, false_iban),
        (IBAN, cat("AB", d(1, 2), F.upper(word(3, 9)), d(20, 8))),
        (EMAIL, cat(word(1, 5), " at ", word(12, 5), ".", d(1, 2))),
        (EMAIL, cat(word(1, 5), " at ", word(12, 5), ".", F.upper(word(20, 1)), word(21, 7))),
        (EMAIL, cat(word(1, 5), " at ", word(12, 2), " dot ", word(20, 9))),
        (SSN, cat(d(1, 3), "-", d(4, 2), "-", d(6, 5))),
        (PHONE, cat(word(1, 2), d(1, 10), word(5, 3))),
        (PHONE, F.lower(h)),
    ]
    rows = [F.struct(F.lit(1).alias("label"), F.lit(k).alias("kind"), F.lit(c).alias("cue"), s.alias("s")) for k, c, s in personal]
    rows += [F.struct(F.lit(0).alias("label"), F.lit(k).alias("kind"), F.lit(0).alias("cue"), s.alias("s")) for k, s in ordinary]
    return F.array(*rows)


def _windows(documents: DataFrame, text: str, fit: Fit) -> DataFrame:
    """``w, start, end, label, held``: windows of the corpus' words with one written span each."""
    rows = documents.select(F.col(text).alias("t")).where("t <> ''")
    share = fit.contexts / max(1, rows.count())
    chosen = rows.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < F.lit(int(min(1.0, share) * (1 << 30)) + 1)).distinct()
    words = chosen.withColumn("x", F.split("t", " ")).withColumn("at", F.pmod(F.xxhash64("t", F.lit(1)), F.size("x")).cast("int"))
    near = lambda a, n: F.array_join(F.slice("x", a, n), " ")
    cut = words.select(F.right(near(F.greatest(F.lit(1), F.col("at") - 5), 5), F.lit(80)).alias("pre"), F.left(near(F.col("at") + 1, 4), F.lit(80)).alias("post"))
    cut = cut.distinct().unionAll(documents.sparkSession.range(16).select(F.lit("").alias("pre"), F.lit("").alias("post")).withColumn("pre", F.when(F.lit(False), "x").otherwise("")))
    keyed = cut.withColumn("h", F.sha2(F.concat_ws("\x1f", F.lit(str(fit.seed)), "pre", "post"), 256))
    spans = keyed.select("*", F.posexplode(_forms(F.col("h"))).alias("n", "x"))
    spans = spans.withColumn("r", F.pmod(F.xxhash64("h", "n"), F.lit(1 << 20)))
    lists = F.array(*(F.split(F.lit(CUES[k].replace("?", "")), r"\|") for k in range(len(KINDS))))
    pick = lambda a: F.element_at(a, 1 + (F.col("r") % F.size(a)).cast("int"))
    says = F.when((F.col("x.cue") == 2) | (F.col("x.cue") == 1) & (F.col("r") % 2 == 0), pick(F.get(lists, F.col("x.kind"))))
    says = says.when((F.col("x.label") == 0) & (F.col("r") % 2 == 0), pick(F.split(F.lit(ORDINARY), r"\|")))
    lead = F.concat(F.when(F.col("pre") == "", "").otherwise(F.concat("pre", F.lit(" "))), F.coalesce(F.concat(says, F.when(F.col("r") % 3 == 0, ": ").otherwise(" ")), F.lit("")))
    tail = F.concat(F.when(F.col("r") % 5 == 0, ". ").when(F.col("r") % 5 == 1, ", ").otherwise(" "), "post")
    out = spans.select("h", F.concat(lead, "x.s", tail).alias("w"), F.length(lead).cast("long").alias("start"), (F.length(lead) + F.length("x.s")).cast("long").alias("end"), "x.label")
    return out.withColumn("held", F.pmod(F.xxhash64("h"), F.lit(4)) == 0)


def labelled(documents: DataFrame, text: str = "text", fit: Fit | None = None) -> DataFrame:
    """``kind, f, label, held``: the candidates in the windows. What meets a base span that isn't the written one is left out,
    since the windows' own words may hold personal data."""
    rows = based(_proposed(_windows(documents, text, fit or Fit()), "w", "c"), "w", "b")
    meets = F.exists("b", lambda b: (b["start"] < F.col("x.end")) & (b["end"] > F.col("x.start")) & ~((b["start"] == F.col("start")) & (b["end"] == F.col("end"))))
    right = (F.col("x.start") == F.col("start")) & (F.col("x.end") == F.col("end")) & (F.col("label") == 1)
    return rows.select("*", F.explode("c").alias("x")).where(right | ~meets).select("x.kind", "x.f", right.cast("int").alias("label"), "held")


def _tree(node) -> tuple | float:
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    return node.split().featureIndex(), float(node.split().threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def train(documents: DataFrame, text: str = "text", fit: Fit | None = None) -> Model:
    """Trees and thresholds for a corpus. An empty corpus gives the spans without words around them."""
    fit = fit or Fit()
    rows = stage(labelled(documents, text, fit), "personal-labelled")
    names = [f"f{i}" for i in range(N_FEATURES)]
    flat = rows.where("NOT held").select("label", *(F.get("f", i).alias(n) for i, n in enumerate(names)))
    wide = VectorAssembler(inputCols=names, outputCol="features").transform(flat.sort("label", *names))
    gbt = GBTClassifier(labelCol="label", maxIter=fit.trees, maxDepth=fit.depth, stepSize=0.3, maxBins=64, seed=fit.seed).fit(wide)
    trees = tuple((float(w), _tree(t._call_java("rootNode"))) for w, t in zip(gbt.treeWeights, gbt.trees, strict=True))
    seen = rows.where("held").select("kind", "label", F.round(Model(trees, ()).margin(F.col("f")), 6).alias("m"))
    by = Window.partitionBy("kind").orderBy(F.desc("m"))
    sums = seen.groupBy("kind", "m").agg(F.sum("label").alias("y"), F.count("*").alias("n")).withColumns({"y": F.sum("y").over(by), "n": F.sum("n").over(by)})
    least = dict(sums.where(F.col("y") >= fit.precision * F.col("n")).groupBy("kind").agg(F.min("m")).collect())
    discard(rows)
    return Model(trees, tuple(least.get(float(k), least.get(k, float("inf"))) for k in range(len(KINDS))))


def scan(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with ``base`` and ``added``: arrays of ``start, kind, end`` (code points, end exclusive), sorted.

    A candidate is added where its margin reaches its kind's threshold, it meets no base span, and no other such candidate that
    it meets has a higher margin (then: is longer, begins earlier). Null texts read as empty ones and have no spans; equal texts have
    equal spans; columns of these two names are replaced. There is no shuffle: the spans of one text are compared with those near them.
    """
    t, b, c = (_fresh(documents, n) for n in ("t", "b", "c"))
    rows = _proposed(based(documents.withColumn(t, F.coalesce(F.col(text), F.lit(""))), t, b), t, c)
    pick = lambda x: F.struct(x["start"], x["end"], x["kind"].cast("int").alias("kind"), model.margin(x["f"]).alias("m"))
    meets = lambda x, y: (x["start"] < y["end"]) & (x["end"] > y["start"])
    rank = lambda x: F.struct(x["m"], x["end"] - x["start"], -x["start"], x["kind"])

    def apart(x: Column, y: Column, beats: Callable[[Column, Column], Column]) -> Column:
        """Of ``x`` what no ``y`` near it beats; ``y`` is narrowed once for each chunk of ``x``."""

        def chunk(k: Column) -> Column:
            lo, hi = k[0]["start"], F.array_max(F.transform(k, lambda s: s["end"]))
            return _bind(F.filter(y, lambda s: (s["start"] < hi) & (s["end"] > lo)), lambda near: F.filter(k, lambda s: ~F.exists(near, lambda o: beats(s, o))))

        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _CHUNK).cast("int")), lambda i: F.slice(x, i * _CHUNK + 1, _CHUNK))
        return F.when(F.size(x) > 0, F.flatten(F.transform(cut, chunk))).otherwise(x)

    good = F.sort_array(F.filter(F.transform(F.col(c), pick), lambda x: model.accepts(x["kind"], x["m"])))
    free = _bind(good, lambda x: apart(x, F.col(b), meets))
    best = _bind(free, lambda x: apart(x, x, lambda s, o: meets(s, o) & (rank(o) > rank(s))))
    added = F.array_distinct(F.transform(best, lambda x: F.struct(x["start"], x["kind"], x["end"])))
    return rows.withColumns({"base": F.col(b), "added": added}).drop(t, b, c)


def _fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't (nor one that begins with it)."""
    while any(x.lower().startswith(name) for x in df.columns):
        name += "_"
    return name


def _shown(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each of the sorted spans as its kind in brackets; spans that meet become one."""
    names = F.array(*map(F.lit, KINDS))

    def step(a: Column, x: Column) -> Column:
        met = x["start"] < a["at"]
        more = F.concat(F.substring(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit("["), F.get(names, x["kind"]), F.lit("]"))
        return F.struct(F.when(met, a["out"]).otherwise(F.concat(a["out"], F.array(more))).alias("out"), F.greatest(a["at"], x["end"]).alias("at"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("long").alias("at"))
    return _bind(F.aggregate(spans, start, step), lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(documents, train(documents)).select("doc_id", "base", "added")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    counts = map(count, BASE)
    return found.select("doc_id", *counts, F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.sort_array(F.concat("base", "added"))).alias("spans"))
