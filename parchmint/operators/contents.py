"""Tables of contents: hierarchy, floats, labels, filters with ancestors, text rendering.

``entries``: ``doc, ord, level, depth, number, title, page, anchor, file, line`` (see ``readers.toc_lines``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.operators import ordered
from parchmint.sources.staging import Rounds

LEVELS = 6


def tree(entries: DataFrame) -> DataFrame:
    """``entries`` with ``parent`` and ``ancestors`` (nearest first): of the last earlier entry of each depth those that are
    shallower than the entry and behind the last ones of all lesser depths. One running window and plain comparisons."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("depth") == d, F.col("ord")), ignorenulls=True).over(w) for d in range(LEVELS)]
    out = entries.withColumns({f"__{d}": x for d, x in enumerate(last)})
    above = []
    for d in range(LEVELS):
        lesser = [F.col(f"__{k}") for k in range(d)]
        behind = F.lit(True) if d == 0 else F.coalesce(F.col(f"__{d}") >= (F.greatest(*lesser) if d > 1 else lesser[0]), F.lit(True))
        above.insert(0, F.when((F.col("depth") > d) & behind, F.col(f"__{d}")))
    out = out.withColumn("ancestors", F.array_compact(F.array(*above))).drop(*(f"__{d}" for d in range(LEVELS)))
    return out.withColumn("parent", F.try_element_at("ancestors", F.lit(1)))


def with_labels(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """``entries`` with the ``label`` of their anchor (``labels(doc, anchor, label)``), empty without one."""
    return entries.join(labels, ["doc", "anchor"], "left").withColumn("label", F.coalesce("label", F.lit("")))


def float_parents(floats: DataFrame, entries: DataFrame) -> DataFrame:
    """``floats(doc, file, line, page, ...)`` with ``parent``: in the float's own file the last heading (in document order)
    at or before its line; else the last heading before the first one beyond the float's page. Two as-of joins."""
    # written once, since the number must be the same wherever it is read, and entries are dear to parse
    rounds = Rounds(floats.sparkSession, "floats")
    f = rounds.put(floats.withColumn("__id", F.monotonically_increasing_id()))
    heads = rounds.put(entries.select("doc", "file", "line", "ord", "page"))
    # of the headings at or before the line the last in document order, which needn't be the one with the greatest line
    best = heads.where("file <> ''").groupBy("doc", "file", "line").agg(F.max("ord").alias("own"))
    best = best.withColumn("own", F.max("own").over(Window.partitionBy("doc", "file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    own = ordered.asof(f.select("doc", "file", "line", "__id").where("file <> ''"), best, ["doc", "file"], "line", ["own"]).select("__id", "own")
    reach = F.max("page").over(Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    runs = heads.withColumn("page", reach).groupBy("doc", "page").agg(F.max("ord").alias("by_page"))
    by_page = ordered.asof(f.select("doc", "page", "__id"), runs, ["doc"], "page", ["by_page"]).select("__id", "by_page")
    return f.join(own, "__id", "left").join(by_page, "__id", "left").withColumn("parent", F.coalesce("own", "by_page")).drop("__id", "own", "by_page")


def matched(entries: DataFrame, query: str = "", file: str = "", pages: tuple[int, int] | None = None) -> DataFrame:
    """``doc, ord`` of what is shown under all given filters: for each filter the entries that satisfy it and their
    ancestors, and of these sets the intersection. ``entries`` as from ``tree``."""
    tests: list[Column] = []
    if query:
        q = query.lstrip("§¶").lower()
        tests.append(F.contains(F.lower("title"), F.lit(q)) | ((F.col("number") != "") & F.contains(F.lower("number"), F.lit(q))))
    if file:
        tests.append((F.col("file") != "") & F.contains("file", F.lit(file)))
    if pages:
        tests.append(F.col("page").between(*pages))
    if not tests:
        return entries.select("doc", "ord")
    # one pass: what an entry satisfies holds for all that stands above it
    flags = [f"__{i}" for i in range(len(tests))]
    hit = entries.select("doc", F.explode(F.concat(F.array("ord"), "ancestors")).alias("ord"), *(F.coalesce(t, F.lit(False)).alias(c) for t, c in zip(tests, flags, strict=True)))
    met = hit.where(" OR ".join(flags)).groupBy("doc", "ord").agg(*(F.max(c).alias(c) for c in flags))
    return met.where(" AND ".join(flags)).select("doc", "ord")


def of_part(entries: DataFrame, part: str) -> DataFrame:
    """Entries below the parts of this number; where no part has it, below those whose title holds it."""
    parts = entries.where("level = 'part' AND parent IS NULL").withColumns({"by_number": F.col("number") == part, "by_title": F.contains(F.lower("title"), F.lit(part.lower()))})
    parts = parts.withColumn("any", F.max("by_number").over(Window.partitionBy("doc"))).where("by_number OR (NOT any AND by_title)").select("doc", F.col("ord").alias("root"))
    return entries.withColumn("root", F.coalesce(F.try_element_at("ancestors", F.lit(-1)), F.col("ord"))).join(parts, ["doc", "root"], "left_semi").drop("root")


def descendants(entries: DataFrame, floats: DataFrame | None = None) -> DataFrame:
    """``doc, ord, below, figures, tables``: how many entries and floats stand below each entry, at any depth (its own
    floats counted)."""
    none = F.lit(None).cast("string")
    up = entries.select("doc", F.explode("ancestors").alias("ord"), F.lit(1).alias("n"), none.alias("kind"))
    if floats is not None:
        chain = entries.select("doc", F.col("ord").alias("parent"), F.explode(F.concat(F.array("ord"), "ancestors")).alias("ord"))
        up = up.unionByName(floats.select("doc", "parent", "kind").join(chain, ["doc", "parent"]).select("doc", "ord", F.lit(0).alias("n"), "kind"))
    sums = up.groupBy("doc", "ord").agg(F.sum("n").alias("below"), F.count_if(F.col("kind") == "figure").alias("figures"), F.count_if(F.col("kind") == "table").alias("tables"))
    return entries.select("doc", "ord").join(sums, ["doc", "ord"], "left").select("doc", "ord", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("below", "figures", "tables")))


def render(entries: DataFrame, floats: DataFrame | None = None, depth: int = 3, shown: DataFrame | None = None, meta: DataFrame | None = None) -> DataFrame:
    """``doc, at, text``: the table as indented lines: number, title, ``[label]``, place (the file only where it differs from
    the parent's), page; fields of a new source file (``meta(file, field, value)``); floats; and for headings at the
    greatest depth a summary of what is below. ``shown``: see ``matched``. Every line is made from its entry and what stands
    above it, so no document is held whole."""
    rows = entries if "label" in entries.columns else entries.withColumn("label", F.lit(""))
    rows = rows.join(descendants(entries, floats), ["doc", "ord"])
    rows = rows.join(shown.withColumn("__shown", F.lit(True)), ["doc", "ord"], "left").withColumn("__shown", F.coalesce("__shown", F.lit(False))) if shown is not None else rows.withColumn("__shown", F.lit(True))
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("file", "label", "number", "title")})
    kind = entries.schema["ord"].dataType.simpleString()
    # what a line needs of the entries above it: the last earlier entries of each depth, of which the ancestors are some
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("depth") == d, F.struct(F.col("ord").alias("o"), F.col("file").alias("f"), (F.col("__shown") & (F.col("depth") < depth)).alias("open"))), ignorenulls=True).over(w) for d in range(LEVELS)]
    rows = rows.withColumn("__above", F.array(*last))
    chain = F.transform("ancestors", lambda a: F.filter("__above", lambda x: x["o"] == a)[0])
    rows = rows.withColumn("__chain", chain).drop("__above").where(F.col("__shown") & F.forall("__chain", lambda x: x["open"]))
    files = F.filter(F.transform("__chain", lambda x: x["f"]), lambda f: f != "")
    rows = rows.withColumn("__from", F.coalesce(F.try_element_at(files, F.lit(1)), F.lit(""))).withColumn("__pad", F.repeat(F.lit("  "), F.size("ancestors"))).drop("__chain")
    rows = rows.withColumn("__here", F.when(F.col("file") == "", F.col("__from")).otherwise(F.col("file")))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    given = lambda c: F.coalesce(c, F.lit(0)) != 0
    at = F.when(given(F.col("line")), F.concat(F.lit(":"), F.col("line").cast("string"))).otherwise("")
    place = F.when(F.col("file") == "", "").when(F.col("file") != F.col("__from"), F.concat(F.lit("  "), "file", at)).when(at != "", F.concat(F.lit("  "), at)).otherwise("")
    mark = F.when(F.col("level") == "part", F.concat(F.trim(F.concat(F.lit("Part "), "number")), F.lit(" "))).when(F.col("number") != "", F.concat(F.lit("§"), "number", F.lit(" "))).otherwise("")
    label = F.when(F.col("label") != "", F.concat(F.lit("  ["), "label", F.lit("]"))).otherwise("")
    page = F.when(given(F.col("page")), F.concat(F.lit("  p."), F.col("page").cast("string"))).otherwise("")
    none = F.array().cast("array<string>")
    parts = [F.array(F.concat("__pad", mark, "title", label, place, page))]
    if meta is not None:
        field = F.concat(F.lit("  # "), "field", F.lit(": "), "value")
        fields = meta.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("field", "value", field.alias("l")))), lambda x: x["l"]).alias("__meta"))
        rows = rows.join(fields, "file", "left")
        parts.append(F.when((F.col("file") != "") & (F.col("file") != F.col("__from")), F.transform("__meta", lambda x: F.concat("__pad", x))))
    if floats is not None:
        f = F.struct(F.col("kind").alias("k"), F.col("ord").cast("int").alias("at"), text(F.col("number")).alias("number"), text(F.col("caption")).alias("caption"), "page", F.coalesce("file", F.lit("")).alias("file"), "line")
        own = floats.where("parent IS NOT NULL AND kind IN ('figure', 'table')").groupBy("doc", F.col("parent").cast(kind).alias("ord")).agg(F.array_sort(F.collect_list(f)).alias("__floats"))
        rows = rows.join(own, ["doc", "ord"], "left")

        def shown_float(x: Column) -> Column:
            line = F.when(given(x["line"]), F.concat(F.lit(":"), x["line"].cast("string"))).otherwise("")
            where = F.when((x["file"] != "") & (x["file"] != F.col("__here")), F.concat(F.lit("  "), x["file"], F.lit(":"), text(x["line"]))).when(line != "", F.concat(F.lit("  "), line)).otherwise("")
            return F.concat("__pad", F.lit("  "), F.when(x["k"] == "figure", "Fig").otherwise("Tab"), F.lit(" "), x["number"], F.lit(": "), x["caption"], where, F.lit("  p."), text(x["page"]))

        parts.append(F.transform("__floats", shown_float))
    what = F.concat_ws(", ", *(F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" {n}"))) for c, n in (("below", "subsections"), ("figures", "figures"), ("tables", "tables"))))
    parts.append(F.when((F.col("depth") >= depth) & (what != ""), F.array(F.concat("__pad", F.lit("  ["), what, F.lit("]")))))
    lines = F.concat(*(F.coalesce(p, none) for p in parts))
    # a document's lines before each entry
    before = F.sum("__n").over(Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")
    out = rows.select("doc", "ord", lines.alias("__lines")).withColumn("__n", F.size("__lines")).withColumn("__first", before)
    return out.select("doc", "__first", F.posexplode("__lines").alias("__k", "text")).select("doc", (F.col("__first") + F.col("__k")).cast("int").alias("at"), "text")
