"""Structure of marked-up manuscripts: facts by line, references, include graphs, back-of-book index, diffs, metadata."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions import ids

# Macros that cite, those of them that quote or name a place, words that name what a reference points at,
# macros that refer, headings.
CITE_MACROS = ("cite", "citep", "citet", "citeauthor", "citeq", "citeqp", "citeqm", "mcitebox", "mciteboxp")
DEEP_MACROS = ("mciteboxp", "mcitebox", "citeqp", "citeq", "citeqm")
REF_WORDS = ("Section", "Table", "Figure", "Equation", "Supplement", "Appendix", "Part")
REF_MACROS = ("ref", "autoref", "cref", "eqref")
SECTION_LEVELS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph")
# What stands before a heading in a list of changes.
HEADING_MARKS = {"part": "Part", "chapter": "Ch", "section": "§", "subsection": "§§", "subsubsection": "§§§", "paragraph": "¶"}

_ITEM = "array<struct<kind:string,name:string,extra:string>>"
_CITE = r"\\(" + "|".join(sorted(CITE_MACROS, key=len, reverse=True)) + r")\{([^}]+)\}"
_REF = "(" + "|".join(REF_WORDS) + r")?[~\s]*\\(?:" + "|".join(REF_MACROS) + r")\{([^}]+)\}"
_HEAD = r"\\(" + "|".join(SECTION_LEVELS) + r")\*?\{([^}]*)\}"


def _all(pattern: str, group: int) -> Column:
    return F.regexp_extract_all("text", F.lit(pattern), group)


def comment(text: Column) -> Column:
    return text.rlike(r"^\s*%")


def facts(lines: DataFrame) -> DataFrame:
    """(file, line, pos, kind, name, extra, near) of labels (extra: what they name), references (the word before them, else
    ``bare``), citations (macro), headings (level), inputs and index entries in lines that aren't comments. ``near`` is the
    last label at or before a reference's or citation's line. ``lines(file, line, text)``; one scan, one window."""
    item = lambda kind, name, extra: F.struct(F.lit(kind).alias("kind"), name.alias("name"), extra.alias("extra"))
    null = F.lit(None).cast("string")
    labels = _all(r"\\label\{([^}]+)\}", 1)
    refs = F.zip_with(_all(_REF, 1), _all(_REF, 2), lambda w, n: item("ref", n, F.when(w == "", "bare").otherwise(w)))
    keys = lambda ks: F.filter(F.transform(F.split(ks, ","), lambda k: F.trim(k)), lambda k: k != "")
    cites = F.flatten(F.zip_with(_all(_CITE, 1), _all(_CITE, 2), lambda m, ks: F.transform(keys(ks), lambda k: item("cite", k, m))))
    heads = F.zip_with(_all(_HEAD, 1), _all(_HEAD, 2), lambda m, t: item("section", t, m))
    inputs = F.transform(_all(r"\\(?:input|include)\{([^}]+)\}", 1), lambda n: item("input", F.when(n.endswith(".tex"), n).otherwise(F.concat(n, F.lit(".tex"))), null))
    index = F.transform(_all(r"\\index\{([^}]+)\}", 1), lambda n: item("index", n, null))
    found = F.concat(F.transform(labels, lambda n: item("label", n, ids.label_kind(n))), refs, cites, heads, inputs, index)
    own = lines.where(~comment(F.col("text")) & F.contains("text", F.lit("\\"))).select("file", "line", F.try_element_at(labels, F.lit(-1)).alias("label"), found.cast(_ITEM).alias("found"))
    carried = F.last("label", ignorenulls=True).over(Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    rows = own.withColumn("near", carried).select("file", "line", "near", F.posexplode("found").alias("pos", "x"))
    return rows.select("file", "line", "pos", "x.kind", "x.name", "x.extra", F.when(F.col("x.kind").isin("ref", "cite"), F.coalesce("near", F.lit(""))).alias("near"))


def tracked(lines: DataFrame, patterns: Mapping[str, tuple[str, Sequence[str]]]) -> DataFrame:
    """(file, line, name, raw, groups map) of a project's own patterns (name to pattern and group names), in comments too."""
    out = None
    for name, (pattern, groups) in patterns.items():
        raw = _all(f"({pattern})", 1)
        parts = [_all(f"({pattern})", k + 2) for k in range(len(groups))]
        zipped = F.arrays_zip(raw.alias("raw"), *(x.alias(f"g{k}") for k, x in enumerate(parts)))
        rows = lines.select("file", "line", F.explode(zipped).alias("x"))
        pairs = [y for k, g in enumerate(groups) for y in (F.lit(g), F.col(f"x.g{k}"))]
        rows = rows.select("file", "line", F.lit(name).alias("name"), "x.raw", (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("groups"))
        out = rows if out is None else out.unionAll(rows)
    return out


def snippets(lines: DataFrame, radius: int = 1, most: int = 200) -> DataFrame:
    """``file, line, snippet``: each line with its neighbours, blank lines and comments left out, cut with ``...``."""
    around = F.collect_list(F.trim("text")).over(Window.partitionBy("file").orderBy("line").rowsBetween(-radius, radius))
    text = F.array_join(F.filter(around, lambda x: (x != "") & ~x.startswith("%")), " ")
    return lines.select("file", "line", text.alias("t")).select("file", "line", F.when(F.length("t") > most, F.concat(F.left("t", F.lit(most)), F.lit("..."))).otherwise(F.col("t")).alias("snippet"))


def heading_map(lines: DataFrame) -> DataFrame:
    """``file, line, heading`` with the level's mark: the first heading of each line."""
    marks = F.create_map(*(F.lit(x) for kv in HEADING_MARKS.items() for x in kv))
    level = F.regexp_extract("text", _HEAD, 1)
    return lines.where(F.col("text").rlike(_HEAD)).select("file", "line", F.concat_ws(" ", F.coalesce(F.try_element_at(marks, level), F.lit("§")), F.regexp_extract("text", _HEAD, 2)).alias("heading"))


def markers(chunks: DataFrame, row_id: str, text: str) -> DataFrame:
    """``row_id, labels, refs, cites, sections, comment_ratio`` of chunks of source: all citing macros that begin with
    ``cite``, references by five macros; references and citations once each, in order of appearance."""
    of = lambda p, g=1: F.regexp_extract_all(F.col(text), F.lit(p), g)
    trim = lambda xs: F.filter(F.transform(xs, lambda k: F.trim(k)), lambda k: k != "")
    cites = F.concat(trim(F.flatten(F.transform(of(r"\\cite[a-z]*\{([^}]+)\}"), lambda x: F.split(x, ",")))), trim(of(r"\\mciteboxp?\{([^}]+)\}")))
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    share = F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda x: x.startswith("%"))) / F.size(lines)).otherwise(0.0)
    return chunks.select(
        row_id,
        of(r"\\label\{([^}]+)\}").alias("labels"),
        F.array_distinct(of(r"\\(?:eq|auto|c|page)?ref\{([^}]+)\}")).alias("refs"),
        F.array_distinct(cites).alias("cites"),
        of(r"\\(?:part|chapter|section|subsection|subsubsection|paragraph)\*?\{([^}]+)\}").alias("sections"),
        share.alias("comment_ratio"),
    )


def all_labels(marked: DataFrame) -> DataFrame:
    """(file, label) of chunks' comma lists (``file, chunk, labels``): each label where it stands first."""
    rows = marked.select("file", "chunk", F.posexplode(F.split("labels", ",")).alias("at", "l")).withColumn("label", F.trim("l")).where("label <> ''")
    first = F.row_number().over(Window.partitionBy("label").orderBy("file", "chunk", "at"))
    return rows.withColumn("rn", first).where("rn = 1").select("file", "label").orderBy("file", "label")


def undefined_refs(found: DataFrame) -> DataFrame:
    labels = found.where("kind = 'label'").select("name")
    return found.where("kind = 'ref'").join(labels, "name", "left_anti").select("name", "file", "line")


def orphan_labels(found: DataFrame) -> DataFrame:
    """Labels that no reference names; of several definitions the last counts."""
    w = Window.partitionBy("name").orderBy(F.desc("file"), F.desc("line"), F.desc("pos"))
    last = found.where("kind = 'label'").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    return last.join(found.where("kind = 'ref'").select("name"), "name", "left_anti").select("name", "file", "line")


def shallow_cites(found: DataFrame, least: int = 3) -> DataFrame:
    """Keys cited ``least`` times and more, never in depth: key, count, sorted files."""
    by = found.where("kind = 'cite'").groupBy("name").agg(F.count("*").alias("n"), F.max(F.col("extra").isin(*DEEP_MACROS)).alias("deep"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"))
    return by.where((F.col("n") >= least) & ~F.col("deep")).select("name", "n", "files")


def orphan_files(files: DataFrame, tree: DataFrame) -> DataFrame:
    """Files on disk that the include tree lacks, in folders that the tree has (the root folder aside)."""
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    seen = tree.select(folder.alias("d")).where("d <> ''").distinct()
    return files.join(tree, "file", "left_anti").withColumn("d", folder).join(seen, "d", "left_semi").select("file")


def build_index(entries: DataFrame) -> DataFrame:
    """(term, subterm) to sorted distinct pages and see-references; see-rows give no page. Terms without case first."""
    page = F.when(F.col("see_target").isNull(), F.col("page"))
    out = entries.groupBy("term", F.coalesce("subterm", F.lit("")).alias("subterm")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_set(page)), lambda p: p.cast("string")), ",").alias("pages"),
        F.array_join(F.array_sort(F.collect_set("see_target")), ",").alias("see"),
    )
    return out.orderBy(F.lower("term"), "term", "subterm")


def search_index(index: DataFrame, query: str, prefix: bool = False) -> DataFrame:
    """Terms that hold (or begin with) the query, and terms with a subterm that holds it; the matching subterms are named
    only where the term itself doesn't match."""
    low = query.lower()
    own = F.lower("term").startswith(low) if prefix else F.contains(F.lower("term"), F.lit(low))
    rows = index.groupBy("term").agg(F.array_sort(F.collect_list(F.when(F.contains(F.lower("subterm"), F.lit(low)), F.col("subterm")))).alias("subs"))
    rows = rows.withColumn("own", own).where(F.col("own") | (F.size("subs") > 0))
    return rows.select("term", F.when(F.col("own"), "").otherwise(F.array_join("subs", ",")).alias("matched_subterms")).orderBy(F.lower("term"))


def diff_hunks(lines: DataFrame) -> DataFrame:
    """Hunks of unified diffs: file, number, the line they start at and how many they have before and after, lines added and
    removed (file headers don't count). ``lines(file, line, text)``; what stands before a file's first hunk is left out."""
    from parchmint.operators.ordered import segments

    at = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    begins = F.regexp_like("text", F.lit(at))
    number = lambda k, absent=None: F.max(F.when(begins, F.coalesce(F.nullif(F.regexp_extract("text", at, k), F.lit("")), F.lit(absent)).try_cast("long")))
    signed = lambda sign: F.count_if(F.col("text").startswith(sign) & ~F.col("text").startswith(sign * 3))
    cut = segments(lines, ["file"], "line", begins, "hunk").where("hunk > 0")
    return cut.groupBy("file", "hunk").agg(number(3).alias("start"), number(4, "1").alias("lines"), number(1).alias("old_start"), number(2, "1").alias("old_lines"), signed("+").alias("added"), signed("-").alias("removed"))


def diff_totals(hunks: DataFrame) -> DataFrame:
    """Hunks, added and removed lines by file, and over all files (file null)."""
    return hunks.rollup("file").agg(F.count("*").alias("hunks"), F.coalesce(F.sum("added"), F.lit(0)).alias("added"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed"))


def rebuild_abstract(positions: DataFrame, row_id: str) -> DataFrame:
    """Texts from inverted indexes (``row_id, word, positions``)."""
    rows = positions.select(row_id, "word", F.explode("positions").alias("at"))
    return rows.groupBy(row_id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("abstract"))


# Fixed value: the line above a file's metadata.
META_HEADER = "% === FILE META (machine-readable, not rendered) ==="


def file_meta(files: DataFrame, header: str = META_HEADER, allowed: Sequence[str] | None = None) -> DataFrame:
    """(file, field, value) of the comment block behind the header line, up to the first line that is no comment; of fields
    named twice the last."""
    lines = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("at", "l")).withColumn("l", F.trim("l"))
    w = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    head = F.col("l") == header
    began = F.max(F.when(head, F.col("at"))).over(w)
    rows = lines.withColumns({"first": F.min(F.when(head, F.col("at"))).over(Window.partitionBy("file")), "began": began}).where("began IS NOT NULL")
    broke = F.max(F.when(~F.col("l").startswith("%"), 1).otherwise(0)).over(w)
    own = rows.withColumn("broke", broke).where("broke = 0 AND l <> '" + header.replace("'", "''") + "'")
    body = F.trim(F.substring("l", 2, 1 << 20))
    out = own.where(F.contains(body, F.lit(":"))).select("file", "at", F.trim(F.substring_index(body, ":", 1)).alias("field"), F.trim(F.regexp_replace(body, "^[^:]*:", "")).alias("value"))
    if allowed is not None:
        out = out.where(F.col("field").isin(*allowed))
    last = F.row_number().over(Window.partitionBy("file", "field").orderBy(F.desc("at")))
    return out.withColumn("rn", last).where("rn = 1").select("file", "field", "value")


def render_meta(meta: DataFrame, header: str = META_HEADER, order: Sequence[str] = ()) -> DataFrame:
    """``file, block``: fields with a value as a comment block, those of ``order`` first, the others by name."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("field")).cast("int"), F.lit(0)) if order else F.lit(0)
    rows = meta.where("value <> ''").withColumn("rank", F.when(rank == 0, len(order) + 1).otherwise(rank))
    line = F.transform(F.array_sort(F.collect_list(F.struct("rank", "field", "value"))), lambda x: F.concat(F.lit("% "), x["field"], F.lit(": "), x["value"]))
    return rows.groupBy("file").agg(F.concat(F.lit(header + "\n"), F.array_join(line, "\n"), F.lit("\n")).alias("block"))


def write_meta(files: DataFrame, meta: DataFrame, header: str = META_HEADER, order: Sequence[str] = ()) -> DataFrame:
    """``file, text`` with the block at the end in place of the old one; without a field that has a value it goes."""
    at = F.array_max(F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.trim(x).alias("l"), i.alias("i"))), lambda x: x["l"] == header), lambda x: x["i"]))
    body = F.when(at.isNull(), F.col("text")).otherwise(F.array_join(F.slice(F.split("text", "\n"), 1, F.greatest(at, F.lit(0))), "\n"))
    own = files.select("file", F.concat(F.rtrim(body, F.lit("\n")), F.lit("\n")).alias("body"))
    return own.join(render_meta(meta, header, order), "file", "left").select("file", F.concat(F.col("body"), F.coalesce(F.concat(F.lit("\n"), F.col("block")), F.lit(""))).alias("text"))


def flatten(title: str, rows: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """``key, text``: fields (``key, field, value``) as lines for search under ``<title>: <key>``; with ``order`` only its
    fields, in it."""
    own = rows.where("value <> ''")
    rank = F.lit(0)
    if order:
        own = own.where(F.col("field").isin(*order))
        rank = F.array_position(F.array(*map(F.lit, order)), F.col("field")).cast("int")
    line = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "field", "value"))), lambda x: F.concat(F.initcap(x["field"]), F.lit(": "), x["value"]))
    return own.groupBy(key).agg(F.concat(F.lit(f"{title}: "), F.first(F.col(key)), F.lit("\n"), F.array_join(line, "\n")).alias("text"))
