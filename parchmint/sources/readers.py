"""Sources: line-ordered text, project files, dumps, build artefacts, bibliographies, cached API responses, metadata.

PDF parsing needs a library that isn't here: ``binary_pages`` and ``binary_info`` take its call as a parameter; everything
after them starts at ``pages (key, page, text)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.functions import text as tx

# File types by extension, and folders that are no part of a project.
FILE_TYPES = {
    ".tex": "tex", ".py": "python", ".md": "markdown", ".txt": "text", ".mmd": "mermaid", ".tikz": "tikz", ".sty": "tex", ".cls": "tex", ".bib": "bibtex", ".yaml": "yaml",
    ".yml": "yaml", ".toml": "toml", ".json": "json", ".sh": "shell", ".r": "r", ".jl": "julia", ".rst": "rst",
}
EXCLUDED = ("__pycache__", "venv", "node_modules", "build")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, text`` with line numbers from 1: whole files, then a positional explode keeps the order."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)


def file_type(path: Column) -> Column:
    """Type by extension, whatever its case; null for others."""
    kinds = F.create_map(*(F.lit(x) for kv in FILE_TYPES.items() for x in kv))
    return F.try_element_at(kinds, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def excluded(path: Column, folders: Sequence[str] = EXCLUDED, below: Sequence[str] = ()) -> Column:
    """Whether a relative path lies in a hidden or excluded folder, or below one of the paths ``below`` (an inbox)."""
    parts = F.split(path, "/")
    bad = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith(".") | p.isin(*folders))
    for x in below:
        bad = bad | path.startswith(x.rstrip("/") + "/")
    return bad


def project_files(spark: SparkSession, path: str, below: Sequence[str] = ()) -> DataFrame:
    """``file, file_type, modified, size, sha256`` of project files by extension; hidden and excluded folders (and what lies
    below the paths ``below``) are left out. Listing and hashing run in the cluster."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rel = F.regexp_replace(F.col("path"), r"^.*?\Q" + path.rstrip("/") + r"\E/", "")
    own = files.select(rel.alias("file"), file_type(rel).alias("file_type"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return own.where(F.col("file_type").isNotNull() & ~excluded(F.col("file"), below=below))


def binary_pages(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]], key: str = r"([^/]+)\.[^./]+$", known: DataFrame | None = None) -> DataFrame:
    """``key, page, text`` of binary documents, one text a page from 1. ``parse`` turns a file's bytes into its pages' texts
    (a PDF library's call, which isn't here); a file that it can't read gives no page. Keys in ``known`` (column ``key``) are
    read already and are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", key, 1).alias("key"), "content")
    if known is not None:
        files = files.join(known.select("key").distinct(), "key", "left_anti")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pages = parse(content)
                except Exception:  # a broken file must not stop the others
                    pages = []
                n = len(pages)
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.string()), pa.array(range(1, n + 1), pa.int32()), pa.array(pages, pa.string())], ["key", "page", "text"])

    return files.mapInArrow(run, "key string, page int, text string")


def binary_info(spark: SparkSession, path: str, parse: Callable[[bytes], dict[str, str]], key: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """``key, info map`` of binary documents' own metadata; a file that can't be read has none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", key, 1).alias("key"), "content")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for content in batch.column(1).to_pylist():
                try:
                    out.append([{"k": k, "v": v} for k, v in parse(content).items() if v])
                except Exception:  # as above
                    out.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])))], ["key", "info"])

    return files.mapInArrow(run, "key string, info array<struct<k:string,v:string>>").withColumn("info", F.map_from_entries("info"))


def state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines table of state; a missing one is empty, and rows that can't be read are left out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(Compressed) JSON lines; malformed and blank lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


# Depth of headings in a table of contents, and where a heading's anchor begins.
LEVEL_DEPTH = {"part": 0, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4, "subparagraph": 5}
HEADING_ANCHORS = ("section.", "subsection.", "subsubsection.", "paragraph.", "part.", "Doc-Start")
_PLACE = r"\\[a-z]*info\s*\{([^}]*)\}\{(\d+)\}"


def braces(text: str, most: int = 4) -> list[str] | None:
    """The first ``most`` arguments in balanced braces; None where there are fewer."""
    out, at = [], 0
    while len(out) < most:
        while at < len(text) and text[at] in " \t\n":
            at += 1
        if at >= len(text) or text[at] != "{":
            return None
        depth, begin = 1, at + 1
        at += 1
        while at < len(text) and depth:
            depth += (text[at] == "{") - (text[at] == "}")
            at += 1
        if depth:
            return None
        out.append(text[begin : at - 1])
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _braces(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else braces(t))


def content_lines(lines: DataFrame, place: str = _PLACE) -> DataFrame:
    """Entries of ``.toc``, ``.lof`` and ``.lot`` files (``file, line, text``): ``doc, ord, level, number, title, page, anchor,
    file, line``. Braces nest to any depth; ``place`` finds the source file and line in a title."""
    own = lines.where(F.ltrim("text").startswith("\\contentsline"))
    own = own.withColumn("x", _braces(F.regexp_replace(F.trim("text"), r"^\\contentsline", ""))).where("x IS NOT NULL")
    raw = F.col("x")[1]
    bare = F.regexp_replace(raw, place, "")
    number = r"\\numberline\s*\{([^}]*)\}"
    return own.select(
        F.col("file").alias("doc"),
        F.col("line").alias("ord"),
        F.trim(F.col("x")[0]).alias("level"),
        F.trim(F.regexp_extract(bare, number, 1)).alias("number"),
        tx.clean_heading(F.regexp_replace(bare, number, "")).alias("title"),
        F.coalesce(F.when(F.trim(F.col("x")[2]).rlike(r"^\d{1,9}$"), F.trim(F.col("x")[2])).cast("int"), F.lit(0)).alias("page"),
        F.trim(F.col("x")[3]).alias("anchor"),
        F.regexp_replace(F.trim(F.regexp_extract(raw, place, 1)), r"^\./", "").alias("file"),
        F.coalesce(F.nullif(F.regexp_extract(raw, place, 2), F.lit("")).cast("int"), F.lit(0)).alias("line"),
    )


def toc_lines(lines: DataFrame, place: str = _PLACE) -> DataFrame:
    """Headings of ``.toc`` files with their ``depth``; parts carry their Roman number in the title."""
    depth = F.create_map(*(F.lit(x) for kv in LEVEL_DEPTH.items() for x in kv))
    own = content_lines(lines, place).withColumn("depth", F.try_element_at(depth, F.col("level"))).where("depth IS NOT NULL")
    roman = r"^([IVXLCDM]+)\s+(.+)$"
    part = (F.col("level") == "part") & (F.col("number") == "") & F.col("title").rlike(roman)
    return own.withColumns({"number": F.when(part, F.regexp_extract("title", roman, 1)).otherwise(F.col("number")), "title": F.when(part, F.regexp_extract("title", roman, 2)).otherwise(F.col("title"))})


def float_lines(lines: DataFrame, kind: str, most: int = 120, place: str = _PLACE) -> DataFrame:
    """Figures of ``.lof`` or tables of ``.lot`` files: captions are cut to ``most`` characters, with dots."""
    own = content_lines(lines, place).where(F.col("level") == kind)
    cut = F.when(F.length("title") > most, F.concat(F.left("title", F.lit(most - 3)), F.lit("..."))).otherwise(F.col("title"))
    return own.select("doc", "ord", F.col("level").alias("kind"), "number", cut.alias("caption"), "page", "anchor", "file", "line")


def label_lines(lines: DataFrame) -> DataFrame:
    """``doc, anchor, label`` of headings from ``.aux`` files: the last label of an anchor, internal ones (with ``@``) left
    out."""
    p = r"\\newlabel\{([^}]+)\}\{\{([^}]*)\}\{(\d+)\}\{[^}]*\}\{([^}]*)\}"
    own = lines.where(F.col("text").rlike(p)).select(F.col("file").alias("doc"), "line", F.regexp_extract("text", p, 4).alias("anchor"), F.regexp_extract("text", p, 1).alias("label"))
    heading = F.lit(False)
    for x in HEADING_ANCHORS:
        heading = heading | F.col("anchor").startswith(x)
    return own.where(heading & ~F.contains("label", F.lit("@"))).groupBy("doc", "anchor").agg(F.max_by("label", "line").alias("label"))


def index_lines(lines: DataFrame) -> DataFrame:
    """``\\indexentry{term!subterm|format}{page}`` to ``term, subterm, format, see_target, page``; sort keys before ``@``
    are dropped."""
    p = r"^\\indexentry\s*\{((?:[^{}]|\{[^{}]*\})*)\}\s*\{(\d+)\}"
    body = F.split(F.regexp_extract("text", p, 1), r"\|", 2)
    names = F.transform(F.split(body[0], "!"), lambda x: F.element_at(F.split(x, "@"), -1))
    form = F.coalesce(F.get(body, F.lit(1)), F.lit(""))
    see = F.nullif(F.regexp_extract(form, r"^see(?:also)?\s*\{([^}]*)\}", 1), F.lit(""))
    return lines.where(F.col("text").rlike(p)).select(names[0].alias("term"), F.get(names, F.lit(1)).alias("subterm"), F.when(see.isNull(), F.nullif(form, F.lit(""))).alias("format"), see.alias("see_target"), F.regexp_extract("text", p, 2).cast("int").alias("page"))


def parse_bib(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(key, type, fields) of all entries; values in braces (nested), quotes or bare. Broken entries are skipped."""
    out = []
    for m in re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,", text):
        kind, key, at = m[1].lower(), m[2], m.end()
        if kind in ("comment", "string", "preamble"):
            continue
        fields: dict[str, str] = {}
        while f := re.compile(r"\s*([\w-]+)\s*=\s*").match(text, at):
            at = f.end()
            if at < len(text) and text[at] == "{":
                depth, begin = 0, at + 1
                while at < len(text):
                    depth += (text[at] == "{") - (text[at] == "}")
                    at += 1
                    if not depth:
                        break
                value = text[begin : at - 1]
            elif at < len(text) and text[at] == '"':
                end = text.find('"', at + 1)
                value, at = text[at + 1 : end], end + 1
            else:
                v = re.compile(r"[^,}\s]*").match(text, at)
                value, at = v[0], v.end()
            fields[f[1].lower()] = re.sub(r"\s+", " ", value).strip()
            if c := re.compile(r"\s*,").match(text, at):
                at = c.end()
        out.append((key, kind, fields))
    return out


def bibliography(spark: SparkSession, path: str) -> DataFrame:
    """``file, key, type, fields map, tags array`` of BibTeX files: brace matching runs on Arrow batches of files."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame([(f, *e) for f, t in zip(pdf.file, pdf.value, strict=True) for e in parse_bib(t)], columns=["file", "key", "type", "fields"])

    rows = whole.mapInPandas(run, "file string, key string, type string, fields map<string,string>")
    tags = F.filter(F.transform(F.split(F.coalesce(F.try_element_at("fields", F.lit("x-tags")), F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")
    return rows.withColumn("tags", tags)


def render_bib(entries: DataFrame) -> DataFrame:
    """``key, text``: entries as BibTeX, fields by name."""
    body = F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = {"), e["value"], F.lit("},\n"))), "")
    return entries.select("key", F.concat(F.lit("@"), F.col("type"), F.lit("{"), F.col("key"), F.lit(",\n"), body, F.lit("}\n")).alias("text"))


def round_trip(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys lost, gained or with another number of fields; empty after a faithful write."""
    a, b = before.select("key", F.size("fields").alias("n")), after.select("key", F.size("fields").alias("m"))
    both = a.join(b, "key", "full_outer")
    return both.where("n IS NULL OR m IS NULL OR n <> m").select("key", F.when(F.col("m").isNull(), "lost").when(F.col("n").isNull(), "gained").otherwise("fields").alias("problem"))


def xmp(packets: DataFrame, row_id: str, xml: str) -> DataFrame:
    """Title, creators, description, subjects, rights, DOI, publication, date and year of XMP packets; a field's own text or
    its first list item. Malformed XML gives nulls."""
    safe = F.when(F.col(xml).rlike(r"(?s)^\s*(<\?xpacket.*?\?>\s*)?<x:xmpmeta.*</x:xmpmeta>\s*(<\?xpacket.*?\?>\s*)?$"), F.col(xml))
    tag = lambda n: F.regexp_extract(safe, rf"(?s)<{n}(?:\s[^>]*)?>(.*?)</{n}>", 1)
    items = lambda n: F.regexp_extract_all(tag(n), F.lit(r"(?s)<rdf:li[^>]*>(.*?)</rdf:li>"), 1)
    one = lambda n: F.nullif(F.trim(F.coalesce(F.get(items(n), F.lit(0)), tag(n))), F.lit(""))
    return packets.select(
        row_id, one("dc:title").alias("title"), items("dc:creator").alias("creators"), one("dc:description").alias("description"), items("dc:subject").alias("subjects"), one("dc:rights").alias("rights"),
        one("prism:doi").alias("doi"), one("prism:publicationName").alias("publication"), one("prism:coverDate").alias("cover_date"), F.left(one("prism:coverDate"), F.lit(4)).try_cast("int").alias("year"),
    )


def api_papers(cached: DataFrame) -> DataFrame:
    """Graph-service papers from cached JSON (``data``): nulls for what is missing, five authors at most."""
    schema = "paperId string, title string, year int, citationCount int, abstract string, externalIds map<string,string>, authors array<struct<name:string>>"
    d = F.from_json("data", schema)
    return cached.select(d["paperId"].alias("s2_id"), d["title"].alias("title"), d["year"].alias("year"), d["citationCount"].alias("citation_count"), F.lower(F.try_element_at(d["externalIds"], F.lit("DOI"))).alias("doi"), F.slice(F.coalesce(d["authors"]["name"], F.array().cast("array<string>")), 1, 5).alias("authors"))


def api_works(cached: DataFrame) -> DataFrame:
    """Registry works from cached JSON: first title, authors as ``Family, Given``, year printed else online, journal."""
    schema = "message struct<DOI:string, title:array<string>, author:array<struct<family:string,given:string>>, `container-title`:array<string>, `published-print`:struct<`date-parts`:array<array<int>>>, `published-online`:struct<`date-parts`:array<array<int>>>>"
    m = F.from_json("data", schema)["message"]
    year = lambda n: F.get(F.get(m[n]["date-parts"], F.lit(0)), F.lit(0))
    names = F.transform(m["author"], lambda a: F.concat_ws(", ", a["family"], a["given"]))
    return cached.select(F.lower(m["DOI"]).alias("doi"), F.get(m["title"], F.lit(0)).alias("title"), F.coalesce(names, F.array().cast("array<string>")).alias("authors"), F.coalesce(year("published-print"), year("published-online")).alias("year"), F.get(m["container-title"], F.lit(0)).alias("journal"))


def api_open_works(cached: DataFrame) -> DataFrame:
    """Works of an open index from cached JSON: bare ids and DOIs, five authors at most, abstract from its inverted index."""
    schema = "id string, doi string, title string, publication_year int, cited_by_count int, authorships array<struct<author:struct<display_name:string>>>, open_access struct<is_oa:boolean,oa_url:string>, abstract_inverted_index map<string,array<int>>"
    d = F.from_json("data", schema)
    names = F.filter(F.transform(d["authorships"], lambda a: a["author"]["display_name"]), lambda n: n.isNotNull())
    words = F.flatten(F.transform(F.map_entries(d["abstract_inverted_index"]), lambda e: F.transform(e["value"], lambda at: F.struct(at.alias("at"), e["key"].alias("word")))))
    abstract = F.when(F.size(words) > 0, F.array_join(F.transform(F.array_sort(words), lambda x: x["word"]), " "))
    return cached.select(
        F.regexp_replace(d["id"], r"^https?://[^/]+/", "").alias("work_id"), F.lower(F.regexp_replace(d["doi"], r"(?i)^https?://(?:dx\.)?doi\.org/", "")).alias("doi"), d["title"].alias("title"),
        F.slice(F.coalesce(names, F.array().cast("array<string>")), 1, 5).alias("authors"), d["publication_year"].alias("year"), F.coalesce(d["cited_by_count"], F.lit(0)).alias("citation_count"),
        F.coalesce(d["open_access"]["is_oa"], F.lit(False)).alias("is_oa"), d["open_access"]["oa_url"].alias("oa_url"), abstract.alias("abstract"),
    )


def front_matter(files: DataFrame) -> DataFrame:
    """``file, slug, description, body`` of markdown files with a front-matter block."""
    block = r"(?s)^---\n(.*?)\n---\n?(.*)$"
    field: Column = F.regexp_extract(F.regexp_extract("text", block, 1), r"(?m)^description:\s*(.*)$", 1)
    return files.select("file", F.regexp_extract("file", r"([^/]+)\.md$", 1).alias("slug"), field.alias("description"), F.when(F.col("text").rlike(block), F.regexp_extract("text", block, 2)).otherwise(F.col("text")).alias("body"))
