"""Figures: captions and the places that name them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# A caption up to a blank line or the next figure, and a figure's name in a text.
CAPTION = r"(?is)(?:Figure|Fig\.?|FIG\.?|Scheme)\s*(\d+)[.:\s](.+?)(?=\n\n|\nFig|\nFigure|\nScheme|\z)"
NAMED = r"(?i)(?:Figure|Fig\.?|FIG\.?)\s*(\d+)"


def captions(pages: DataFrame, figures: DataFrame, most: int = 500) -> DataFrame:
    """``key, figure, num, caption, page``: the first caption (by page) with the figure's number; figures without one are left
    out. ``pages(key, page, text)``, ``figures(key, figure, num)``."""
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(CAPTION), 1).alias("n"), F.regexp_extract_all("text", F.lit(CAPTION), 2).alias("c"))
    rows = pages.join(figures.select("key").distinct(), "key", "left_semi").select("key", "page", F.posexplode(found).alias("at", "x"))
    rows = rows.select("key", "page", "at", F.col("x.n").try_cast("long").alias("num"), F.left(F.btrim("x.c", F.lit(" \t\n\r\f\u000b")), F.lit(most)).alias("caption"))
    both = figures.join(rows, ["key", "num"])
    first = F.row_number().over(Window.partitionBy("key", "figure").orderBy("page", "at"))
    return both.withColumn("rn", first).where("rn = 1").select("key", "figure", "num", "caption", "page")


def contexts(pages: DataFrame, figures: DataFrame, reach: int = 100) -> DataFrame:
    """``key, figure, page, at, text``: every place that names a captioned figure, with ``reach`` characters on either side,
    line breaks as spaces. One pass over the pages of papers that have such figures."""
    known = captions(pages, figures)
    asked = known.groupBy("key").agg(F.collect_list(F.struct("figure", "num")).alias("asked"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = re.compile(NAMED)
        for pdf in it:
            out = []
            for key, page, text, wanted in zip(pdf["key"], pdf["page"], pdf["text"], pdf["asked"], strict=True):
                for m in name.finditer(text or ""):
                    for w in wanted:
                        if int(m[1]) == w["num"]:
                            out.append((key, w["figure"], page, m.start(), text[max(0, m.start() - reach) : m.end() + reach].strip().replace("\n", " ")))
            yield pd.DataFrame(out, columns=["key", "figure", "page", "at", "text"])

    return pages.join(asked, "key").select("key", "page", "text", "asked").mapInPandas(run, "key string, figure string, page int, at int, text string")
