"""Fuzzy search for a needle in the first pages of a document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.operators.search import Ratios, token_set_ratio
from parchmint.operators.simjoin import spread

ENOUGH = 0.95


class _Needle:
    """The best window so far: its ratio, its page and where it lies there."""

    def __init__(self, text: str):
        self.text, self.ratio, self.page, self.begin, self.end = text, 0.0, "", 0, 0

    @property
    def snippet(self) -> str:
        return self.page[self.begin : self.end].strip()


class _Windows:
    """Needles are held against windows, many of them at once: ``search`` notes pairs, ``flush`` scores them. A window's words are
    taken once for all needles that share its size."""

    def __init__(self, most: int = 2, pairs: int = 1 << 17):
        self.most, self.pairs, self.ratios, self.noted = most, pairs, Ratios(), []

    def search(self, needles: Sequence[str], pages: Sequence[str]) -> list[_Needle]:
        """Lower-case needles; what is returned is filled in by ``flush``."""
        found, shapes = [_Needle(n) for n in needles], {}
        for n in found:
            shapes.setdefault((max(len(n.text) + len(n.text) // 2, 60), max(len(n.text) // 3, 20)), []).append(n)
        for (wide, step), own in shapes.items():
            sides = None
            for page in list(pages)[: self.most]:
                low = page.lower()
                for at in range(0, max(len(low) - wide + 1, 1), step):
                    if len(self.ratios.a) >= self.pairs:
                        self.flush()
                        sides = None
                    if sides is None:
                        own = [n for n in own if n.ratio < ENOUGH]
                        sides = [self.ratios.words(n.text, 0) for n in own]
                    window = self.ratios.words(low[at : at + wide], 1)
                    for words in sides:
                        self.ratios.add(words, window)
                    self.noted.append((own, page, at, at + wide))
        return found

    def flush(self) -> None:
        ratios = iter(self.ratios.take())
        for own, page, begin, end in self.noted:
            for n in own:
                ratio = next(ratios)
                if ratio > n.ratio and n.ratio < ENOUGH:
                    n.ratio, n.page, n.begin, n.end = ratio, page, begin, end
        self.noted = []


def window_search(needle: str, pages: Sequence[str], most: int = 2) -> tuple[float, str]:
    """(best ratio, snippet) of a lower-case needle among sliding windows of the first ``most`` pages: a window is half as
    long again as the needle (60 characters at least), and moves on by a third of it (20 at least). The first window of
    ``ENOUGH`` ends the search."""
    windows = _Windows(most)
    (found,) = windows.search([needle], pages)
    windows.flush()
    return found.ratio, found.snippet


def _likeliest(needles: Sequence[str], found: Sequence[_Needle]) -> dict:
    """The best of several needles, the first of equals; a needle of ``ENOUGH`` ends the search."""
    best = {"score": 0.0, "snippet": "", "needle": ""}
    for n, f in zip(needles, found, strict=True):
        if f.ratio > best["score"]:
            best = {"score": f.ratio, "snippet": f.snippet, "needle": n}
            if f.ratio >= ENOUGH:
                break
    return best


def search_pages(rows: DataFrame, needles: str | Sequence[str], pages: str, to: str | Sequence[str]) -> DataFrame:
    """``rows`` with ``to struct<score, snippet, needle>``: the best of an array column of needles in an array column of page
    texts; several such columns may be asked for at once. Arrow batches, dealt over all tasks; whole windows of a bounded
    number of pages, scored together for many rows."""
    asked, names = ([x] if isinstance(x, str) else list(x) for x in (needles, to))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in names), *(f"`{n}` struct<score:double,snippet:string,needle:string>" for n in names)])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for low in range(0, len(pdf), 512):
                part, windows = pdf.iloc[low : low + 512], _Windows()
                own = {}
                for c in asked:
                    own[c] = []
                    for n, p in zip(part[c], part[pages], strict=True):
                        some = [x for x in n if x] if n is not None and p is not None and len(p) else []
                        own[c].append((some, [x.lower() for x in some]))
                found = []
                for k, p in enumerate(part[pages]):
                    every = [x for c in asked for x in own[c][k][1]]
                    found.append(windows.search(every, [x or "" for x in p]) if every else [])
                windows.flush()
                out = {name: [] for name in names}
                for k, f in enumerate(found):
                    for c, name in zip(asked, names, strict=True):
                        some = own[c][k][0]
                        out[name].append(_likeliest(some, f[: len(some)]))
                        f = f[len(some) :]
                yield part.assign(**out)

    return spread(rows.drop(*names)).mapInPandas(run, schema)


@F.pandas_udf(T.DoubleType())
def set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Token-set ratio (0 to 1); 0 where either side is null or has no word."""
    return pd.Series([token_set_ratio(x, y) if x is not None and y is not None else 0.0 for x, y in zip(a, b, strict=True)])


def needle_array(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))
