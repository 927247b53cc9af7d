"""URL filters by a bit-parallel wildcard automaton (multiword Shift-And).

All glob rules are laid out side by side in one bit vector of 64-bit words, one bit for each pattern state. One step
per character advances every rule at once: ``D = ((D << 1) | I) & B[c] | D & S[c]`` where ``B[c]`` marks the states that
accept byte ``c`` and ``S`` (``S[c]`` here) the states that loop on it (``*``). A batch of URLs is stepped column by column, so the work is
(longest URL) x (words of state) numpy operations on whole columns, whatever the number of rules.

Globs: ``*`` any bytes but ``/`` (none too), ``**`` any bytes, ``?`` one byte, anything else itself. A glob matches the
whole subject, which is the host followed by the path; so ``*.com/en/**`` can't mistake a path for a host.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parchmint.llm._arrow import slices, strings


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths that start with ``path``; ``verdict`` is allow or block."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        return f"{self.name}**", f"*.{self.name}**"


class ShiftAnd:
    """All patterns in one multiword automaton; ``match`` gives a (subjects x patterns) boolean table."""

    def __init__(self, globs: Sequence[str]):
        self.globs = list(globs)
        accepts: list[int | None] = []  # the byte that leads into each state; None for any, -1 for the first state
        loops: list[str] = []  # "", "*" or "**" by state
        first, last = [], []
        for glob in self.globs:
            first.append(len(accepts))
            accepts.append(-1)
            loops.append("")
            for piece in re.findall(rb"\*\*?|[^*]", glob.encode(), re.S):
                if piece[:1] == b"*":
                    loops[-1] = max(loops[-1], piece.decode())
                else:
                    accepts.append(None if piece == b"?" else piece[0])
                    loops.append("")
            last.append(len(accepts) - 1)
        self.n_states = max(1, len(accepts))
        self.n_words = (self.n_states + 63) // 64
        enter, stay = np.zeros((2, 256, self.n_words * 64), bool)
        for s, b in enumerate(accepts):
            if b is None:
                enter[:, s] = True
            elif b >= 0:
                enter[b, s] = True
            if loops[s]:
                stay[:, s] = True
                stay[ord("/"), s] = loops[s] == "**"
        self.byte, self.loop = self._pack(enter), self._pack(stay)
        self.start = self._pack(self._mark(first))[0]
        self.last = np.array(last, np.int64)

    def _mark(self, states: Iterable[int]) -> np.ndarray:
        out = np.zeros((1, self.n_words * 64), bool)
        out[0, list(states)] = True
        return out

    def _pack(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).reshape(len(bits), self.n_words)

    def match(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        n, size = len(off) - 1, np.diff(off)
        d = np.tile(self.start, (n, 1))
        order = np.argsort(-size, kind="stable")
        longest = size[order]
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(longest[0]) if n else 0):
            live = order[: np.searchsorted(-longest, -j, "left")]  # subjects with a byte at j
            cur = d[live]
            moved = cur << one
            moved[:, 1:] |= cur[:, :-1] >> top
            c = raw[off[live] + j]
            d[live] = (moved & self.byte[c]) | (cur & self.loop[c])
        return (d[:, self.last >> 6] >> (self.last & 63).astype(np.uint64) & one).astype(bool)


def host_of(url: str = "url"):
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url"):
    """What follows the host up to ``? #`` or the end."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: Sequence[Rule], globs: Sequence[tuple[str, str]] = (), default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` (these replace columns of the same names).

    ``rules`` are exact host and path-prefix rules, the longest that fits wins; ``globs`` are (verdict, glob) pairs
    over ``host + path`` for the URLs that no rule fits: the first that matches decides, else ``default``.
    Null, empty and scheme-less URLs have empty host and path and get ``default`` unless a glob matches the empty
    text. Repeated rows are judged each; an empty table gives an empty table. The state is bounded by the rules' total
    length, and no rows meet: there is no shuffle.
    """
    rules, globs = list(rules), list(globs)
    names = [g for r in rules for g in r.globs()]
    automaton = ShiftAnd(names + [g for _, g in globs])
    # (length, position): the longest rule wins, the earlier one among equals
    rank = np.array([len(r.name.encode()) * (len(rules) + 1) + len(rules) - k for k, r in enumerate(rules)], np.int64)
    verdicts = np.array([r.verdict for r in rules] + [v for v, _ in globs] + [default], object)
    labels = np.array([r.name for r in rules] + [None] * (len(globs) + 1), object)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            subject = batch.column(batch.schema.get_field_index("__subject"))
            raw, off = strings(subject)
            chosen = np.full(batch.num_rows, len(verdicts) - 1, np.int64)
            for i, j in slices(off):
                hit = automaton.match(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                best = chosen[i:j]
                if globs:
                    g = hit[:, len(names) :]
                    best[:] = np.where(g.any(1), len(rules) + g.argmax(1), best)
                if rules:
                    fits = (hit[:, 0 : len(names) : 2] | hit[:, 1 : len(names) : 2]) * rank
                    best[:] = np.where(fits.any(1), fits.argmax(1), best)
            kept = [batch.column(k) for k, f in enumerate(batch.schema) if f.name != "__subject"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(labels[chosen], pa.string()), pa.array(verdicts[chosen], pa.string())], schema=arrow)

    base = pages.withColumn("__url", F.col(url)).drop("host", "path", "rule", "verdict").withColumns({"host": host_of("__url"), "path": path_of("__url")}).drop("__url")
    out = T.StructType([*base.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    arrow = to_arrow_schema(out)
    return base.withColumn("__subject", F.concat("host", "path")).mapInArrow(run, out)


#: The rules of the registered query, fixed by its contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)
#: Spam hosts and download traps, for URLs that no rule fits.
GLOBS = (("block", "*spam-farm.**"), ("block", "*cheap-pills.**"), ("block", "*casino*/**"), ("block", "**.exe"), ("block", "**/wp-login.php**"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES, GLOBS).select("page_id", "host", "path", "rule", "verdict")


_RULE_ROWS = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}', {k})" for k, r in enumerate(RULES))
_GLOB_CASE = " OR ".join("regexp_full_match(host || path, '" + re.escape(g).replace(r"\*\*", ".*").replace(r"\*", "[^/]*") + "', 's')" for _, g in GLOBS)
OP9_SQL = f"""
WITH rules(verdict, h, p, k) AS (VALUES {_RULE_ROWS}),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hit AS (SELECT page_id, h || p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, k) AS rn
        FROM parts JOIN rules r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, hit.rule AS rule,
       coalesce(hit.verdict, CASE WHEN {_GLOB_CASE} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN hit ON parts.page_id = hit.page_id AND rn = 1
"""
