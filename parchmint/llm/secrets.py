"""Secret scans by grammar inference.

Three fixed patterns (``assign``, ``access``, ``hex``) give the base spans. What they find in a bounded sample is the
labelled material: its values grow a frequency prefix tree over character classes, and states whose continuations are
statistically compatible (Hoeffding bound, recursively, as ALERGIA does) are merged into a probabilistic automaton. A
second automaton is inferred from ordinary text: runs of credential characters drawn by occurrence, so that words weigh
what they weigh in the corpus and a secret that stands once weighs nothing. Unlabelled text holds secrets too, so the
automata judge that sample themselves: what scores as a credential is taken out and the ordinary automaton is inferred
again. Numbers, hosts and file names are ordinary by their form, and rare among words, so a sample of distinct ones of each
is added. No rule says what a credential looks like.

Every run of six and more credential characters (the base's own least length) in the whole corpus, less what base spans
cover, is then scored by the likelihood of its format: the log ratio of the two automata, in all and per character. Equal
runs of a slice are scored once, and all of a slice's runs together, character by character, in numpy.

The automata are fitted on at most ``PER_KIND`` values a class; base patterns and candidates cover all of every text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.llm._arrow import _Q, mix, powers, slices, small_batches, strings
from parchmint.llm._scratch import discard, stage

#: The base patterns, fixed by the contract: name, pattern, group that is the secret, its least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),  # the runs of [0-9a-f]+ that are long enough
)
ADDED = "format"
#: Least length of a candidate: that of the shortest secret the base takes.
CANDIDATE = 6
#: Values to fit on, of each base kind, and runs of ordinary text.
PER_KIND, ORDINARY = 1000, 4000
#: Forms that are ordinary: numbers (dates, addresses, versions), and dotted names of short parts (hosts, files).
FORMS, PART = ("number", "name"), 15
#: Least log ratio: in all (the log odds of a run being no secret, some 1 in 10,000), and a character.
LEAST_TOTAL, LEAST_MEAN = 9.0, 0.4
#: Runs up to this length are scored together; longer ones one by one.
_TOGETHER = 256
_CACHE = 1 << 17

_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
_CLASS = {c: k for k, cs in enumerate(_CLASSES) for c in cs}
_END = len(_CLASSES)
_WITHIN = [math.log(len(cs)) for cs in _CLASSES]
_BYTE = np.full(256, 255, np.uint8)
for _c, _k in _CLASS.items():
    _BYTE[ord(_c)] = _k


class Automaton:
    """A probabilistic automaton: ``arcs[state][symbol] = (next state, log probability)``; ``_END`` ends."""

    def __init__(self, values: Iterable[str], alpha: float = 0.05):
        kids: list[dict[int, int]] = [{}]
        seen, ends = [0], [0]
        for value in values:
            s = 0
            seen[0] += 1
            for c in value:
                k = _CLASS[c]
                if k not in kids[s]:
                    kids[s][k] = len(kids)
                    kids.append({})
                    seen.append(0)
                    ends.append(0)
                s = kids[s][k]
                seen[s] += 1
            ends[s] += 1
        self.fitted = seen[0]
        # arcs carry their own counts, since after a merge several arcs may lead to one state
        flow = [{k: seen[t] for k, t in a.items()} for a in kids]
        bound = math.sqrt(0.5 * math.log(2 / alpha))

        def differ(a: int, na: int, b: int, nb: int) -> bool:
            return na > 0 and nb > 0 and abs(a / na - b / nb) > bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

        def compatible(a: int, b: int) -> bool:
            todo, done = [(a, b)], set()
            while todo:
                a, b = todo.pop()
                if (a, b) in done:
                    continue
                done.add((a, b))
                if differ(ends[a], seen[a], ends[b], seen[b]):
                    return False
                for k in kids[a].keys() | kids[b].keys():
                    if differ(flow[a].get(k, 0), seen[a], flow[b].get(k, 0), seen[b]):
                        return False
                    if k in kids[a] and k in kids[b]:
                        todo.append((kids[a][k], kids[b][k]))
            return True

        def fold(a: int, b: int) -> None:
            """Add the tree under ``b`` to the states from ``a`` on."""
            todo = [(a, b)]
            while todo:
                a, b = todo.pop()
                seen[a] += seen[b]
                ends[a] += ends[b]
                for k, t in kids[b].items():
                    flow[a][k] = flow[a].get(k, 0) + flow[b][k]
                    if k in kids[a]:
                        todo.append((kids[a][k], t))
                    else:
                        kids[a][k] = t

        red, blue = [0], [(0, k) for k in kids[0]]
        while blue:
            p, k = blue.pop(0)
            s = kids[p][k]
            if s in red:
                continue
            home = next((r for r in red if compatible(r, s)), None)
            if home is None:
                red.append(s)
            else:
                kids[p][k] = home
                fold(home, s)
            blue = [(r, c) for r in red for c in sorted(kids[r]) if kids[r][c] not in red]
        name = {s: i for i, s in enumerate(red)}
        self.arcs = []
        for s in red:
            n = seen[s] + 0.01 * (_END + 1)
            out = {k: (name[t], math.log((flow[s][k] + 0.01) / n)) for k, t in kids[s].items()}
            out[_END] = (-1, math.log((ends[s] + 0.01) / n))
            self.arcs.append((out, math.log(0.01 / n)))
        # the same as tables: next state and log probability by state and class, and of the end
        self.next = np.array([[arcs.get(k, (s, 0))[0] for k in range(_END)] for s, (arcs, _) in enumerate(self.arcs)], np.int32)
        self.logp = np.array([[arcs[k][1] if k in arcs else other for k in range(_END)] for arcs, other in self.arcs]) - np.array(_WITHIN)
        self.stop = np.array([arcs[_END][1] for arcs, _ in self.arcs])

    def score(self, value: str) -> float:
        """Log likelihood of the characters and the end; a symbol that a state doesn't know costs its share of the
        smoothing mass and stays in the state."""
        s, total = 0, 0.0
        for c in value:
            k = _CLASS[c]
            arcs, other = self.arcs[s]
            t, lp = arcs.get(k, (s, other))
            total += lp - _WITHIN[k]
            s = t
        return total + self.arcs[s][0][_END][1]

    def scores(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """``score`` of all runs ``data[start:end]``, which hold credential characters only."""
        state, out = np.zeros(len(start), np.int32), np.zeros(len(start))
        size = end - start
        long = np.flatnonzero(size > _TOGETHER)
        order = np.argsort(-np.where(size > _TOGETHER, 0, size), kind="stable")
        order = order[: len(start) - len(long)]
        live = len(order)
        for i in range(int(size[order[0]]) if live else 0):
            while size[order[live - 1]] <= i:
                live -= 1
            run = order[:live]
            k = _BYTE[data[start[run] + i]]
            out[run] += self.logp[state[run], k]
            state[run] = self.next[state[run], k]
        out += self.stop[state]
        for r in long.tolist():
            out[r] = self.score(data[start[r] : end[r]].tobytes().decode("ascii"))
        return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns' secrets, in order."""
    out = []
    for kind, (name, pattern, group, least) in enumerate(BASE):
        if name == "assign" and ":" not in text and "=" not in text or name == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(group), kind, m.end(group)))
    return sorted(out)


class Runs:
    """Maximal runs of at least ``CANDIDATE`` credential characters of a slice of texts, as byte and code point ranges."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.raw, self.off = raw, off
        self._points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))

    def without(self, spans: list[list[tuple[int, int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text) of what the base spans (``start, kind, end`` in code points, by text) leave of the runs,
        without the dots and dashes at their ends, where it is long enough: one merge of two sorted lists."""
        base = self._points[self.off[:-1]]
        doc = np.repeat(np.arange(len(spans)), [len(x) for x in spans])
        flat = np.array([(s, e) for x in spans for s, _, e in x], np.int64).reshape(-1, 2)
        mark = np.zeros(len(self.raw) + 1, np.int32)
        if len(flat):
            # span borders are characters of ASCII runs, so code points turn into bytes by search
            at = np.searchsorted(self._points, flat + base[doc][:, None], "left")
            at = np.where(self._points[at] == flat + base[doc][:, None], at, at - 1)
            np.add.at(mark, at[:, 0], 1)
            np.add.at(mark, at[:, 1], -1)
        free = (_BYTE[self.raw] != 255) & (np.cumsum(mark)[:-1] == 0)
        border = np.zeros(len(self.raw) + 1, bool)
        border[self.off] = True
        before = np.concatenate(([False], free[:-1])) & ~border[:-1]
        behind = np.concatenate((free[1:], [False])) & ~border[1:]
        a, z = np.flatnonzero(free & ~before), np.flatnonzero(free & ~behind) + 1
        some = z - a >= CANDIDATE
        a, z = a[some], z[some]
        # the last character that is neither dot nor dash, at or before each place
        inner = np.maximum.accumulate(np.where((self.raw != 46) & (self.raw != 45), np.arange(len(self.raw)), -1)) if len(z) else z
        z = np.maximum(a, inner[z - 1] + 1)
        some = z - a >= CANDIDATE
        a, z = a[some], z[some]
        return a, z, np.searchsorted(self.off, a, "right") - 1

    def points(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return self._points[at] - self._points[self.off[doc]]


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str | None], np.ndarray, np.ndarray]]:
    texts = batch.column(batch.schema.get_field_index(column))
    raw, off = strings(texts)
    for i, j in slices(off):
        yield i, texts.slice(i, j - i).to_pylist(), raw[off[i] : off[j]], off[i : j + 1] - off[i]


def _forms(raw: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each run is a number, and whether it is a dotted name of short parts."""

    def held(characters: bytes) -> np.ndarray:
        mark = np.zeros(256, bool)
        mark[list(characters)] = True
        total = np.concatenate(([0], np.cumsum(mark[raw])))
        return total[z] - total[a]

    digits, dots, size = held(b"0123456789"), held(b"."), z - a
    lower = held(b"abcdefghijklmnopqrstuvwxyz")
    number = (digits + held(b".-/+") == size) & (digits > 0) & (size <= 32)
    name = (lower > 0) & (dots > 0) & (lower + digits + held(b".-_/") == size) & ((dots + held(b"/-_") + 1) * PART >= size)
    return number, name


def _least(rows: DataFrame, most: int) -> list[str]:
    return sorted(r.value for r in rows.groupBy("h", "value").count().orderBy("h", "value").limit(most).collect())


def labelled(docs: DataFrame, text: str = "text", per_kind: int = PER_KIND, ordinary: int = ORDINARY) -> dict[str, list[str]]:
    """At most ``per_kind`` distinct values of each base kind and of each of ``FORMS``, and under the empty name at most
    ``ordinary`` runs of ordinary text: those with the smallest hashes, the same whatever the partitioning. Runs are drawn by occurrence (text and
    place are hashed, so copies of a text count once)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[tuple[int, str], None]] = {}

        def keep(kind: str, value: str, h: int, most: int) -> None:
            own = kept.setdefault(kind, {})
            own[h, value[:512]] = None
            if len(own) > 4 * most:
                kept[kind] = dict.fromkeys(sorted(own)[:most])

        for batch in it:
            for _, texts, raw, off in _slices(batch, text):
                spans = [base_spans(t) if t else [] for t in texts]
                for t, own in zip(texts, spans, strict=True):
                    for s, kind, e in own:
                        keep(BASE[kind][0], t[s:e], int.from_bytes(hashlib.blake2b(t[s:e].encode(), digest_size=7).digest(), "big"), per_kind)
                a, z, doc = Runs(raw, off).without(spans)
                if not len(a):
                    continue
                salt = np.array([int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "big") for t in texts], np.uint64)
                for form, some in zip(FORMS, _forms(raw, a, z), strict=True):
                    for k in np.flatnonzero(some).tolist():
                        value = raw[a[k] : z[k]].tobytes().decode("ascii")
                        keep(form, value, int.from_bytes(hashlib.blake2b(value.encode(), digest_size=7).digest(), "big"), per_kind)
                h = mix(salt[doc] + (a - off[doc]).astype(np.uint64)) >> np.uint64(2)
                for k in np.argsort(h)[:ordinary].tolist():
                    keep("", raw[a[k] : z[k]].tobytes().decode("ascii"), int(h[k]), ordinary)
        rows = [(k, v, h) for k, own in kept.items() for h, v in sorted(own)[: per_kind if k else ordinary]]
        kinds, values, hashes = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string()), pa.array(hashes, pa.int64())], ["kind", "value", "h"])

    small_batches(docs.sparkSession)
    found = stage(docs.select(text).mapInArrow(run, "kind string, value string, h long"), "secret-values")
    out = {k: _least(found.where(F.col("kind") == k), per_kind) for k in (*(b[0] for b in BASE), *FORMS)}
    # one row for each occurrence that was drawn: a word drawn ten times counts ten times
    out[""] = sorted(r.value for r in found.where("kind = ''").groupBy("h").agg(F.min("value").alias("value")).orderBy("h").limit(ordinary).collect())
    discard(found)
    return out


def scan(docs: DataFrame, secret: Automaton | None, ordinary: Automaton | None, text: str = "text", least_total: float = LEAST_TOTAL, least_mean: float = LEAST_MEAN) -> DataFrame:
    """``docs`` with ``n_assign, n_access, n_hex long``, ``base_spans, spans string`` (``kind:start:end`` in code points)
    and ``format_score double`` (the best log ratio among the text's candidates; null without any).

    Null reads as the empty text: no spans. Repeated rows are scanned each; columns of these names are replaced; an
    empty table stays empty. Without automata (no labelled value in the corpus) nothing is added to the base.
    """
    names = ("n_assign", "n_access", "n_hex", "base_spans", "spans", "format_score")
    rest = docs.drop(*names)
    kinds = [b[0] for b in BASE] + [ADDED]
    small_batches(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {"key": np.zeros(0, np.uint64), "ratio": np.zeros(0)}

        def show(spans: list[tuple[int, int, int]]) -> str:
            return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)

        def ratios(raw: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
            """Log ratio of each run; each distinct one is scored once, and kept for the next slices."""
            p, ip = powers(len(raw) + 1)
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=total[1:])
            key, first, at = np.unique(mix((total[z] - total[a]) * ip[a] + (z - a).astype(np.uint64) * _Q), return_index=True, return_inverse=True)
            k = np.searchsorted(seen["key"], key)
            k[k == len(seen["key"])] = 0
            old = seen["key"][k] == key if len(seen["key"]) else np.zeros(len(key), bool)
            out = np.zeros(len(key))
            out[old] = seen["ratio"][k[old]]
            new = np.flatnonzero(~old)
            if len(new):
                own = a[first[new]], z[first[new]]
                out[new] = secret.scores(raw, *own) - ordinary.scores(raw, *own)
                if len(seen["key"]) + len(new) > _CACHE:
                    seen["key"], seen["ratio"] = np.zeros(0, np.uint64), np.zeros(0)
                keys, values = np.append(seen["key"], key[new]), np.append(seen["ratio"], out[new])
                order = np.argsort(keys)
                seen["key"], seen["ratio"] = keys[order], values[order]
            return out[at]

        for batch in it:
            counts: list[list[int]] = [[], [], []]
            base, spans, best = [], [], []
            for _, texts, raw, off in _slices(batch, text):
                own = [base_spans(t) if t else [] for t in texts]
                added: dict[int, list] = {}
                top = np.full(len(texts), np.nan)
                if secret and ordinary:
                    runs = Runs(raw, off)
                    a, z, doc = runs.without(own)
                    if len(a):
                        ratio = ratios(raw, a, z)
                        top = np.fmax(top, np.maximum.reduceat(ratio, np.searchsorted(doc, np.arange(len(texts))).clip(max=len(doc) - 1)))
                        top[np.bincount(doc, minlength=len(texts)) == 0] = np.nan
                        hit = np.flatnonzero((ratio >= least_total) & (ratio >= least_mean * (z - a)))
                        for d, x, y in zip(doc[hit].tolist(), runs.points(a[hit], doc[hit]).tolist(), runs.points(z[hit], doc[hit]).tolist(), strict=True):
                            added.setdefault(d, []).append((x, 3, y))
                for d, x in enumerate(own):
                    for k in range(3):
                        counts[k].append(sum(y[1] == k for y in x))
                    base.append(show(x))
                    spans.append(show(sorted(x + added[d])) if d in added else base[-1])
                best += [None if np.isnan(x) else x for x in top.tolist()]
            new = [*(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(spans, pa.string()), pa.array(best, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    schema = T.StructType(list(rest.schema.fields))
    for n in names:
        schema = schema.add(n, "long" if n[:2] == "n_" else "double" if n == "format_score" else "string")
    return rest.mapInArrow(run, schema)


def infer(found: dict[str, list[str]]) -> tuple[Automaton | None, Automaton | None]:
    """(automaton of the labelled credentials, automaton of ordinary text). The ordinary sample is judged by the automata
    until no more of it scores as a credential, three times at most."""
    good, plain, forms = [v for k, *_ in BASE for v in found[k]], found[""], [v for k in FORMS for v in found[k]]
    if not good or not plain:
        return None, None
    secret = Automaton(good)
    ordinary = Automaton(plain + forms)
    for _ in range(3):
        rest = [v for v in plain if (r := secret.score(v) - ordinary.score(v)) < LEAST_TOTAL / 2 or r < LEAST_MEAN * len(v)]
        if len(rest) == len(plain) or not rest:
            break
        plain, ordinary = rest, Automaton(rest + forms)
    return secret, ordinary


def fit(docs: DataFrame, text: str = "text", per_kind: int = PER_KIND, ordinary: int = ORDINARY) -> tuple[Automaton | None, Automaton | None]:
    """The automata of a corpus (see ``infer``); None twice where it has no labelled value or no other run."""
    return infer(labelled(docs, text, per_kind, ordinary))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, *fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans", "format_score")
