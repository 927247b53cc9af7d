"""Quality by co-training two views of a page.

The content view sees hashed words and word shapes; the metadata view sees language, source, length and layout (lines,
word length, shares of capitals, digits, symbols and repeated words), never a word. Each is a logistic classifier. In
every round both views score the whole corpus, each gives the unlabelled texts of which it is surest a label, and the
other view learns from those; then both are fitted again. The surest are distinct texts found by a distributed top-k, so
a text counts once however many copies there are. At the end each view is calibrated on labelled texts that took no part,
and a second curve over both calibrated views scores every document.

Fitting uses at most ``LABELLED`` labelled texts (smallest id hashes) and all unlabelled ones; every pass covers every whole
text and shuffles candidates only (``SUREST`` of a class, a view and a task).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.llm._arrow import Words, batches, mix, small_batches, words
from parchmint.llm._scratch import stage
from parchmint.llm.toxicity import logistic

LABELLED = 4000
ROUNDS, SUREST, SURE = 3, 150, 1.5
#: Rows that score less are rejected.
LEAST = 0.5
#: Columns of the content view: words by hash, then word shapes, then repetition.
WORDS, SHAPES = (1 << 14) - 256, 255
CONTENT = WORDS + SHAPES + 1
META = 48
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#$%&*+/<=>@[\\]^_`{|}~!"]] = True


def _shape(raw: np.ndarray) -> np.ndarray:
    """Bytes by class, for word shapes: lower, upper, digit, symbol, other mark, non-ASCII."""
    out = np.full(256, 4, np.uint8)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 5
    out[_SYMBOL] = 3
    return out[raw]


def columns(raw: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content columns of each word: its hash, its shape (capitals and symbols up to two, last class, digits), and whether it
    repeats the word before it."""
    doc = w.doc
    kind = _shape(raw)
    # words() stands one separator behind each document
    z = w.end - doc
    # few bytes are of these classes, and all of them are within words
    ups, syms, digs = (np.bincount(np.searchsorted(z, np.flatnonzero(kind == k), "right"), minlength=len(z)) for k in (1, 3, 2))
    shape = (np.minimum(ups, 2) * 3 + np.minimum(syms, 2)) * 6 + (kind[z - 1] if len(z) else kind[:0])
    shape = shape * 2 + (digs > 0)
    repeat = np.zeros(len(doc), bool)
    repeat[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    return (w.hash % np.uint64(WORDS)).astype(np.int64), WORDS + shape, repeat


def sparse(raw: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, column, value) of the content view: shares of a document's words."""
    word, shape, repeat = columns(raw, w)
    doc = w.doc
    key, value = np.unique(np.concatenate([doc * CONTENT + word, doc * CONTENT + shape, doc[repeat] * CONTENT + CONTENT - 1]), return_counts=True)
    owner, column = key // CONTENT, key % CONTENT
    return owner, column, value / np.maximum(w.counts, 1)[owner]


def metadata(raw: np.ndarray, off: np.ndarray, w: Words, lang: list, source: list) -> np.ndarray:
    """Dense rows of the metadata view; nothing that names a word."""
    n = len(off) - 1
    size = np.diff(off)
    counts = np.maximum(w.counts, 1)
    rows = np.zeros((n, META))

    def per(mark: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(mark), off))

    lines = per(raw == 10) + 1
    b = np.maximum(size, 1)
    key = np.sort((w.doc.astype(np.uint64) << np.uint64(48)) | (w.hash >> np.uint64(16)))  # 4,096 documents at once
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    distinct = np.bincount((key[new] >> np.uint64(48)).astype(np.int64), minlength=n)
    rows[:, 0], rows[:, 1] = np.log1p(size), np.log1p(w.counts)
    rows[:, 2], rows[:, 3] = np.log1p(lines), np.log1p(size / lines)
    rows[:, 4], rows[:, 5], rows[:, 6] = 10 * per(_UPPER[raw]) / b, 10 * per(_DIGIT[raw]) / b, 10 * per(_SYMBOL[raw]) / b
    rows[:, 7], rows[:, 8] = 10 * per(raw == 46) / b, size / counts / 10
    rows[:, 9] = distinct / counts
    rows[:, 10] = rows[:, 9] * rows[:, 1]
    for names, low, wide in ((lang, 12, 12), (source, 24, 24)):
        slot = {x: low + int(mix(np.array([hash_name(x)], np.uint64))[0] % np.uint64(wide)) for x in set(names)}
        rows[np.arange(n), [slot[x] for x in names]] = 1
    return rows


def hash_name(x: str | None) -> int:
    out = 7
    for c in (x or "").encode():
        out = (out * 1099511628211 + c + 1) & 0xFFFFFFFFFFFFFFFF
    return out


@dataclass
class Curve:
    """A logistic classifier over standardised columns."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias


def learn(x: np.ndarray, y: np.ndarray, ridge: float = 2.0, rounds: int = 80) -> Curve:
    """Gradient descent with momentum on the mean logistic loss, classes weighted evenly."""
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-6] = 1e9  # a column without variation says nothing
    z = np.clip((x - mean) / scale, -8, 8)
    share = max(y.mean(), 1e-6)
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / max(1 - share, 1e-6)) / len(y)
    w, v, bias, vb = np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 0.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(z @ w + bias, -30, 30))) - y) * weight
        v = 0.9 * v - 0.3 * (z.T @ g + ridge / len(y) * w)
        vb = 0.9 * vb - 0.3 * g.sum()
        w, bias = w + v, bias + vb
    return Curve(mean, scale, w, bias)


@dataclass
class Sparse:
    """Rows of the content view."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int

    def take(self, rows: np.ndarray) -> Sparse:
        at = np.full(self.n, -1)
        at[rows] = np.arange(len(rows))
        keep = at[self.row] >= 0
        return Sparse(at[self.row[keep]], self.column[keep], self.value[keep], len(rows))

    def dot(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * weight[self.column], self.n)


def learn_sparse(x: Sparse, y: np.ndarray, ridge: float = 1e-4, rounds: int = 120) -> tuple[np.ndarray, float]:
    """(weights, intercept) by gradient descent with a step of its own for each column (AdaGrad), classes weighted
    evenly."""
    share = max(y.mean(), 1e-6)
    cost = np.where(y > 0.5, 0.5 / share, 0.5 / max(1 - share, 1e-6)) / len(y)
    w, seen, bias, seen_b = np.zeros(CONTENT), np.full(CONTENT, 1e-12), 0.0, 1e-12
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(x.dot(w) + bias, -30, 30))) - y) * cost
        step = np.bincount(x.column, x.value * g[x.row], CONTENT) + ridge / len(y) * w
        seen += step * step
        seen_b += g.sum() ** 2
        w -= 2.0 * step / np.sqrt(seen)
        bias -= 0.5 * g.sum() / np.sqrt(seen_b)
    return w, bias


@dataclass
class Views:
    """One classifier a view, before calibration."""

    content: np.ndarray
    bias: float
    meta: Curve

    def logits(self, raw: np.ndarray, off: np.ndarray, lang: list, source: list) -> np.ndarray:
        """(rows, 2) log odds by content and by metadata."""
        w = words(raw, off)
        word, shape, repeat = columns(raw, w)
        evidence = self.content[word] + self.content[shape] + repeat * self.content[-1]
        content = self.bias + np.bincount(w.doc, evidence, len(off) - 1) / np.maximum(w.counts, 1)
        return np.stack([content, self.meta.logit(metadata(raw, off, w, lang, source))], 1)


@dataclass
class Model:
    views: Views
    calibrate: np.ndarray  # (2 views x (slope, intercept))
    combine: np.ndarray  # two weights and an intercept

    def score(self, raw: np.ndarray, off: np.ndarray, lang: list, source: list) -> np.ndarray:
        """Three rows, probabilities of quality 1: combined, by content, by metadata."""
        own = np.clip(self.views.logits(raw, off, lang, source) * self.calibrate[:, 0] + self.calibrate[:, 1], -12, 12)
        return _sigmoid(np.stack([own @ self.combine[:2] + self.combine[2], own[:, 0], own[:, 1]]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Sample:
    """Texts to fit on: hash of each, its features, and what each view takes its label to be (-1: none)."""

    key: np.ndarray
    content: Sparse
    meta: np.ndarray
    label: np.ndarray  # (rows, 2 views)

    def add(self, other: Sample) -> Sample:
        c, d = self.content, other.content
        both = Sparse(np.append(c.row, d.row + c.n), np.append(c.column, d.column), np.append(c.value, d.value), c.n + d.n)
        return Sample(np.append(self.key, other.key), both, np.concatenate([self.meta, other.meta]), np.concatenate([self.label, other.label]))

    def fit(self) -> Views:
        own = [np.flatnonzero(self.label[:, v] >= 0) for v in (0, 1)]
        y = [self.label[k, v].astype(float) for v, k in enumerate(own)]
        return Views(*learn_sparse(self.content.take(own[0]), y[0]), learn(self.meta[own[1]], y[1]))


def _features(rows: DataFrame) -> tuple[np.ndarray, pa.Table, Sparse, np.ndarray]:
    """(text hashes, other columns, content and metadata features) of ``rows (h, text, lang, source, y, tune)``, by
    hash."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
            for i, j, raw, off in batches(batch, "text"):
                n = j - i
                w = words(raw, off)
                owner, column, value = sparse(raw, w)
                meta = metadata(raw, off, w, at["lang"].slice(i, n).to_pylist(), at["source"].slice(i, n).to_pylist())
                first = np.searchsorted(owner, np.arange(n + 1))
                content = [column[first[k] : first[k + 1]].astype(np.int16).tobytes() + value[first[k] : first[k + 1]].astype(np.float32).tobytes() for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [at["h"].slice(i, n), at["y"].slice(i, n), at["tune"].slice(i, n), pa.array(content, pa.binary()), pa.array([m.astype(np.float32).tobytes() for m in meta], pa.binary())],
                    ["h", "y", "tune", "content", "meta"],
                )

    table = rows.select("h", "text", "lang", "source", "y", "tune").mapInArrow(run, "h long, y int, tune boolean, content binary, meta binary").orderBy("h", "y", "content", "meta").toArrow()
    row, column, value = [], [], []
    for k, x in enumerate(table["content"].to_pylist()):
        m = len(x) // 6
        row.append(np.full(m, k))
        column.append(np.frombuffer(x, np.int16, m).astype(np.int64))
        value.append(np.frombuffer(x, np.float32, m, 2 * m).astype(float))
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    meta = np.stack([np.frombuffer(x, np.float32) for x in table["meta"].to_pylist()]).astype(float) if len(table) else np.zeros((0, META))
    return table["h"].to_numpy(), table, Sparse(cat(row, np.int64), cat(column, np.int64), cat(value, float), len(table)), meta


def _once(rows: DataFrame, *by: str) -> DataFrame:
    """Each text of ``rows`` once (for each value of ``by``), whatever the number of copies; of different languages or
    sources the least."""
    out = rows.groupBy("h", "text", *by).agg(F.min(F.struct("lang", "source")).alias("m"))
    return out.select("h", F.coalesce("text", F.lit("")).alias("text"), F.col("m.lang").alias("lang"), F.col("m.source").alias("source"), *by)


def surest(rows: DataFrame, views: Views, known: np.ndarray, counts: tuple[int, int]) -> DataFrame:
    """``view, label, h, logit``: the texts of ``rows`` of which each view is surest, ``counts[label]`` distinct ones of a
    label at most, without the texts whose hashes are in ``known`` (sorted). One pass; a task gives as many at most."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in it:
            at = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
            for i, j, raw, off in batches(batch, "text"):
                n = j - i
                h = at["h"].slice(i, n).to_numpy(zero_copy_only=False)
                logit = views.logits(raw, off, at["lang"].slice(i, n).to_pylist(), at["source"].slice(i, n).to_pylist())
                k = np.searchsorted(known, h)
                k[k == len(known)] = 0
                free = known[k] != h if len(known) else np.ones(n, bool)
                for view in (0, 1):
                    for label, sign in ((1, 1.0), (0, -1.0)):
                        some = np.flatnonzero(free & (sign * logit[:, view] > SURE))
                        keys, value = held.get((view, label), (h[:0], logit[:0, 0]))
                        held[view, label] = _top(np.append(keys, h[some]), np.append(value, sign * logit[some, view]), counts[label])
        for (view, label), (keys, value) in held.items():
            m = len(keys)
            yield pa.RecordBatch.from_arrays([pa.array([view] * m, pa.int32()), pa.array([label] * m, pa.int32()), pa.array(keys, pa.int64()), pa.array(value)], ["view", "label", "h", "sure"])

    found = rows.select("h", "text", "lang", "source").mapInArrow(run, "view int, label int, h long, sure double").groupBy("view", "label", "h").agg(F.max("sure").alias("sure"))
    found = stage(found, "quality-surest")  # one pass for all four lists
    parts = [found.where((F.col("view") == v) & (F.col("label") == y)).orderBy(F.desc("sure"), "h").limit(counts[y]) for v in (0, 1) for y in (0, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _top(keys: np.ndarray, value: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` distinct keys of greatest value."""
    order = np.lexsort((keys, -value))
    keys, value = keys[order], value[order]
    first = np.sort(np.unique(keys, return_index=True)[1])[:most]
    return keys[first], value[first]


def fit(docs: DataFrame, labels: DataFrame, learn_from=None, row_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", label: str = "quality") -> Model | None:
    """A model from labelled and unlabelled rows; None without both classes among the labelled ones, as for an empty table.

    Null labels and ids are left out; a row labelled twice counts as the greater label; null texts read as empty and null
    names as a name of their own. Ids may be of any type; columns of other names, whatever they are, are left out. A
    quarter of the labelled sample, chosen by id, calibrates."""
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.select(F.col(row_id).alias("id"), F.col(label).alias("l"), (F.lit(True) if learn_from is None else learn_from).alias("ok"))
    own = own.where("id IS NOT NULL AND l IS NOT NULL AND ok").groupBy("id").agg(F.max("l").cast("int").alias("y"))
    some = own.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(LABELLED).withColumn("tune", F.pmod(F.xxhash64("id", F.lit(17)), F.lit(4)) == 0)
    chosen = spark.createDataFrame(some.toArrow())
    if chosen.select("y").distinct().count() < 2:
        return None
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source")).withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    key, table, content, meta = _features(_once(rows.join(F.broadcast(chosen), "id"), "y", "tune"))  # LABELLED rows at most
    y, tune = table["y"].to_numpy(), table["tune"].to_numpy(zero_copy_only=False).astype(bool)
    if len(set(y[~tune].tolist())) < 2:
        return None
    sample = Sample(key, content, meta, np.repeat(np.where(tune, -1, y)[:, None], 2, 1))
    rate = y[~tune].mean()
    counts = (round(SUREST * (1 - rate)), round(SUREST * rate))
    for _ in range(ROUNDS):
        found = surest(rows, sample.fit(), np.unique(sample.key), counts).toArrow()
        if not len(found):
            break
        # what one view is sure of, the other learns; both may be sure of a text
        given: dict[int, list[int]] = {}
        for view, value, h in zip(*(found[c].to_pylist() for c in ("view", "label", "h")), strict=True):
            given.setdefault(h, [-1, -1])[1 - view] = value
        asked = spark.createDataFrame(pa.table({"h": pa.array(list(given), pa.int64())}))
        fresh = _once(rows.join(F.broadcast(asked), "h")).withColumns({"y": F.lit(-1), "tune": F.lit(False)})  # 4 * SUREST rows at most
        key, _, content, meta = _features(fresh)
        sample = sample.add(Sample(key, content, meta, np.array([given[h] for h in key.tolist()]).reshape(-1, 2)))
    views = sample.fit()
    held = np.flatnonzero(tune)
    n = len(tune)
    z = np.stack([sample.content.dot(views.content)[:n] + views.bias, views.meta.logit(sample.meta[:n])], 1)[held]
    target = y[held].astype(float)
    if len(set(target.tolist())) < 2:
        return Model(views, np.array([[1.0, 0.0], [1.0, 0.0]]), np.array([1.0, 0.0, 0.0]))
    calibrate = np.array([logistic(z[:, [k]], target, ridge=0.1) for k in (0, 1)])
    combine = logistic(np.clip(z * calibrate[:, 0] + calibrate[:, 1], -12, 12), target, ridge=0.1)
    return Model(views, calibrate, combine)


def score(docs: DataFrame, model: Model | None, text: str = "text", lang: str = "lang", source: str = "source", least: float = LEAST, prefix: str = "", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or the named columns of it) with ``quality_score, content_score, metadata_score double`` and ``keep boolean`` (score of ``least`` or
    more), each name after ``prefix``; these replace columns of the same names. Null texts read as empty, null names as the empty name; equal rows
    get equal scores. Without a model every row scores 1 and stays."""
    names = tuple(prefix + n for n in ("quality_score", "content_score", "metadata_score", "keep"))
    rest = docs.drop(*names)
    small_batches(docs.sparkSession)
    columns = rest.columns if columns is None else columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = np.ones((3, batch.num_rows))
            if model is not None:
                at = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
                for i, j, raw, off in batches(batch, text):
                    out[:, i:j] = model.score(raw, off, at[lang].slice(i, j - i).to_pylist(), at[source].slice(i, j - i).to_pylist())
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, out), pa.array(out[0] >= least)], [*columns, *names])

    kinds = [T.DoubleType()] * 3 + [T.BooleanType()]
    return rest.mapInArrow(run, T.StructType([*rest.select(*columns).schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))]))


def op8_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, columns=["doc_id"]).select("doc_id", "quality_score", "content_score", "metadata_score", "keep")
