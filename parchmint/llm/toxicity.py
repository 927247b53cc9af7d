"""Toxicity by class-conditional Kneser-Ney models.

Two interpolated Kneser-Ney models, one of toxic and one of ordinary labelled texts, predict each word from the one before
it, so expressions of several words count as such; what a pair of words leaves goes to the word alone, which is spelt
character by character (UTF-8 bytes, six at most, within the word and its borders), so inflected and compounded expressions
that the sample lacks are judged by the parts it has. The short orders, to which both classes back off, are counted over
both classes together: an expression rare in the sample weighs the same on either side. A text's evidence is its length-normalised
log-likelihood ratio (toxic over ordinary), over the whole text and over its most toxic words and window, calibrated by
a logistic curve on labelled texts that the counts haven't seen. Only the text is read.

The counts come from at most ``TOXIC`` and ``ORDINARY`` labelled texts (those with the smallest id hashes); all texts
are scored, whole, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.llm._arrow import _Q, PUNCT, Words, batches, mix, powers, signed, small_batches, words
from parchmint.llm._scratch import discard, stage

TOXIC, ORDINARY = 2000, 4000
ORDER, SHARED = 6, 2
WINDOW = 12
FEATURES = 6
_D = 0.75
_BEGIN, _END = 1, 2  # bytes that can't occur in a word
_CACHE = 1 << 18
_FIRST = np.uint64(0x243F6A8885A308D3)


class Spelling:
    """Positions of all bytes of words (and their ends), and hashes of what precedes them."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        size = end - start + 2
        self.first = np.concatenate(([0], np.cumsum(size)))
        raw = np.empty(self.first[-1], np.uint8)
        word = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(raw)) - self.first[word]
        inner = (at > 0) & (at < size[word] - 1)
        raw[at == 0], raw[at == size[word] - 1] = _BEGIN, _END
        raw[inner] = data[(start[word] + at - 1)[inner]]
        self.at = np.flatnonzero(at > 0)  # every byte but the border before a word is predicted
        self.word = word[self.at]
        self.begin = self.first[self.word]
        p, self._ip = powers(len(raw) + 1)
        self._total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[: len(raw)], out=self._total[1:])

    def grams(self, order: int, pick=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the n-grams of this order that end at the picked positions, hashes of their contexts)."""
        end = self.at[pick] + 1
        low = np.maximum(end - order, self.begin[pick])
        scale, salt = self._ip[low], (end - low).astype(np.uint64) << np.uint64(56)
        return mix((self._total[end] - self._total[low]) * scale ^ salt), mix((self._total[end - 1] - self._total[low]) * scale ^ salt)

    def whole(self, order: int) -> np.ndarray:
        """Whether the n-gram reaches back to the word's beginning, so that a longer one is the same."""
        return self.at + 1 - order <= self.begin


def _find(keys: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Index of each sought key, or -1."""
    if not len(keys):
        return np.full(len(sought), -1)
    k = np.searchsorted(keys, sought)
    k[k == len(keys)] = 0
    return np.where(keys[k] == sought, k, -1)


def _before(w: Words) -> np.ndarray:
    """Hash of the word before each; of a text's first word, a fixed value."""
    out = np.concatenate(([_FIRST], w.hash[:-1])) if len(w.hash) else w.hash
    out[w.first[:-1][w.counts > 0]] = _FIRST
    return out


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * _Q + word)


class Model:
    """Log ratios of the two classes by n-gram, and of what their contexts leave to shorter ones."""

    def __init__(self, spelling: Spelling, counts: np.ndarray):
        """``counts``: (toxic, ordinary) occurrences of each word."""
        n = counts[spelling.word]
        self.tables: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        below = None  # probabilities of the shorter n-gram at each position
        gram, context = spelling.grams(1)
        for k in range(1, ORDER + 1):
            following = spelling.grams(k + 1) if k < ORDER else (None, None)
            keys, first, at = np.unique(gram, return_index=True, return_inverse=True)
            if k == ORDER:
                own = np.stack([np.bincount(at, n[:, c], len(keys)) for c in (0, 1)], 1)
            else:
                # Kneser-Ney: once for each distinct longer n-gram; n-grams from a word's beginning by occurrence
                longer, one, back = np.unique(following[0], return_index=True, return_inverse=True)
                whole = spelling.whole(k)
                own = np.zeros((len(keys), 2))
                for c in (0, 1):
                    seen = np.bincount(back, n[:, c], len(longer)) > 0
                    inner = ~whole[one]
                    own[:, c] = np.bincount(at[one[inner]], seen[inner], len(keys)) + np.bincount(at, np.where(whole, n[:, c], 0), len(keys))
            if k <= SHARED:
                own = np.repeat(own.sum(1, keepdims=True), 2, 1)
            held, of = np.unique(context[first], return_inverse=True)
            total = np.stack([np.bincount(of, own[:, c], len(held)) for c in (0, 1)], 1)
            kinds = np.stack([np.bincount(of, own[:, c] > 0, len(held)) for c in (0, 1)], 1)
            left = np.where(total > 0, _D * kinds / np.maximum(total, 1), 1.0)
            shorter = np.full((len(keys), 2), 1 / 256) if below is None else below[first]
            prob = np.maximum(own - _D, 0) / np.maximum(total[of], 1) + left[of] * shorter
            ratio, rest = np.log(prob[:, 0] / prob[:, 1]).astype(np.float32), np.log(left[:, 0] / left[:, 1]).astype(np.float32)
            self.tables.append((keys, ratio, held[rest != 0], rest[rest != 0]))
            below = prob[at].astype(np.float32)
            gram, context = following
        # of each word of the sample: log probability by class, in all its characters and its end
        self.words = np.stack([np.bincount(spelling.word, np.log(below[:, c].astype(float)), len(counts)) for c in (0, 1)], 1)
        self.pairs = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        self.after = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        self.curve: np.ndarray | None = None

    def follow(self, before: np.ndarray, word: np.ndarray, hashes: np.ndarray, counts: np.ndarray) -> None:
        """Add the pairs of words: hash of the first, index of the second (of ``hashes``), (toxic, ordinary) counts."""
        held, of = np.unique(before, return_inverse=True)
        total = np.stack([np.bincount(of, counts[:, c], len(held)) for c in (0, 1)], 1)
        kinds = np.stack([np.bincount(of, counts[:, c] > 0, len(held)) for c in (0, 1)], 1)
        left = np.where(total > 0, _D * kinds / np.maximum(total, 1), 1.0)
        with np.errstate(divide="ignore"):
            own = np.log(np.maximum(counts - _D, 0) / np.maximum(total[of], 1))
        prob = np.logaddexp(own, np.log(left[of]) + self.words[word])
        key = _pair(before, hashes[word])
        order = np.argsort(key)
        self.pairs = key[order], (prob[:, 0] - prob[:, 1])[order].astype(np.float32)
        self.after = held, np.log(left[:, 0] / left[:, 1]).astype(np.float32)

    def spell(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log ratio of each word, in all its characters and its end."""
        s = Spelling(data, start, end)
        out = np.zeros(len(s.at))
        todo = np.arange(len(s.at))
        for k in range(ORDER, 0, -1):
            keys, ratio, held, left = self.tables[k - 1]
            gram, context = s.grams(k, todo)
            g = _find(keys, gram)
            known = g >= 0
            out[todo[known]] += ratio[g[known]]
            todo, c = todo[~known], _find(held, context[~known])
            out[todo[c >= 0]] += left[c[c >= 0]]
        return np.bincount(s.word, out, len(start))

    def ratios(self, w: Words, cache: dict) -> np.ndarray:
        """Each word's log ratio behind the one before it; ``cache`` keeps those of words by themselves (``_CACHE`` at most)."""
        distinct, first, at = np.unique(w.hash, return_index=True, return_inverse=True)
        keys, values = cache.get("keys", np.zeros(0, np.uint64)), cache.get("values", np.zeros(0))
        k = _find(keys, distinct)
        new = np.flatnonzero(k < 0)
        ratio = np.where(k >= 0, values[k] if len(values) else 0.0, 0.0)
        if len(new):
            ratio[new] = self.spell(w.data, w.start[first[new]], w.end[first[new]])
            if len(keys) + len(new) > _CACHE:
                keys, values = keys[:0], values[:0]
            keys, values = np.append(keys, distinct[new]), np.append(values, ratio[new])
            order = np.argsort(keys)
            cache["keys"], cache["values"] = keys[order], values[order]
        out, before = ratio[at], _before(w)
        held, left = self.after
        k = _find(held, before)
        out[k >= 0] += left[k[k >= 0]]
        keys, values = self.pairs
        k = _find(keys, _pair(before, w.hash))
        out[k >= 0] = values[k[k >= 0]]
        return out

    def features(self, w: Words, cache: dict) -> np.ndarray:
        """One row a document: mean ratio by character, by word, of the worst window and of the worst 1 and 4 words, log length."""
        n = w.counts
        out = np.zeros((len(n), FEATURES))
        if not len(w.hash):
            return out
        r = self.ratios(w, cache)
        total = np.concatenate(([0.0], np.cumsum(r)))
        chars = np.concatenate(([0], np.cumsum(w.end - w.start + 1)))
        whole = total[w.first[1:]] - total[w.first[:-1]]
        out[:, 0] = whole / np.maximum(chars[w.first[1:]] - chars[w.first[:-1]], 1)
        out[:, 1] = whole / np.maximum(n, 1)
        out[:, 2] = out[:, 1]
        doc, at = w.doc, np.arange(len(r))
        ok = at + WINDOW <= w.first[1:][doc]
        if ok.any():
            np.maximum.at(out[:, 2], doc[ok], (total[at[ok] + WINDOW] - total[at[ok]]) / WINDOW)
        order = np.lexsort((-r, doc))
        rank = at - w.first[:-1][doc]
        top = np.zeros((len(n), 4))
        first = rank < 4
        top[doc[first], rank[first]] = r[order[first]]
        out[:, 3], out[:, 4] = top[:, 0], top.mean(1)
        out[:, 5] = np.log1p(n)
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        x = np.concatenate([features, np.ones((len(features), 1))], 1) @ self.curve
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve by Newton's method on standardised columns; the last is the intercept."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    keep = np.full(len(w), ridge)
    keep[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    out = np.append(w[:-1] / scale, w[-1])
    out[-1] -= out[:-1] @ mean
    return out


def sample(labels: DataFrame, label: str, row_id: str, learn, most: dict[int, int]) -> DataFrame:
    """(row_id, y) of at most ``most[y]`` labelled rows of each class: those with the smallest id hashes. A row labelled
    more than once counts as the greater label; null labels and ids are left out."""
    own = labels.where(F.col(label).isNotNull() & F.col(row_id).isNotNull() & learn).groupBy(row_id).agg(F.max(label).cast("int").alias("y"))
    h = F.xxhash64(F.col(row_id), F.lit(3))
    parts = [own.where(F.col("y") == y).orderBy(h, row_id).limit(k) for y, k in most.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def fit(docs: DataFrame, labels: DataFrame, learn, row_id: str = "doc_id", text: str = "text", most: dict[int, int] | None = None) -> Model | None:
    """A model and its curve from labelled rows that ``learn`` (a condition on ``row_id``) allows; None without both
    classes, as for an empty table. A fifth of the sample, chosen by id, is for the curve and is not counted. Null texts
    hold no word; rows that share an id and a text count once; other columns, whatever their names, are left out."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = spark.createDataFrame(sample(labels, "toxic", row_id, learn, most or {1: TOXIC, 0: ORDINARY}).withColumnRenamed(row_id, "id").toArrow())
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").distinct()
    rows = rows.withColumn("tune", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 0)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["v", "h", "w", "t", "o"]
        for batch in it:
            y = batch.column(batch.schema.get_field_index("y")).to_numpy(zero_copy_only=False)
            for i, j, raw, off in batches(batch, "text"):
                w = words(raw, off, PUNCT)
                toxic = np.repeat(y[i:j] == 1, w.counts)
                both = lambda at, n: (pa.array(np.bincount(at, x, n).astype(np.int64)) for x in (toxic, ~toxic))  # noqa: B023, E731
                distinct, first, at = np.unique(w.hash, return_index=True, return_inverse=True)
                spelt = [bytes(w.data[a:z]) for a, z in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(distinct), pa.int64()), pa.array(signed(distinct)), pa.array(spelt, pa.binary()), *both(at, len(distinct))], names)
                before = _before(w)
                key, first, at = np.unique(_pair(before, w.hash), return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(before[first])), pa.array(signed(w.hash[first])), pa.nulls(len(key), pa.binary()), *both(at, len(key))], names)

    counted = rows.where("NOT tune").mapInArrow(count, "v long, h long, w binary, t long, o long").groupBy("v", "h", "w").agg(F.sum("t").cast("int").alias("t"), F.sum("o").cast("int").alias("o"))
    counted = stage(counted, "toxicity-counts")
    table = counted.where("v IS NULL").select("h", "w", "t", "o").orderBy("w").toArrow()
    n = np.stack([table["t"].to_numpy(), table["o"].to_numpy()], 1).astype(float)
    if not len(n) or not n.sum(0).all():
        return None
    spelt = table["w"].to_pylist()
    ends = np.cumsum([len(x) for x in spelt])
    model = Model(Spelling(np.frombuffer(b"".join(spelt), np.uint8), ends - [len(x) for x in spelt], ends), n)
    hashes = table["h"].to_numpy().view(np.uint64)
    table = counted.where("v IS NOT NULL").select("v", "h", "t", "o").orderBy("v", "h").toArrow()
    order = np.argsort(hashes)
    at = order[np.searchsorted(hashes[order], table["h"].to_numpy().view(np.uint64))]
    model.follow(table["v"].to_numpy().view(np.uint64), at, hashes, np.stack([table["t"].to_numpy(), table["o"].to_numpy()], 1).astype(float))
    discard(counted)

    def tune(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in it:
            x = [model.features(words(raw, off, PUNCT), cache) for _, _, raw, off in batches(batch, "text")]
            y = batch.column(batch.schema.get_field_index("y"))
            yield pa.RecordBatch.from_arrays([y, *(pa.array(np.concatenate([v[:, k] for v in x]) if x else [], pa.float64()) for k in range(FEATURES))], ["y", *names])

    names = [f"x{k}" for k in range(FEATURES)]
    held = rows.where("tune").mapInArrow(tune, ", ".join(["y int", *(f"{c} double" for c in names)])).orderBy("y", *names).toArrow()
    y = held["y"].to_numpy().astype(float)
    if len(set(y.tolist())) == 2:
        model.curve = logistic(np.stack([held[c].to_numpy() for c in names], 1), y)
    else:
        model.curve = np.array([0.0] * 3 + [0.5, 0.5, 0.0, -4.0])
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or the named columns of it) with ``score double`` (0 to 1) and ``predicted int``; both replace columns of these names.

    Null reads as the empty text, which gets the curve's value at no evidence. Equal texts get equal scores. Without a
    model (no labels of both classes) every score is 0.
    """
    rest = docs.drop("score", "predicted")
    small_batches(docs.sparkSession)
    columns = rest.columns if columns is None else columns

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in it:
            s = np.zeros(batch.num_rows)
            if model is not None:
                for i, j, raw, off in batches(batch, text):
                    s[i:j] = model.score(model.features(words(raw, off, PUNCT), cache))
            own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*own, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*columns, "score", "predicted"])

    return rest.mapInArrow(run, T.StructType([*rest.select(*columns).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def held_out(row_id: str = "doc_id", modulus: int = 5, remainder: int = 0):
    return F.pmod(F.crc32(F.col(row_id).cast("string").cast("binary")), F.lit(modulus)) == remainder


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels, ~held_out())
    return score(docs, model, columns=["doc_id"]).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
