"""Language-model scores by subword lattice likelihood.

A word's lattice has an edge for every vocabulary piece that spells part of it, weighted by the vocabulary's own unigram
score, and single bytes where no piece fits. A log-space forward recursion sums all segmentations (words of more than
``RUN`` bytes are spelt in runs of as many, so that a text without a space costs no more than others).

The training corpus adds longer edges to the lattice. One spans a word: the words' counts with absolute discounting, whose
discounted mass weighs the subword paths. One spans a segment, a run of about ``SEGMENT`` words that ends where the hash of
two neighbouring words says so: the segments' counts in the same way, whose discounted mass weighs the paths by words. A
segment's end depends on its own words only, so segments are a prefix code and the probabilities of all texts add up to
one at most. A text's ``score`` is the marginal probability over all paths through all its segments and its end.

* ``others_score``: as ``score``, but a training row's own segments aren't counted for it: what the *other* rows say. It
  sets texts that the corpus holds more than once apart from those that it holds once.
* ``lattice_score`` has no counts: subword paths only. ``base_score`` is the add-one unigram model of the words.

Pieces keep the vocabulary's probabilities; what is learnt are the words' and segments' counts, over all training rows.
Vocabularies are existing files and never trained. A unigram model's scores are log probabilities and are used as they
are. A BPE model's scores are merge ranks; they become log probabilities by Zipf's law, ``1 / (rank + 2.7)`` normalised.

Scale: counts are reduced in packed hash ranges (``2**bits`` of them, so that each holds a few MB whatever the corpus); a
distinct training word is spelt once, where its counts are reduced. Every text is scored against the most frequent words
(at most ``FREQUENT``, broadcast) where it lies; what it has of other words and of segments travels, packed by hash range,
to the counts and returns as sums by segment. No table that grows with the corpus is broadcast or collected.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm._arrow import _Q, Words, batches, ddl, mix, powers, small_batches, words
from parchmint.llm._scratch import stage

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
FREQUENT = 1 << 19
#: Text bytes for one hash range, and bytes of text whose rare words travel together.
RANGE_BYTES, CHUNK_SLICES = 4 << 20, 16
#: Bytes of a word that are spelt together, and words of a segment, on average.
RUN, SEGMENT = 256, 16
_MARK = 1  # the byte that stands for a word's beginning
_CACHE = 1 << 18
_LOG10 = np.log(10.0)
_ONE = np.uint64(1)


def _spans(total: np.ndarray, ip: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    return mix((total[z] - total[a]) * ip[a] + (z - a).astype(np.uint64) * _Q)


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, ip = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
    return total, ip


class Lattice:
    """Pieces (bytes, ``_MARK`` for the word's beginning) and their natural log probabilities."""

    def __init__(self, pieces: Sequence[bytes], logp: np.ndarray):
        self.longest = max(map(len, pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        end = np.cumsum([len(x) for x in pieces])
        start = end - [len(x) for x in pieces]
        key = _spans(*_prefix(data), start, end)
        order = np.argsort(key)
        self.key, self.logp = key[order], np.asarray(logp, float)[order]
        self.seen = np.zeros(1 << 20, bool)  # most substrings are no piece; this says so at once
        self.seen[(self.key >> np.uint64(44)).astype(np.int64)] = True

    def score(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probability of each word ``data[start:end]``, over all its segmentations; words of more than ``RUN`` bytes
        are runs of as many, of which the first has the mark."""
        runs = np.maximum(1, -(-(end - start) // RUN))
        word = np.repeat(np.arange(len(start)), runs)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(runs) - runs, runs)
        a = start[word] + nth * RUN
        z = np.minimum(a + RUN, end[word])
        out = np.zeros(len(word))
        order = np.argsort(a - z, kind="stable")  # longest first
        i = 0
        while i < len(order):
            most = int(z[order[i]] - a[order[i]]) + 2
            j = min(len(order), i + max(1, (1 << 20) // most))
            some = order[i:j]
            out[some] = self._forward(data, a[some], z[some], nth[some] == 0)
            i = j
        return np.bincount(word, out, len(start))

    def _forward(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """Log probability of reaching the last byte of each run; runs come longest first."""
        size = end - start + 1  # with the mark
        first = np.concatenate(([0], np.cumsum(size)))
        raw = np.empty(first[-1], np.uint8)
        at = np.arange(len(raw)) - np.repeat(first[:-1], size)
        raw[at == 0] = _MARK
        raw[at > 0] = data[(np.repeat(start, size) + at - 1)[at > 0]]
        total, ip = _prefix(raw)
        first, longest = first[:-1], int(size[0])
        alpha = np.full((longest + 1, len(size)), -np.inf)
        # a run without the mark begins behind it
        alpha[0, marked], alpha[1, ~marked] = 0, 0
        live = len(size)
        for i in range(1, longest + 1):
            while size[live - 1] < i:
                live -= 1
            z = first[:live] + i
            for n in range(1, min(i, self.longest) + 1):
                h = _spans(total, ip, z - n, z)
                row = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
                if not len(row):
                    continue
                k = np.searchsorted(self.key, h[row])
                k[k == len(self.key)] = 0
                good = self.key[k] == h[row]
                row, k = row[good], k[good]
                alpha[i, row] = np.logaddexp(alpha[i, row], alpha[i - n, row] + self.logp[k])
        return alpha[size, np.arange(len(size))]


def vocabulary(path: str = VOCABULARY) -> Lattice:
    """The lattice of a sentencepiece model's pieces; its control and unknown pieces take no part."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, scores, single = [], [], {}
    for i in range(model.vocab_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            single[bytes([int(model.id_to_piece(i)[3:5], 16)])] = True
        else:
            pieces.append(model.id_to_piece(i).replace("▁", chr(_MARK)).encode())
            scores.append(model.get_score(i))
    score = np.array(scores)
    if (score == np.round(score)).all():
        score = -np.log(2.7 - score)
    # bytes that no piece spells cost ten more than the dearest piece
    known = set(pieces)
    lone = [bytes([b]) for b in range(256) if bytes([b]) not in known]
    logp = np.concatenate([score, np.full(len(lone), score.min() - 10)])
    top = logp.max()
    return Lattice(pieces + lone, logp - top - np.log(np.exp(logp - top).sum()))


def _find(keys: np.ndarray, sought: np.ndarray) -> np.ndarray:
    """Index of each sought key in sorted keys, or -1."""
    if not len(keys):
        return np.full(len(sought), -1)
    k = np.searchsorted(keys, sought)
    k[k == len(keys)] = 0
    return np.where(keys[k] == sought, k, -1)


def _ranges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first index of each hash range, and one past the last) in sorted keys."""
    edge = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
    return edge[:-1], edge[1:]


def segments(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of each segment, its document, index of its first word). Segments follow each other; a document's last one
    includes its end and may have no word. Keys of words are even, those of segments odd."""
    n, first = len(w.hash), w.first
    docs = len(first) - 1
    follower = np.append(w.hash[1:], np.uint64(0)) if n else w.hash
    cut = mix(w.hash * _Q + follower) % np.uint64(SEGMENT) == 0
    last = first[1:][w.counts > 0] - 1
    cut[last] = False  # a document's last word ends no segment: its end does
    # a segment ends behind every cut, and at each document's end, which stands behind its last word
    inner = np.flatnonzero(cut) + 1
    stop = np.sort(np.concatenate([inner * 2, first[1:] * 2 + 1]), kind="stable") // 2
    at_end = np.sort(np.concatenate([inner * 2, first[1:] * 2 + 1]), kind="stable") % 2 == 1
    doc = np.concatenate(([0], np.cumsum(at_end)[:-1])) if len(stop) else np.zeros(0, np.int64)
    begin = np.concatenate(([0], stop[:-1])) if docs else np.zeros(0, np.int64)
    p, ip = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((w.hash + _ONE) * p[:n], out=total[1:])
    size = (stop - begin).astype(np.uint64)
    key = mix((total[stop] - total[begin]) * ip[begin] + size * _Q + at_end.astype(np.uint64) * np.uint64(0x51ED270B7F4A7C15))
    return key | _ONE, doc, begin


def _word_keys(w: Words) -> np.ndarray:
    return w.hash & ~_ONE


class Corpus:
    """Counts of the training rows' words and segments, packed by hash range, and their totals."""

    def __init__(self, docs: DataFrame, train: str, text: str, lattice: Lattice):
        small_batches(docs.sparkSession)
        size, self.ends = docs.agg(F.sum(F.octet_length(text)), F.count(F.when(F.col(train), 1))).first()
        self.bits = bits = int(max(4, np.ceil(np.log2(max(size or 1, 1) / RANGE_BYTES + 1))))

        def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []  # keys, counts, lengths, log probabilities, spelling

            def flush() -> Iterator[pa.RecordBatch]:
                keys, n, length, lat, spelt = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                begin = np.cumsum(length) - length
                keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
                n = np.bincount(at, n, len(keys)).astype(np.int64)
                length, lat, begin = length[first], lat[first], begin[first]
                for k, (lo, hi) in enumerate(zip(*(x.tolist() for x in _ranges(keys, bits)), strict=True)):
                    if lo < hi:
                        own = length[lo:hi]
                        at = np.arange(own.sum()) + np.repeat(begin[lo:hi] - np.cumsum(own) + own, own)
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (keys[lo:hi], n[lo:hi], own.astype(np.uint16), lat[lo:hi], spelt[at]))], ["part", "keys", "counts", "length", "lattice", "spelt"])

            for batch in it:
                for _, _, raw, off in batches(batch, text):
                    w = words(raw, off)
                    keys, first, n = np.unique(_word_keys(w), return_index=True, return_counts=True)
                    a, z = w.start[first], w.end[first]
                    length = z - a
                    # a very long word is spelt here and doesn't travel
                    long, lat = np.flatnonzero(length > RUN), np.full(len(keys), np.nan)
                    lat[long] = lattice.score(w.data, a[long], z[long])
                    length[long] = 0
                    at = np.arange(length.sum()) + np.repeat(a - np.cumsum(length) + length, length)
                    held.append((keys, n, length, lat, w.data[at]))
                    keys, n = np.unique(segments(w)[0], return_counts=True)
                    held.append((keys, n, np.zeros(len(keys), np.int64), np.zeros(len(keys)), np.zeros(0, np.uint8)))
                    if sum(len(x[0]) for x in held) > 1 << 20:
                        yield from flush()
            if held:
                yield from flush()

        def total(table: pa.Table) -> pa.Table:
            columns = [np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("keys", np.uint64), ("counts", np.int64), ("length", np.uint16), ("lattice", np.float64), ("spelt", np.uint8))]
            keys, n, length, lat, data = columns
            length = length.astype(np.int64)
            begin = np.cumsum(length) - length
            keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
            n = np.bincount(at, n, len(keys)).astype(np.int64)
            lat = lat[first].copy()
            new = np.flatnonzero(np.isnan(lat))
            lat[new] = lattice.score(data, begin[first[new]], begin[first[new]] + length[first[new]])
            word = (keys & _ONE) == 0
            sums: list = []
            for own in (n[word], n[~word]):
                sums += [pa.array([len(own)]), pa.array([int(own.sum())]), pa.array([int((own == 1).sum())]), pa.array([int((own == 2).sum())])]
            # how many words occur at least 2**k times
            often = len(n[word]) - np.searchsorted(np.sort(n[word]), 1 << np.arange(48))
            return pa.table([table["part"][:1], pa.array([keys.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary()), pa.array([lat.tobytes()], pa.binary()), *sums, pa.array([often.tolist()])], names=["part", "keys", "counts", "lattice", *names, "often"])

        names = [f"{x}_{y}" for x in ("word", "segment") for y in ("types", "tokens", "once", "twice")]
        packed = docs.where(train).select(text).mapInArrow(count, "part int, keys binary, counts binary, length binary, lattice binary, spelt binary")
        self.table = stage(packed.groupBy("part").applyInArrow(total, f"part int, keys binary, counts binary, lattice binary, {', '.join(f'{x} long' for x in names)}, often array<long>"), "words")
        sums = self.table.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), *(F.sum(F.col("often")[k]).alias(f"o{k}") for k in range(48))).first()
        self.types = sums.word_types + (self.ends > 0)
        self.tokens = sums.word_tokens + self.ends
        self.discount = _discount(sums.word_once, sums.word_twice)
        self.segments, self.segment_types = sums.segment_tokens, sums.segment_types
        self.segment_discount = _discount(sums.segment_once, sums.segment_twice)
        least = next((1 << k for k in range(48) if (sums[f"o{k}"] or 0) <= FREQUENT), 1 << 48)

        def frequent(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                for row in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                    keys, n, lat = (np.frombuffer(x, t) for x, t in zip(row, (np.uint64, np.int64, np.float64), strict=True))
                    some = (n >= least) & ((keys & _ONE) == 0)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(n[some]), pa.array(lat[some])], ["key", "n", "lattice"])

        top = self.table.select("keys", "counts", "lattice").mapInArrow(frequent, "key long, n long, lattice double").toArrow()
        keys, n, lat = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy(), top["lattice"].to_numpy()
        order = np.argsort(keys)
        self.frequent = keys[order], n[order], lat[order]

    def formulas(self):
        """Log10 probabilities: (add-one of a word's count; model of a word's count and log lattice probability; model of
        a segment's count and log10 probability by its words)."""
        tokens, types, d = self.tokens, self.types, self.discount
        add = np.log10(tokens + types + 1)
        back = np.log(d * types / tokens) if tokens else 0.0
        log_n = np.log(tokens) if tokens else 0.0
        whole, kinds, e = self.segments, self.segment_types, self.segment_discount

        def base(c: np.ndarray) -> np.ndarray:
            return np.log10(c + 1) - add

        def word(c: np.ndarray, lattice: np.ndarray) -> np.ndarray:
            with np.errstate(divide="ignore"):
                own = np.log(np.maximum(c - d, 0)) - log_n
            return np.logaddexp(own, back + lattice) / _LOG10

        def segment(c: np.ndarray, by_words: np.ndarray) -> np.ndarray:
            if not whole:
                return by_words
            with np.errstate(divide="ignore"):
                own = np.log(np.maximum(c - e, 0)) - np.log(whole)
            return np.logaddexp(own, np.log(e * kinds / whole) + by_words * _LOG10) / _LOG10

        return base, word, segment


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def score(docs: DataFrame, held_out, lattice: Lattice, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each of ``docs``: ``row_id, held_out, n_tokens, n_known, train_tokens, base_score, score, others_score,
    lattice_score``; scores are log10 probabilities. Rows where ``held_out`` (a condition; null is false) holds are
    scored and not learnt from.

    Null reads as the empty text: one token, its end. Ids may be of any type; rows are scored each, whatever ids they
    share, and other columns, whatever their names, are left out. Without training rows the lattice alone scores. An empty
    table gives an empty table.
    """
    rows = docs.select(F.col(row_id).alias("id"), F.col(text).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held")).withColumn("train", ~F.col("held"))
    corpus = Corpus(rows, "train", "text", lattice)
    bits, (often, often_n, often_lat), (base, model, whole) = corpus.bits, corpus.frequent, corpus.formulas()
    ends, tokens = corpus.ends, corpus.tokens
    end_base = float(base(np.array([ends]))[0])
    # a text's end has no spelling: its edge is the corpus' count (without training rows it is certain)
    end_model = float(np.log10(ends / tokens)) if ends else 0.0
    kind, id_type = rows.limit(0).toArrow().schema.field("id").type, rows.schema["id"].dataType.simpleString()

    def local(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = np.zeros(0, np.uint64), np.zeros(0)

        def spelt(w: Words, key: np.ndarray, first: np.ndarray) -> np.ndarray:
            """Lattice log probabilities of words that the counts may lack."""
            nonlocal cache
            keys, values = cache
            k = _find(keys, key)
            out = np.where(k >= 0, values[k] if len(values) else 0.0, 0.0)
            new = np.flatnonzero(k < 0)
            if len(new):
                out[new] = lattice.score(w.data, w.start[first[new]], w.end[first[new]])
                if len(keys) + len(new) > _CACHE:
                    keys, values = keys[:0], values[:0]
                keys, values = np.append(keys, key[new]), np.append(values, out[new])
                order = np.argsort(keys)
                cache = keys[order], values[order]
            return out

        # by slice: ids, held, documents of segments, sums by segment; then what travels: hash, segment, count, lattice
        chunk: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            name = secrets.randbits(62)
            ids, held = (pa.concat_arrays([c[k] for c in chunk]) for k in (0, 1))
            doc = np.concatenate([c[2] + s for c, s in zip(chunk, np.cumsum([0] + [len(c[0]) for c in chunk[:-1]]), strict=True)])
            sums = np.concatenate([c[3] for c in chunk], 1)
            at = np.concatenate([c[5] + s for c, s in zip(chunk, np.cumsum([0] + [len(c[2]) for c in chunk[:-1]]), strict=True)])
            key, n, lat = (np.concatenate([c[k] for c in chunk]) for k in (4, 6, 7))
            chunk.clear()
            order = np.argsort(key, kind="stable")
            key, at, n, lat = key[order], at[order], n[order], lat[order]
            low, high = _ranges(key, bits)
            some = np.flatnonzero(high > low).tolist()
            blob = []
            for k in some:
                x = lat[low[k] : high[k]]
                # spellings travel for words that the counts may lack; a bit says which
                has = ~np.isnan(x)
                blob.append(b"".join([np.int64(len(x)).tobytes(), key[low[k] : high[k]].tobytes(), at[low[k] : high[k]].astype(np.uint32).tobytes(), n[low[k] : high[k]].astype(np.uint32).tobytes(), np.packbits(has).tobytes(), x[has].tobytes()]))
            one = pa.array([ids.to_pylist(), *[None] * len(some)], pa.list_(kind))
            two = pa.array([held.to_pylist(), *[None] * len(some)], pa.list_(pa.bool_()))
            own = np.int64(len(doc)).tobytes() + doc.astype(np.uint32).tobytes() + sums.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([None, *some], pa.int32()), pa.array([name] * (len(some) + 1), pa.int64()), one, two, pa.array([own, *blob], pa.binary())], ["part", "chunk", "ids", "held", "blob"])

        for batch in it:
            for i, j, raw, off in batches(batch, "text"):
                w, n = words(raw, off), j - i
                out = batch.column(2).slice(i, n).to_numpy(zero_copy_only=False).astype(bool)
                key, first, word = np.unique(_word_keys(w), return_index=True, return_inverse=True)
                k = _find(often, key)
                near = k >= 0
                c = np.where(near, often_n[k] if len(often) else 0, 0)
                lat = np.where(near, often_lat[k] if len(often) else 0.0, np.nan)
                # every word of a training row is in the counts; only those of other rows may have to be spelt here
                maybe = np.zeros(len(key), bool)
                maybe[word[out[w.doc]]] = True
                new = np.flatnonzero(maybe & ~near)
                lat[new] = spelt(w, key[new], first[new])
                own, doc, begin = segments(w)
                seg = np.repeat(np.arange(len(own)), np.diff(np.append(begin, len(w.hash))))
                last = np.append(doc[1:] != doc[:-1], True)
                sums = np.zeros((5, len(own)))  # tokens; known; base; by words; lattice
                sums[0] = np.bincount(seg, minlength=len(own)) + last
                sums[1] = np.bincount(seg, near[word], len(own)) + last * (ends > 0)
                sums[2] = np.bincount(seg, np.where(near, base(c), 0)[word], len(own)) + last * end_base
                sums[3] = np.bincount(seg, np.where(near, model(c, np.where(near, lat, 0)), 0)[word], len(own)) + last * end_model
                sums[4] = np.bincount(seg, np.where(near, lat, 0)[word], len(own)) / _LOG10 + last * end_model
                far = np.flatnonzero(~near[word])
                pair, count = np.unique(seg[far] * max(len(key), 1) + word[far], return_counts=True)
                of, which = pair // max(len(key), 1), pair % max(len(key), 1)
                chunk.append((batch.column(0).slice(i, n), batch.column(2).slice(i, n), doc, sums, np.append(key[which], own), np.append(of, np.arange(len(own))), np.append(count, _repeats(own, doc)), np.append(lat[which], np.full(len(own), np.nan))))
                if len(chunk) == CHUNK_SLICES:
                    yield from flush()
        if chunk:
            yield from flush()

    # chunk names are drawn once: what is read below is what was written
    written = stage(rows.select("id", "text", "held").mapInArrow(local, f"part int, chunk long, ids array<{id_type}>, held array<boolean>, blob binary"), "texts")
    asked = written.where("part IS NOT NULL").select("part", "chunk", "blob")
    known = corpus.table.select("part", F.lit(None).cast("long").alias("chunk"), F.concat("keys", "counts", "lattice").alias("blob"))

    def resolve(table: pa.Table) -> pa.Table:
        keys, counts, lats = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
        asks, chunks, out = [], [], []
        for name, blob in zip(table["chunk"].to_pylist(), table["blob"].to_pylist(), strict=True):
            if name is None:
                m = len(blob) // 24
                keys, counts, lats = np.frombuffer(blob, np.uint64, m), np.frombuffer(blob, np.int64, m, 8 * m), np.frombuffer(blob, np.float64, m, 16 * m)
            else:
                asks.append(blob)
                chunks.append(name)
        for blob in asks:
            m = int(np.frombuffer(blob, np.int64, 1)[0])
            key, at, n = np.frombuffer(blob, np.uint64, m, 8), np.frombuffer(blob, np.uint32, m, 8 + 8 * m), np.frombuffer(blob, np.uint32, m, 8 + 12 * m)
            has = np.unpackbits(np.frombuffer(blob, np.uint8, -(-m // 8), 8 + 16 * m), count=m).astype(bool)
            lat = np.zeros(m)
            lat[has] = np.frombuffer(blob, np.float64, int(has.sum()), 8 + 16 * m + -(-m // 8))
            k = _find(keys, key)
            c = np.where(k >= 0, counts[k], 0) if len(keys) else np.zeros(m, np.int64)
            if len(keys):
                lat = np.where((k >= 0) & ~has, lats[k], lat)
            word = (key & _ONE) == 0
            of, where = np.unique(at[word], return_inverse=True)
            c1, n1 = c[word], n[word]
            sums = [np.bincount(where, x, len(of)) for x in (n1 * (c1 > 0), n1 * base(c1), n1 * model(c1, lat[word]), n1 * lat[word] / _LOG10)]
            # segments: how often the corpus has them, and how often the text itself; most stand alone
            some = ~word & (c > n)
            other = ~word & (c > 0) & (c <= n)
            head = np.array([len(of), int(some.sum()), int(other.sum())], np.int64)
            out.append(b"".join([head.tobytes(), of.astype(np.uint32).tobytes(), sums[0].astype(np.uint32).tobytes(), *(x.tobytes() for x in sums[1:]), at[some].tobytes(), n[some].tobytes(), c[some].tobytes(), at[other].tobytes(), c[other].astype(np.uint32).tobytes()]))
        return pa.table([pa.array(chunks, pa.int64()), pa.array(out, pa.binary())], names=["chunk", "blob"])

    answered = asked.unionByName(known).groupBy("part").applyInArrow(resolve, "chunk long, blob binary")
    sent = written.where("part IS NULL").select("chunk", "ids", "held", "blob")
    joined = sent.unionByName(answered.select("chunk", F.lit(None).cast(f"array<{id_type}>").alias("ids"), F.lit(None).cast("array<boolean>").alias("held"), "blob"))

    def finish(table: pa.Table) -> pa.Table:
        rest = []
        ids = held = doc = sums = None
        for i, h, blob in zip(table["ids"], table["held"], table["blob"].to_pylist(), strict=True):
            if i.is_valid:
                ids, held = i.values, h.values
                m = int(np.frombuffer(blob, np.int64, 1)[0])
                doc = np.frombuffer(blob, np.uint32, m, 8).astype(np.int64)
                sums = np.frombuffer(blob[8 + 4 * m :]).reshape(5, m).copy()
            else:
                rest.append(blob)
        count, own = np.zeros((2, sums.shape[1]))
        for blob in sorted(rest):
            m, p, q = np.frombuffer(blob, np.int64, 3).tolist()
            of = np.frombuffer(blob, np.uint32, m, 24)
            sums[1, of] += np.frombuffer(blob, np.uint32, m, 24 + 4 * m)
            for k in range(3):
                sums[2 + k, of] += np.frombuffer(blob[24 + 8 * m + 8 * m * k : 24 + 16 * m + 8 * m * k])
            rest_ = blob[24 + 32 * m :]
            at = np.frombuffer(rest_, np.uint32, p)
            own[at] = np.frombuffer(rest_, np.uint32, p, 4 * p)
            count[at] = np.frombuffer(rest_[8 * p :], np.int64, p)
            rest_ = rest_[16 * p :]
            at = np.frombuffer(rest_, np.uint32, q)
            count[at] = own[at] = np.frombuffer(rest_, np.uint32, q, 4 * q)
        n = len(ids)
        out = held.to_numpy(zero_copy_only=False).astype(bool)
        others = np.where(out[doc], count, count - own)
        total = lambda x: np.bincount(doc, x, n)
        longs = [pa.array(total(sums[0]).astype(np.int64)), pa.array(np.rint(total(sums[1])).astype(np.int64)), pa.array(np.full(n, tokens, np.int64))]
        doubles = [pa.array(total(x)) for x in (sums[2], whole(count, sums[3]), whole(others, sums[3]), sums[4])]
        return pa.table([ids, held, *longs, *doubles], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "others_score", "lattice_score"])

    scored = joined.groupBy("chunk").applyInArrow(finish, f"{ddl(rows, 'id')}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, others_score double, lattice_score double")
    return scored.withColumnRenamed("id", row_id)


def _repeats(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How often each segment's document holds it."""
    order = np.lexsort((key, doc))
    new = np.ones(len(key), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(key), np.int64)
    out[order] = np.bincount(group)[group] if len(key) else 0
    return out


def op4_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return score(docs, held, vocabulary())
