"""Functions for users of SQL: ``register_functions(spark)`` adds them to a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.functions import text as tx
from parchmint.functions.text import normal_form
from parchmint.operators import fuzzy, search
from parchmint.operators.search import pack_chunks


class Embedder(Protocol):
    """Texts to vectors of one length."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def hashing_embedder(size: int = 384) -> Embedder:
    """Unit vectors of signed hashed words and neighbouring words: deterministic, without a model; a model goes in its place."""
    import zlib

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size))
        for k, t in enumerate(texts):
            w = (t or "").lower().split()
            for x in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]:
                h = zlib.crc32(x.encode())
                out[k, h % size] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return embed


def embeddings(rows: DataFrame, text: str, embed: Embedder, to: str = "embedding") -> DataFrame:
    """``rows`` with the vectors of a text column, batch by batch on the executors; null reads as the empty text."""
    own = rows.drop(to)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(**{to: list(embed([t or "" for t in pdf[text]]).astype(np.float32))})

    return own.mapInPandas(run, T.StructType([*own.schema.fields, T.StructField(to, T.ArrayType(T.FloatType()))]))


def rebuild(rows: DataFrame, text: str, vector: str, embed: Embedder) -> DataFrame:
    """``rows`` with vectors everywhere: stored ones stay, and only rows without one go through the embedder."""
    kept, lost = rows.where(F.col(vector).isNotNull()), rows.where(F.col(vector).isNull())
    made = embeddings(lost.drop(vector), text, embed, vector)
    return kept.withColumn(vector, F.col(vector).cast("array<float>")).unionByName(made)


def semantic_pages(pages: DataFrame, key: str, number: str, text: str, embed: Embedder, tokens: int = 512, least: float = 0.5) -> DataFrame:
    """``semantic_chunks`` of each page by itself: ``key, page`` and the chunks, with offsets in the stripped page."""
    own = pages.select(F.struct(F.col(key).alias("k"), F.col(number).alias("p")).alias("__id"), F.col(text).alias("__t"))
    found = semantic_chunks(own.select(F.to_json("__id", {"ignoreNullFields": "false"}).alias("id"), "__t"), "id", "__t", embed, tokens, least)
    kind = own.schema["__id"].dataType
    return found.withColumn("id", F.from_json("id", kind)).select(F.col("id.k").alias(key), F.col("id.p").alias("page"), "chunk_index", "char_start", "char_end", "text")


def semantic_chunks(rows: DataFrame, row_id: str, text: str, embed: Embedder, tokens: int = 512, least: float = 0.5) -> DataFrame:
    """``row_id, chunk_index, char_start, char_end, text``: sentences stay together while neighbours' vectors have a cosine of
    ``least`` and more and the chunk has ``tokens`` words at most. Offsets are those in the stripped text."""
    own = rows.select(row_id, F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\r\f\u000b")).alias("t")).select(row_id, "t", tx.sentences(F.col("t")).alias("s"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for k, t, s in zip(pdf[row_id], pdf["t"], pdf["s"], strict=True):
                s = list(s)
                if not s:
                    continue
                v = embed(s)
                places, at = [], 0
                for x in s:
                    at = t.index(x, at)
                    places.append((at, at + len(x)))
                    at += len(x)
                begin, size, n = 0, len(s[0].split()), 0
                for i in range(1, len(s) + 1):
                    more = len(s[i].split()) if i < len(s) else 0
                    if i < len(s) and float(v[i] @ v[i - 1]) >= least and size + more <= tokens:
                        size += more
                        continue
                    a, z = places[begin][0], places[i - 1][1]
                    out.append((k, n, a, z, t[a:z]))
                    begin, size, n = i, more, n + 1
            yield pd.DataFrame(out, columns=[row_id, "chunk_index", "char_start", "char_end", "text"])

    return own.mapInPandas(run, f"`{row_id}` {rows.schema[row_id].dataType.simpleString()}, chunk_index int, char_start int, char_end int, text string")


class _Chunks:
    """UDTF: ``SELECT * FROM chunk_text(sentences, size, overlap)``."""

    def eval(self, sentences: list, size: int, overlap: int):  # noqa: A003
        for i, c in enumerate(pack_chunks(list(sentences or []), size, overlap)):
            yield i, c


def register_functions(spark: SparkSession, embed: Embedder | None = None) -> list[str]:
    """Add ``txt_normalize``, ``token_set_ratio``, ``token_proximity``, ``chunk_text`` (a table function) and, with an
    embedder, ``embed`` to the session; their names. ``strip_markup`` and other chains of built-in functions are Columns."""

    @F.pandas_udf(T.StringType())
    def normalize(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None else normal_form(x))

    functions: dict[str, Callable] = {"txt_normalize": normalize, "token_set_ratio": fuzzy.set_ratio, "token_proximity": search.token_proximity}
    if embed is not None:

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def vectors(t: pd.Series) -> pd.Series:
            return pd.Series(list(embed([x or "" for x in t]).astype(np.float32)))

        functions["embed"] = vectors
    for name, f in functions.items():
        spark.udf.register(name, f)
    spark.udtf.register("chunk_text", F.udtf(_Chunks, returnType="chunk_index: int, text: string"))
    return [*functions, "chunk_text"]
