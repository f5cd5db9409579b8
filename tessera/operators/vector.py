"""Exact vector retrieval in blocks of questions, and batched embedding."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small
from .lexical import ranked

BLOCK = 2_048


def top(base: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", query: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(q, chunk, distance, score, rank): k nearest by squared Euclidean distance; score 1 / (1 + d).

    Each task keeps the k nearest of its own rows per question, so that only
    k rows a task and question are shuffled.  Questions come in blocks of
    ``BLOCK``; a metadata filter is a ``where`` on ``base`` before.
    """
    spark = base.sparkSession
    queries, few = small(queries, BLOCK)
    blocks = 1 if few else -(-queries.count() // BLOCK)
    found = None
    for b in range(max(1, blocks)):
        some = queries if blocks <= 1 else queries.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b)
        rows = some.select(query, query_vector).where(F.col(query_vector).isNotNull()).collect()
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, q = shared.value
            best_d, best_k = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)
            for pdf in batches:
                good = pdf.v.map(lambda v: v is not None and len(v) == q.shape[1])
                pdf = pdf[good]
                for a in range(0, len(pdf), 1024):
                    x = np.array(pdf.v.iloc[a : a + 1024].tolist(), np.float64)
                    keys = pdf.k.iloc[a : a + 1024].to_numpy(np.int64)
                    d = (q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T)
                    near = np.argpartition(d, 2 * k + 7, axis=1)[:, : 2 * k + 8] if d.shape[1] > 2 * k + 8 else np.broadcast_to(np.arange(d.shape[1]), d.shape)
                    exact = ((x[near] - q[:, None, :]) ** 2).sum(2)
                    both_d, both_k = np.concatenate([best_d, exact], 1), np.concatenate([best_k, keys[near]], 1)
                    order = np.lexsort((both_k, both_d), axis=1)[:, :k]
                    best_d, best_k = np.take_along_axis(both_d, order, 1), np.take_along_axis(both_k, order, 1)
            if len(ids) and best_d.shape[1]:
                yield pd.DataFrame({"q": np.repeat(ids, best_d.shape[1]), "chunk": best_k.ravel(), "distance": best_d.ravel()})

        one = base.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInPandas(run, "q long, chunk long, distance double")
        found = one if found is None else found.unionByName(one)
    rows = found.select("q", "chunk", F.round("distance", 6).alias("distance"))
    return ranked(rows, F.col("distance"), k).withColumn("score", F.round(1 / (1 + F.col("distance")), 6))


class EmbeddingProvider(Protocol):
    size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """A deterministic local embedder: signed hashed words, unit length."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.size)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "replace"), digest_size=8).digest(), "little")
                v[h % self.size] += 1 if h >> 63 else -1
            n = float(np.sqrt((v * v).sum()))
            out.append((v / n if n else v).tolist())
        return out


class EmbeddingError(RuntimeError):
    pass


def with_retry(call: Callable[[list[str]], list[list[float]]], texts: list[str], retries: int = 3, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """At most ``retries`` + 1 calls: rate limits wait twice as long each time, key errors end at once."""
    for attempt in range(retries + 1):
        try:
            out = call(texts)
            if len(out) != len(texts):
                raise EmbeddingError(f"{len(out)} vectors for {len(texts)} texts")
            return out
        except Exception as e:
            said = str(e).lower()
            if any(x in said for x in ("api key", "api_key", "unauthorized", "authentication", "invalid key")) or attempt == retries:
                raise EmbeddingError(str(e)) from e
            sleep(delay * 2**attempt if any(x in said for x in ("rate limit", "rate_limit", "too many requests", "429")) else delay)
    raise AssertionError


def embed(chunks: DataFrame, provider: EmbeddingProvider, content: str = "content", out: str = "embedding", batch: int = 32) -> DataFrame:
    """Adds a vector per row; texts go to the provider in slices of ``batch``, null as ''."""
    schema = T.StructType([*chunks.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf[content].fillna("").astype(str).tolist()
            vectors = [v for a in range(0, len(texts), batch) for v in with_retry(provider.embed, texts[a : a + batch])]
            yield pdf.assign(**{out: vectors})

    return chunks.mapInPandas(run, schema)
