"""Embedding and rerank providers, the cache before them, and search that embeds what it misses.

A provider turns texts into vectors; it is known by name and called on Arrow batches in the tasks. The
one that comes along hashes words, so it needs no network and gives the same vectors everywhere.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import records, vectors

from . import relational

Provider = Callable[[Sequence[str]], np.ndarray]
Reranker = Callable[[str, Sequence[str]], Sequence[float]]
PROVIDERS: dict[str, Provider] = {}
RERANKERS: dict[str, Reranker] = {}
CHUNK = 256
TRIES = 10


def register(name: str, registry: dict = PROVIDERS) -> Callable:
    def add(f: Callable) -> Callable:
        registry[name] = f
        return f

    return add


@register("words")
def hashed_words(texts: Sequence[str], dimension: int = 64) -> np.ndarray:
    """Unit vectors of signed word counts."""
    out = np.zeros((len(texts), dimension), np.float32)
    for row, text in enumerate(texts):
        for word in re.findall(r"\w+", text.lower()):
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[row, h % dimension] += 1 if h >> 63 else -1
    n = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, n, out=out, where=n != 0)


@register("overlap", RERANKERS)
def overlap(query: str, texts: Sequence[str]) -> list[float]:
    """Share of the query's words."""
    wanted = set(query.lower().split())
    return [len(wanted & set(t.lower().split())) / max(1, len(wanted)) for t in texts]


def called(provider: Provider, texts: Sequence[str], wait: float = 0.0) -> np.ndarray:
    """With `TRIES` tries, each after twice the wait of the one before."""
    for n in range(TRIES):
        try:
            return np.asarray(provider(texts), np.float32)
        except (OSError, TimeoutError):
            if n == TRIES - 1:
                raise
            time.sleep(wait * 2**n)
    raise AssertionError


def embed(rows: DataFrame, text: str, provider: str) -> DataFrame:
    """All columns and `q`, the quantised vector; null for null texts. Texts go to the provider in chunks of `CHUNK`."""
    f, at = PROVIDERS[provider], rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK):
                part = batch.slice(low, CHUNK)
                texts = part.column(at).to_pylist()
                found = iter(called(f, [t for t in texts if t is not None]).tolist()) if any(t is not None for t in texts) else iter(())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([None if t is None else next(found) for t in texts], pa.list_(pa.float32()))], [*part.schema.names, "_v"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _v array<float>"
    return rows.mapInArrow(run, shape).withColumn("q", vectors.encode_q15(F.col("_v"))).drop("_v")


def embed_cached(rows: DataFrame, text: str, provider: str, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All columns and `q`, and the new cache rows (digest, q): each distinct text that the cache lacks is embedded once."""
    keyed = rows.withColumn("_d", F.sha2(text, 256))
    missing = keyed.filter(F.col(text).isNotNull()).select("_d", text).dropDuplicates(["_d"]).join(cache.select(F.col("digest").alias("_d")), "_d", "left_anti")
    new = embed(missing, text, provider).select(F.col("_d").alias("digest"), "q")
    known = cache.select(F.col("digest").alias("_d"), "q").unionByName(new.withColumnRenamed("digest", "_d"))
    return keyed.join(known, "_d", "left").drop("_d"), new


def complete(documents: DataFrame, vector_rows: DataFrame, key: str, text: str, provider: str) -> tuple[DataFrame, DataFrame]:
    """New vectors for keys without one, and one row of counts: missing, without a text, embedded."""
    missing = documents.select(key, text).dropDuplicates([key]).join(vector_rows.select(key), key, "left_anti")
    new = embed(missing.filter(F.col(text).isNotNull()), text, provider).select(key, "q")
    return new, missing.agg(F.count("*").alias("missing"), F.count_if(F.col(text).isNull()).alias("unrenderable"), F.count(text).alias("embedded"))


def search(documents: DataFrame, vector_rows: DataFrame, queries: DataFrame, key: str, text: str, provider: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The best k documents of each query (query_id, text), and the vectors that had to be made first."""
    new, _ = complete(documents, vector_rows, key, text, provider)
    every = documents.select(key).distinct().join(vector_rows.select(key, "q").unionByName(new), key).select(F.col(key).alias("vec_id"), "q")
    asked = embed(queries.select("query_id", "text"), "text", provider).select(F.col("query_id").alias("vec_id"), "q")
    return relational.top_k(every, asked, k).withColumnRenamed("vec_id", key), new


def two_tracks(entities: DataFrame, experiences: DataFrame, hit: Column, n_patterns: Column, k: int) -> DataFrame:
    """(key, score) of both tracks in one ranking; entities hit every pattern."""
    both = entities.withColumn("score", records.boosted(F.col("score"), F.lit(1.0), n_patterns)).unionByName(experiences.withColumn("score", records.boosted(F.col("score"), hit, n_patterns)).select(*entities.columns))
    return both.orderBy(F.desc("score"), both.columns[0]).limit(k)


def rerank(hits: DataFrame, texts: DataFrame, queries: DataFrame, key: str, reranker: str, k: int) -> DataFrame:
    """(query_id, key, rank) of four times as many hits as wanted: those with a text by the reranker, then the others as they were.

    A task holds one query's 4 k texts at most.
    """
    f = RERANKERS[reranker]
    rows = hits.filter(F.col("rank") <= 4 * k).join(texts.select(key, "text"), key, "left").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    gathered = rows.groupBy("query_id", "query").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).cast("long").alias("key"), F.when(F.trim("text") != "", F.col("text")).alias("text")))).alias("hits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                full = [h for h in row["hits"] if h["text"] is not None]
                scores = f(row["query"], [h["text"] for h in full])
                order = [h for _, h in sorted(zip(scores, full, strict=True), key=lambda x: (-x[0], x[1]["rank"]))] + [h for h in row["hits"] if h["text"] is None]
                n = min(k, len(order))
                yield pa.RecordBatch.from_arrays([pa.array([row["query_id"]] * n, pa.int64()), pa.array([h["key"] for h in order[:n]], pa.int64()), pa.array(range(1, n + 1), pa.int32())], ["query_id", key, "rank"])

    return gathered.select(F.col("query_id").cast("long").alias("query_id"), "query", "hits").mapInArrow(run, f"query_id long, {key} long, rank int")


def first_of_name(rows: DataFrame, name: str, order: Sequence[Column], k: int) -> DataFrame:
    """One row for each name, the first in order; the first k of them."""
    one = rows.withColumn("_r", F.row_number().over(Window.partitionBy(name).orderBy(*order))).filter("_r = 1").drop("_r")
    return one.orderBy(*order).limit(k)
