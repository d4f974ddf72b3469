"""Joins, aggregates and rankings of the retrieval engine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import vectors

QUERY_BLOCK = 4096
ROW_BLOCK = 1024
PAIR_BLOCK = 1 << 16


class Block:
    """Queries of one block as a matrix; scores batches of rows and keeps the best of each query."""

    def __init__(self, ids: list[int], rows: list[list[int]], k: int):
        self.ids, self.q, self.k = np.array(ids, np.int64), np.array(rows, np.int64).reshape(len(ids), -1), k

    def best(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        kept = (none, none, none)  # query, row, sum of rounded products
        least = np.full(len(self.ids), -np.inf)
        half = self.q.shape[1] / 2
        for batch in batches:
            for low in range(0, batch.num_rows, ROW_BLOCK):
                part = batch.slice(low, ROW_BLOCK)
                ids, lists = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                c = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if not len(c):
                    continue
                c = c.reshape(-1, self.q.shape[1])
                ids = ids[lists.is_valid().to_numpy(zero_copy_only=False)]
                about = c.astype(float) @ self.q.T.astype(float) / 32768  # off by half of each product's unit at most
                cut = least - half
                if len(c) > self.k:
                    cut = np.maximum(cut, np.partition(about, -self.k, axis=0)[-self.k] - 2 * half)
                i, j = np.nonzero(about >= cut[None, :])
                dots = np.concatenate([none, *(((c[i[a : a + PAIR_BLOCK]] * self.q[j[a : a + PAIR_BLOCK]] + 16384) >> 15).sum(1) for a in range(0, len(i), PAIR_BLOCK))])
                query, row, dot = (np.concatenate(x) for x in zip(kept, (j, ids[i], dots), strict=True))
                order = np.lexsort((row, -dot, query))
                query, row, dot = query[order], row[order], dot[order]
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                kept = tuple(x[rank < self.k] for x in (query, row, dot))
                last = rank == self.k - 1
                least[query[last]] = dot[last]
        yield pa.RecordBatch.from_arrays([pa.array(self.ids[kept[0].astype(np.int64)]), pa.array(kept[1].astype(np.int64)), pa.array(kept[2].astype(np.int64))], ["query_id", "vec_id", "dot"])


def top_k(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top-k by Q1.15 cosine: (query_id, vec_id, score, rank). corpus and queries have (vec_id, q).

    Queries go to all tasks in blocks of about `QUERY_BLOCK`, one block at a time in the driver, so what is
    broadcast is bounded. A task multiplies batches of rows with the block, scores exactly what can still be
    among the best, and sends k rows for each query. Rows without a vector are not scored; k below one gives
    no rows; the best come first, ties by vec_id.
    """
    shape = "query_id long, vec_id long, dot long"
    out = corpus.sparkSession.createDataFrame([], shape)
    rows = corpus.filter("q is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("q").cast("array<int>").alias("q"))
    for block in blocks_of(queries.filter("q is not null").select(F.col("vec_id").cast("long"), "q"), QUERY_BLOCK if k > 0 else 0):
        held = corpus.sparkSession.sparkContext.broadcast(Block([r[0] for r in block], [r[1] for r in block], k))
        out = out.unionByName(rows.mapInArrow(lambda it, h=held: h.value.best(it), shape))
    order = Window.partitionBy("query_id").orderBy(F.desc("dot"), "vec_id")
    best = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= max(k, 0))
    return best.select("query_id", "vec_id", vectors.recover_cos(F.col("dot")).alias("score"), "rank")


def blocks_of(rows: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of `size`, a partition at a time in the driver."""
    block: list = []
    for row in rows.toLocalIterator() if size > 0 else ():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def contained(items: DataFrame, loaded: DataFrame, item: str, part: str) -> DataFrame:
    """Relational division: the items all of whose parts are loaded."""
    known = items.join(loaded.select(part).distinct().withColumn("_ok", F.lit(True)), part, "left")
    return known.groupBy(item).agg(F.bool_and(F.coalesce("_ok", F.lit(False))).alias("_all")).filter("_all").select(item)


def merge_plan(incoming: DataFrame, local: DataFrame, key: str, value: str) -> DataFrame:
    """identical, added, updated or local-only for each key of either side."""
    a = incoming.select(key, F.col(value).alias("_in"), F.lit(True).alias("_a"))
    b = local.select(key, F.col(value).alias("_own"), F.lit(True).alias("_b"))
    action = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "local-only").when(F.col("_in").eqNullSafe(F.col("_own")), "identical").otherwise("updated")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def reciprocal_ranks(legs: list[DataFrame], key: str, score: str, per_leg: int = 200, base: int = 60, keep: int = 200) -> DataFrame:
    """Reciprocal rank fusion of ranked legs."""
    ranked = []
    for leg in legs:
        top = leg.orderBy(F.desc(score), key).limit(per_leg)  # a bounded report
        ranked.append(top.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(score), key))).select(key, (1 / (base + F.col("_r"))).alias("part")))
    every = ranked[0]
    for leg in ranked[1:]:
        every = every.unionByName(leg)
    fused = every.groupBy(key).agg(F.round(F.sum("part"), 12).alias("rrf"))
    return fused.orderBy(F.desc("rrf"), key).limit(keep)


def xor_hashes(rows: DataFrame, by: str, low: str) -> DataFrame:
    return rows.groupBy(by).agg(F.bit_xor(low).alias("xor"))


def best_per_group(rows: DataFrame, group: str, kind: str, key: str, score: str) -> DataFrame:
    """The best member of each group stands for it, with all kinds of the group."""
    order = F.struct(F.col(score), -F.col(key))
    return rows.groupBy(group).agg(F.max_by(key, order).alias(key), F.max(score).alias(score), F.array_sort(F.collect_set(kind)).alias("kinds"))


def runs(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Rows that differ from the one before them."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.filter(F.lit(True)).withColumn("_prev", F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1).filter(F.col("_first") | ~F.col(value).eqNullSafe(F.col("_prev"))).drop("_prev", "_first")


def islands(points: DataFrame, value: str, width: int = 65536) -> DataFrame:
    """Ranges of consecutive integers: (low, high).

    Blocks of `width` integers are cut on their own; ranges that end a block and begin the next one are joined
    by the run of their blocks, so only ranges at edges - two a block at most - meet in one window.
    """
    gap = F.col(value) - F.row_number().over(Window.partitionBy("_b").orderBy(value))
    part = points.filter(F.col(value).isNotNull()).select(value).distinct().withColumn("_b", F.floor(F.col(value) / width)).withColumn("_g", gap)
    cut = part.groupBy("_b", "_g").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    at_edge = (F.pmod("low", F.lit(width)) == 0) | (F.pmod("high", F.lit(width)) == width - 1)
    order = Window.orderBy("low")
    edge = cut.filter(at_edge).select("low", "high").withColumn("_first", F.coalesce(F.col("low") != F.lag("high").over(order) + 1, F.lit(True)))
    edge = edge.withColumn("_run", F.sum(F.col("_first").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cut.filter(~at_edge).select("low", "high").unionByName(edge.groupBy("_run").agg(F.min("low").alias("low"), F.max("high").alias("high")).select("low", "high"))
