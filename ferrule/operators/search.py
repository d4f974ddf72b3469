"""The word leg of hybrid search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import SEP

K1, B = 1.2, 0.75
WORDS = 2_000_000  # of a task


def said(words: str | Column) -> Column:
    """How many words there are; empty ones are none."""
    return F.size(F.filter(words, lambda w: w != ""))


def totals(docs: DataFrame) -> tuple[int, float, bool]:
    """Of (doc, words): documents with a word, their mean length, and whether a document has several rows."""
    sizes = docs.select("doc", said("words").alias("size")).groupBy("doc").agg(F.sum("size").alias("size"), F.count_if(F.col("size") > 0).alias("rows"))
    n = sizes.filter("rows > 0").agg(F.count("*").alias("docs"), F.avg("size").alias("mean"), F.max("rows").alias("rows")).first()
    return n["docs"], n["mean"] or 1.0, (n["rows"] or 0) > 1


def dealt(docs: DataFrame, by: Column, repeated: bool, words: float) -> DataFrame:
    """(part, doc, words, size): a row for each document, dealt by `by`, so that what is grouped by it needs no other shuffle.
    `words` in all are dealt to tasks of about `WORDS`, where a task for each core would hold more; else Spark chooses.

    A null doc is one document, which counts but is never found. Words travel as one text; those of a row in which a word
    holds the separator stay an array. Texts go as they are: a filter on their words would cut them up once more, as would one
    that Spark derives from `explode`, which is why callers take `explode_outer`.
    """
    held = F.array_join("words", "", "").contains(SEP)
    n = math.ceil(words / WORDS)
    tasks = [n] if n > docs.sparkSession.sparkContext.defaultParallelism else []
    sent = docs.select(by.alias("part"), "doc", F.when(~held, F.array_join("words", SEP, "")).alias("text"), F.when(held, F.col("words")).alias("list")).repartition(*tasks, "part")
    out = sent.select("part", "doc", F.coalesce("list", F.split("text", SEP)).alias("words"))
    if repeated:
        out = out.groupBy("part", "doc").agg(F.flatten(F.collect_list("words")).alias("words"))
    return out.select("part", "doc", "words", said("words").alias("size"))


def impact(mean: float) -> Column:
    """A posting's part of the score without the word's weight."""
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / mean))


def weight(docs: int) -> Column:
    return F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, doc: str, query: str, k: int) -> DataFrame:
    """(doc, words) against (query, words): the best k of each query by BM25, ties by document.

    Texts are shuffled once, by document; counts, scores and each task's best follow where they are, of words that are asked for.
    """
    docs = docs.select(F.col(doc).alias("doc"), "words")
    n, mean, repeated = totals(docs)
    asked = queries.select(query, F.explode(F.array_distinct("words")).alias("w")).filter("w <> ''").distinct()
    each = dealt(docs, F.col("doc"), repeated, n * mean).select("part", "doc", "size", F.explode_outer("words").alias("w"))
    hits = each.join(asked.select("w").distinct(), "w", "left_semi").groupBy("part", "doc", "size", "w").agg(F.count("*").alias("tf"))
    heavy = asked.join(hits.groupBy("w").agg(F.count("*").alias("df")), "w").select(query, "w", weight(n).alias("weight"))
    scored = hits.filter("doc is not null").select("part", "doc", "w", impact(mean).alias("impact")).join(heavy, "w").groupBy(query, "part", "doc").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"))
    best = Window.partitionBy(query).orderBy(F.desc(F.round("score", 6)), "doc")
    return scored.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= k).select(F.col("doc").alias(doc), query, F.round("score", 4).alias("score"))
