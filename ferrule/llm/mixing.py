"""Mixing sources to target weights: capped water-filling and seeded repetitions.

Sources are clamped at `max_epochs` times their size and what they leave is reshared by weight.
All clamped sources come first in the order of cap / weight, so running sums over the table of
sources (a row for each) give the level in closed form.

Whole repetitions take every document; the fractional one takes documents in the order of a
seeded hash until the rest of the target is used up. No task sorts a source: sums over 4096 hash
buckets find the bucket in which the target is reached, the same once more inside it, and only the
documents of that 2**-24 share of a source are put in order.

Defined cases: null text has size 0; null is a source of its own, last in order; rows with equal
doc_id stand next to each other in the order of size; a source without words has target 0; long texts are counted whole;
an empty table gives an empty result; other columns are kept by `mix` and never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import Workspace, read

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix"
SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def seeded(doc_id: Column, seed: str = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))))


def targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target): one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(by_name) - 1) % len(weights)
    wide = lambda c: c.cast("decimal(38,0)")
    s = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (at + 1).cast("int")))
    s = s.withColumn("cap", wide(F.col("source_size") * max_epochs))
    everything = Window.partitionBy(F.lit(0))
    fill = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("decimal(38,0)")
    s = s.withColumns({
        "total": wide(F.sum("source_size").over(everything)), "all_weight": wide(F.sum("weight").over(everything)),
        "cap_before": wide(F.coalesce(F.sum("cap").over(before), none)), "weight_before": wide(F.coalesce(F.sum("weight").over(before), none)),
    })
    s = s.withColumn("capped", F.col("cap") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("cap_before")))
    s = s.withColumns({"cap_sum": wide(F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), none)), "cap_weight": wide(F.coalesce(F.sum(F.when(F.col("capped"), F.col("weight"))).over(everything), none))})
    share = (F.col("weight") * (F.col("total") - F.col("cap_sum"))).cast("double") / (F.col("all_weight") - F.col("cap_weight")).cast("double")
    return s.select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def plan(slim: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """From (source, size, h): targets, whole repetitions, and the buckets in which the rest is reached."""
    goal = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", F.least(whole, F.lit(max_epochs).cast("long")))
    goal = goal.withColumn("left0", F.greatest(F.floor("target").cast("long") - F.col("whole") * F.col("source_size"), F.lit(0).cast("long")))
    rows = slim
    for level in (1, 2):
        near = goal.select(F.col("source").alias("_s"), *([F.col("cut1").alias("_cut1")] if level == 2 else []))
        if level == 2:
            rows = slim.join(near, slim["source"].eqNullSafe(near["_s"]) & (F.substring("h", 1, 3) == F.col("_cut1"))).drop("_s", "_cut1")
        sums = rows.groupBy("source", F.substring("h", 3 * level - 2, 3).alias("b")).agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.sum("n").over(run)).select(F.col("source").alias("_s"), "b", "n", "upto")
        hit = goal.join(sums, goal["source"].eqNullSafe(sums["_s"]) & (F.col("upto") - F.col("n") <= F.col(f"left{level - 1}")) & (F.col(f"left{level - 1}") < F.col("upto")), "left")
        goal = hit.select(*goal.columns, F.col("b").alias(f"cut{level}"), (F.col(f"left{level - 1}") - F.col("upto") + F.col("n")).alias(f"left{level}"))
    return goal


def assign(rows: DataFrame, goal: DataFrame, work: Workspace) -> DataFrame:
    """Adds whole (repetitions) and part (words of one more) to rows with source, size and h.

    A table of up to `SOURCES` sources goes to all tasks, as its size is counted. A longer one is joined by
    source and the result written, so that the join may be split and no window asks for a source as a whole.
    """
    g = work.save(goal.select(F.col("source").alias("_s"), "source_size", "target", "whole", "cut1", "cut2", "left2"), "goal")
    small = g.limit(SOURCES + 1).count() <= SOURCES
    joined = rows.join(F.broadcast(g) if small else g, rows["source"].eqNullSafe(g["_s"])).drop("_s")
    joined = joined if small else work.save(joined, "joined")
    cut, six = F.concat("cut1", "cut2"), F.substring("h", 1, 6)
    none = F.lit(0).cast("long")
    clear = joined.filter(cut.isNull() | (six != cut)).withColumn("part", F.when(cut.isNotNull() & (six < cut), F.col("size")).otherwise(none))
    order = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.filter(six == cut)
    edge = edge.withColumn("part", F.least(F.col("size"), F.greatest(none, F.col("left2") - F.coalesce(F.sum("size").over(order), none))))
    return clear.unionByName(edge).drop("cut1", "cut2", "left2")


def slim_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), seeded(F.col("doc_id")).alias("h"))


def mixed_sizes(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """Per document: what the mix takes of it in words."""
    work = Workspace(docs.sparkSession, "mix")
    slim = work.save(slim_rows(docs), "slim")
    out = assign(slim, plan(slim, weights, max_epochs), work)
    return out.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """The documents as often as the mix takes them; the document at the edge whole, or not, as is nearer."""
    work = Workspace(docs.sparkSession, "mix")
    slim = work.save(slim_rows(docs), "slim")
    kept = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row"))
    rows = kept.select("_row", F.col("_row.doc_id").alias("doc_id"), F.col("_row.source").alias("source"), word_count(F.col("_row.text")).alias("size"), seeded(F.col("_row.doc_id")).alias("h"))
    out = assign(rows, plan(slim, weights, max_epochs), work)
    extra = F.when(F.col("size") > 0, (2 * F.col("part") >= F.col("size")).cast("int")).otherwise(0)
    copies = F.col("whole").cast("int") + extra
    return out.filter(copies > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), copies))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS ss FROM d GROUP BY source),
w AS (SELECT source, ss, 3 * ss AS cap, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
f AS (SELECT *, sum(ss) OVER () AS t, sum(w) OVER () AS aw,
             coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
             coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb FROM w),
c AS (SELECT *, cap * (aw - wb) <= w * (t - cb) AS capped FROM f),
g AS (SELECT *, coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS cs, coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0) AS cw FROM c),
p AS (SELECT source, ss, CASE WHEN capped THEN cap::DOUBLE ELSE (w * (t - cs))::DOUBLE / (aw - cw)::DOUBLE END AS target FROM g),
q AS (SELECT *, CASE WHEN ss > 0 THEN floor(target / ss::DOUBLE)::BIGINT ELSE 0 END AS whole FROM p),
x AS (SELECT d.doc_id, d.size, q.ss, q.target, q.whole, floor(q.target)::BIGINT - q.whole * q.ss AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, ss::BIGINT AS source_size, target, (whole * size + least(size, greatest(0, rest - b)))::BIGINT AS taken FROM x
"""
