"""Greatest values over all paths of a directed graph: versions over what a node depends on, levels of an order of work.

value(v) is the greatest of base(u) plus the weights of a path from v to u, v itself included. Nodes with one edge out
are taken out first: their pointers double their reach each turn, so chains of any length take turns as their logarithm.
The rest is a smaller graph, whose edges stand for whole chains; it is contracted again as long as that takes out a tenth
of it. What remains has nodes with several edges; their values are handed on by `HOPS` edges in each job.

Jobs so grow with the logarithm of chains and with the number of branching nodes on a path after contraction; a graph
whose long paths branch at every node, such as a grid, still takes a hop for each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

Save = Callable[[DataFrame, str], DataFrame]
HOPS = 3
WORTH = 10


def watched(save: Save, df: DataFrame, name: str, *counts) -> tuple[DataFrame, list]:
    """Writes a table; the counts are taken while it is written."""
    seen = Observation()
    out = save(df.observe(seen, *[c.alias(f"c{i}") for i, c in enumerate(counts)]), name)
    return out, [seen.get[f"c{i}"] or 0 for i in range(len(counts))]


def chains(single: DataFrame, save: Save, name: str, cyclic: bool) -> DataFrame:
    """(node, best, len, end) of nodes with one edge out: value is the greater of best and len + value(end).

    Ends have none or several edges. On a cycle of such nodes best is the whole value and end is null.
    """
    state, turn, before = single, 0, None
    while True:
        turn += 1
        start = state.select("node", "best", "len", "end").withColumn("old", F.col("best"))
        step = start
        for _ in range(2):
            ahead = step.select(F.col("node").alias("end"), F.col("best").alias("_best"), F.col("len").alias("_len"), F.col("end").alias("_end"))
            step = step.join(ahead, "end", "left").select("node", F.greatest("best", F.col("len") + F.col("_best")).alias("best"), (F.col("len") + F.coalesce("_len", F.lit(0))).alias("len"), F.coalesce("_end", "end").alias("end"), "old", F.col("_end").isNotNull().alias("open"))
        state, (left, moved) = watched(save, step, f"{name}-chain-{turn}", F.count_if("open"), F.count_if(F.col("best") != F.col("old")))
        if not left:
            return state.select("node", "best", "len", "end")
        if before == left and (not moved or not cyclic):
            if not cyclic:
                raise ValueError("the graph has a cycle")
            round_ = state.select(F.col("node").alias("end")).withColumn("_in", F.lit(True))
            return state.join(round_, "end", "left").select("node", "best", "len", F.when(F.col("_in").isNull(), F.col("end")).alias("end"))
        before = left


def handed_on(nodes: DataFrame, edges: DataFrame, save: Save, name: str, cyclic: bool, size: int) -> DataFrame:
    """(node, value) by hops, until none changes a value."""
    state, turn = nodes.select("node", F.col("base").alias("value")), 0
    while True:
        turn += 1
        step = state.withColumn("old", F.col("value"))
        for _ in range(HOPS):
            near = edges.join(step.select(F.col("node").alias("dst"), "value"), "dst").groupBy(F.col("src").alias("node")).agg(F.max(F.col("w") + F.col("value")).alias("near"))
            step = step.join(near, "node", "left").select("node", F.greatest("value", "near").alias("value"), "old")
        state, (moved,) = watched(save, step, f"{name}-hop-{turn}", F.count_if(F.col("value") != F.col("old")))
        state = state.select("node", "value")
        if not moved:
            return state
        if not cyclic and turn * HOPS > size:
            raise ValueError("the graph has a cycle")


def greatest(nodes: DataFrame, edges: DataFrame, save: Save, cyclic: bool = False, depth: int = 0) -> DataFrame:
    """(node, value) from nodes (node, base) and edges (src, dst, w) between them.

    With `cyclic` cycles are fine, and weights must be zero; else a cycle is an error.
    """
    name = f"core-{depth}"
    between = edges.groupBy("src", "dst").agg(F.max("w").alias("w"))
    between, (loops,) = watched(save, between.filter("src <> dst") if cyclic else between, f"{name}-edges", F.count_if(F.col("src") == F.col("dst")))
    if loops:
        raise ValueError("the graph has a cycle")
    out = between.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("end"), F.min("w").alias("len"))
    rows = nodes.join(out, nodes["node"] == out["src"], "left").select("node", F.col("base").cast("long").alias("base"), F.coalesce("n", F.lit(0)).alias("n"), "end", F.col("len").cast("long").alias("len"))
    rows, (single, several) = watched(save, rows, f"{name}-nodes", F.count_if(F.col("n") == 1), F.count_if(F.col("n") > 1))
    if not single * WORTH >= single + several or not single:
        return handed_on(rows, between, save, name, cyclic, single + several) if single + several else rows.select("node", F.col("base").alias("value"))
    chain = chains(rows.filter("n = 1").select("node", F.col("base").alias("best"), "len", "end"), save, name, cyclic)
    inner = rows.filter("n <> 1").select("node", "base")
    if several:
        link = between.join(rows.filter("n > 1").select(F.col("node").alias("src")), "src", "left_semi").join(chain.withColumnRenamed("node", "dst"), "dst", "left")
        through = F.col("len").isNotNull()
        link = save(link.select("src", F.when(through, F.col("end")).otherwise(F.col("dst")).alias("dst"), (F.col("w") + F.coalesce("len", F.lit(0))).alias("w"), (F.col("w") + F.col("best")).alias("most")), f"{name}-links")
        most = link.groupBy(F.col("src").alias("node")).agg(F.max("most").alias("most"))
        inner = inner.join(most, "node", "left").select("node", F.greatest("base", "most").alias("base"))
        core = greatest(inner, link.filter("dst is not null").select("src", "dst", "w"), save, cyclic, depth + 1)
    else:
        core = inner.select("node", F.col("base").alias("value"))
    ends = core.select(F.col("node").alias("end"), F.col("value").alias("_value"))
    outer = chain.join(ends, "end", "left").select("node", F.greatest("best", F.col("len") + F.col("_value")).alias("value"))
    return save(core.unionByName(outer), f"{name}-values")
