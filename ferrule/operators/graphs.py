"""Walks over graphs, a level at a time; `save` writes a level's table to cut lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(edges: DataFrame, start: DataFrame, save: Callable[[DataFrame, str], DataFrame], enough: int = 300) -> DataFrame:
    """(node, level): all that can be reached, by whole levels, until `enough` nodes are found or nothing new is."""
    found = save(start.select("node").distinct().withColumn("level", F.lit(0)), "level-0")
    near, level = found, 0
    while True:
        level += 1
        new = near.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
        near = save(new.withColumn("level", F.lit(level)), f"level-{level}")
        if not near.limit(1).count():
            return found
        found = found.unionByName(near)
        if found.limit(enough).count() >= enough:
            return found


def merkle(nodes: DataFrame, edges: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, hash): 16 bytes of the node's name, content and its parents' hashes in order; the lowest bit of the first byte is off.

    nodes (node, name, content), edges (node, place, parent). A level is done when all parents are; a cycle is an error.
    A level's hashes meet only the edges that still wait for one, by sort-merge joins: no level goes through the driver.
    """

    def hashed(ready: DataFrame) -> DataFrame:
        text = F.concat("name", F.lit("\0"), F.coalesce("content", F.lit("")), F.lit("\0"), F.array_join(F.col("p.h"), ","))
        raw = F.substring(F.sha2(text, 256), 1, 32)
        first = F.conv(F.substring(raw, 1, 2), 16, 10).cast("int")
        even = F.concat(F.lpad(F.hex((first - first % 2).cast("long")), 2, "0"), F.substring(raw, 3, 30))
        return ready.select("node", F.unhex(even).alias("hash"))

    rows = edges.join(nodes.select("node").hint("merge"), "node", "left_semi").select("node", "place", "parent")
    wait = rows.withColumn("h", F.lit(None).cast("string"))
    start = nodes.join(edges.select("node").hint("merge"), "node", "left_anti")
    new = save(hashed(start.withColumn("p", F.array().cast("array<struct<h:string>>"))), "level-0")
    done, level = new, 0
    while True:
        level += 1
        came = new.select(F.col("node").alias("parent"), F.lower(F.hex("hash")).alias("_h"))
        met = wait.filter("h is null").drop("h").join(came.hint("merge"), "parent", "left").select("node", "place", "parent", F.col("_h").alias("h"))
        p = F.array_sort(F.collect_list(F.struct("place", "h", "parent"))).alias("p")
        by_node = save(met.unionByName(wait.filter("h is not null")).groupBy("node").agg(p, F.bool_and(F.col("h").isNotNull()).alias("ready")), f"waiting-{level}")
        ready, left = by_node.agg(F.count_if("ready"), F.count_if(~F.col("ready"))).first()
        if not ready:
            if left:
                raise ValueError("the graph has a cycle")
            return done
        new = save(hashed(by_node.filter("ready").join(nodes.hint("merge"), "node")), f"level-{level}")
        done = done.unionByName(new)
        if not left:
            return done
        wait = by_node.filter(~F.col("ready")).select("node", F.explode("p").alias("e")).select("node", "e.place", "e.parent", "e.h")


def new_facts(local: DataFrame, parents: list[DataFrame], key: str) -> DataFrame:
    """Facts that no parent's snapshot has, each once."""
    every = parents[0].select(key)
    for p in parents[1:]:
        every = every.union(p.select(key))
    return local.dropDuplicates([key]).join(every.distinct(), key, "left_anti")


def merged(parents: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of several snapshots, each bucket's key once."""
    every = parents[0]
    for p in parents[1:]:
        every = every.unionByName(p)
    return every.dropDuplicates(keys)
