"""Trees of digests over ranges of keys: where two versions of a table differ, found without reading what is equal.

A leaf is a range of keys, numbered in key order; its digest counts every row, repeated ones too. A node has `FAN` children
and the sums of their digests, so a tree is made by adding up and changes by differences. Two trees are compared from
the top: a level looks only at children of nodes that differ. A table written by ranges has a folder for each, so only
those that differ are read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources.snapshot import row_hash

FAN = 16
Save = Callable[[DataFrame, str], DataFrame]


def by_number(key: Column, width: int) -> Column:
    """Ranges of `width` numbers from 0 on."""
    return F.floor(key / width).cast("long")


def by_prefix(key: Column, digits: int = 4) -> Column:
    """Ranges of binary keys by their first hex digits, in the order of unsigned bytes; shorter keys count as if zeros followed."""
    return F.conv(F.rpad(F.substring(F.hex(key), 1, digits), digits, "0"), 16, 10).cast("long")


def leaves(df: DataFrame, leaf: Column) -> DataFrame:
    """(node, n, a, b) of the ranges."""
    a, b = row_hash(df)
    return df.select(leaf.alias("node"), a.alias("a"), b.alias("b")).groupBy("node").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))


def tree(df: DataFrame, leaf: Column, depth: int, save: Save) -> DataFrame:
    """(level, node, n, a, b): level 0 are the leaves, level `depth` is made of FAN ** depth leaves each."""
    level = save(leaves(df, leaf), "leaves")
    out = level.withColumn("level", F.lit(0))
    for d in range(1, depth + 1):
        level = level.groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(*[F.sum(c).cast(level.schema[c].dataType).alias(c) for c in ("n", "a", "b")])
        out = out.unionByName(level.withColumn("level", F.lit(d)))
    return save(out.select("level", "node", "n", "a", "b").repartition("level"), "tree")


def changed(old: DataFrame, new: DataFrame, save: Save) -> DataFrame:
    """(node, change) of leaves that were added, removed or differ, from two trees of the same depth."""
    depth = old.agg(F.max("level")).first()[0]
    depth = new.agg(F.max("level")).first()[0] if depth is None else depth
    open_nodes = None
    for d in range(depth if depth is not None else 0, -1, -1):
        a = old.filter(F.col("level") == d).select("node", F.struct("n", "a", "b").alias("old"))
        b = new.filter(F.col("level") == d).select("node", F.struct("n", "a", "b").alias("new"))
        if open_nodes is not None:
            parent = F.floor(F.col("node") / FAN) == F.col("up")
            a, b = (x.join(open_nodes, parent, "left_semi") for x in (a, b))
        differ = a.join(b, "node", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new")))
        change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
        found = save(differ.select("node", change.alias("change")), f"differ-{d}")
        open_nodes = found.select(F.col("node").alias("up"))
    return found


def write(df: DataFrame, leaf: Column, path: str) -> None:
    """One folder for each range."""
    df.withColumn("range", leaf).repartition("range").write.mode("overwrite").partitionBy("range").parquet(path)


def read(spark: SparkSession, path: str, found: DataFrame, changes: Sequence[str] = ("added", "changed")) -> DataFrame:
    """The rows of ranges with those changes; other folders are not opened, as the ranges are known before the scan begins."""
    wanted = found.filter(F.col("change").isin(*changes)).select(F.col("node").alias("range"))
    return spark.read.parquet(path).join(wanted, "range", "left_semi")
