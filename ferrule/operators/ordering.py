"""Places of rows in groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WITHIN = (1 << 33) - 1


def placed(df: DataFrame, by: Sequence[str], order: Sequence[Column], save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """`df` with _place, from 1 on in each group, and _size, the group's rows; null is a group.

    Rows are dealt by ranges of group and order and numbered in their partition. A group that goes over several
    partitions has a row for each of them in a small table, whose running sums shift the numbers.
    """
    keys = [F.col(f"`{c}`") for c in by]
    rows = save(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id()), "ordered").withColumn("_p", F.shiftright("_m", 33))
    names = [f"_g{i}" for i in range(len(by))]
    parts = rows.groupBy("_p", *[k.alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    group = Window.partitionBy(*names)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("_p").alias("_q"), *names, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("_size"))
    same = F.col("_p") == F.col("_q")
    for k, n in zip(keys, names, strict=True):
        same = same & k.eqNullSafe(F.col(n))
    return rows.join(parts, same).withColumn("_place", F.col("_m") + F.col("_shift") + 1).select(*[rows[f"`{c}`"] for c in df.columns], "_place", "_size")


def member_name(name: Column) -> Column:
    """The name alone, or with the place in brackets where the group has several rows."""
    return F.when(F.col("_size") == 1, name).otherwise(F.concat(name, F.lit("("), F.col("_place").cast("string"), F.lit(")")))


def batch_of(size: int) -> Column:
    """Which batch of `size` a placed row is in, from 0 on."""
    return F.floor((F.col("_place") - 1) / size)
