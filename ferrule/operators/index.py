"""Inverted index from constituents to keys. Keys with an empty list stand under null: they are always available.

Every step goes by key. Given a number of tasks from `tasks`, all tables of a step are dealt by key to that many, so that a
task holds `TASK` rows or fewer on average at any size; without it Spark chooses, and joins partitions up to one for each core.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = 500_000
LOADED = 1_000_000


def tasks(spark: SparkSession, rows: int) -> int | None:
    """Null where a task for each core is enough. Joins don't go below the session's number of partitions, so this doesn't either."""
    n = -(-rows // TASK)
    return None if n <= spark.sparkContext.defaultParallelism else max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame, key: str, n: int | None) -> DataFrame:
    """The rows by key, and joined by it without a broadcast."""
    return rows if n is None else rows.repartition(n, key).hint("merge")


def build(rows: DataFrame, key: str, parts: str, n: int | None = None) -> DataFrame:
    """(key, part): a row for each distinct constituent; null where the list is empty. Keys with a null list are left out."""
    known = rows.filter(F.col(parts).isNotNull()).select(key, F.explode_outer(F.array_distinct(parts)).alias("part"))
    return dealt(known, key, n).distinct()


def of_entries(entries: DataFrame, key: str, part: str) -> DataFrame:
    """(key, part) from single entries, repeated or not; a null part is a key without constituents."""
    return entries.select(key, F.col(part).alias("part")).distinct()


def candidates(index: DataFrame, loaded: DataFrame) -> DataFrame:
    """Keys with a loaded constituent, and those always available. Up to `LOADED` constituents, counted first, go to all tasks,
    so that the index is read once and stays dealt by key; a longer list meets the index by constituent, as Spark plans it."""
    key = next(c for c in index.columns if c != "part")
    known, mark = loaded.select("part").distinct(), f"{key}_loaded"
    if known.count() <= LOADED:
        marked = index.join(F.broadcast(known.withColumn(mark, F.lit(True))), "part", "left")
        return marked.filter(F.col(mark) | F.col("part").isNull()).select(key).distinct()
    some = index.join(known, "part", "left_semi").select(key)
    return some.union(index.filter("part is null").select(key)).distinct()


def add(index: DataFrame, rows: DataFrame, key: str, parts: str, n: int | None = None) -> DataFrame:
    """Idempotent: entries that are there stay as they are."""
    return index.select(key, "part").union(build(rows, key, parts, n).select(key, "part")).distinct()


def remove(index: DataFrame, keys: DataFrame, key: str, n: int | None = None) -> DataFrame:
    return index.join(dealt(keys.toDF(key), key, n).distinct(), key, "left_anti").select(key, "part")


def reconcile(index: DataFrame, records: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Keys of the index without a record (dangling) and records that it lacks (unindexed)."""
    have, want = index.select(key).distinct(), dealt(records.select(key), key, n).distinct()
    return have.join(want, key, "left_anti").withColumn("state", F.lit("dangling")).union(want.join(have, key, "left_anti").withColumn("state", F.lit("unindexed")))
