"""Programs over whole stores: removal, pruning, checks, undo, instances and censuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def xor_of_hashes(rows: DataFrame, key: str, value: str) -> DataFrame:
    """XOR of 16-byte values of each key, as bytes: two halves of eight, which Spark sums before the shuffle."""
    half = lambda at: F.conv(F.hex(F.substring(value, at, 8)), 16, -10).cast("long")
    sums = rows.groupBy(key).agg(F.bit_xor(half(1)).alias("_a"), F.bit_xor(half(9)).alias("_b"))
    return sums.select(key, F.unhex(F.concat(*(F.lpad(F.hex(c), 16, "0") for c in ("_a", "_b")))).alias("xor"))


def census(before: DataFrame, after: DataFrame, kind: str) -> DataFrame:
    a, b = before.groupBy(kind).agg(F.count("*").alias("before")), after.groupBy(kind).agg(F.count("*").alias("after"))
    out = a.join(b, kind, "left").withColumn("after", F.coalesce("after", F.lit(0).cast("long")))
    return out.withColumn("conserved", F.col("before") == F.col("after"))


def gate(rows: DataFrame, what: str) -> None:
    """An error where a check has found rows; it counts no further than to the first."""
    if rows.limit(1).count():
        raise ValueError(what)


def extend(base: DataFrame, extras: DataFrame, key: str, rest: Sequence[str], kind: str, theorem: int) -> DataFrame:
    """The context and the extras it lacks; an extra of kind `theorem` goes where the context has another face of it."""
    new = extras.join(base.select(key), key, "left_anti").dropDuplicates([key])
    faces = base.filter(F.col(kind) != theorem).select(*rest).distinct()
    theorems = new.filter(F.col(kind) == theorem).join(faces, list(rest), "left_anti").select(*base.columns)
    return base.unionByName(new.filter(F.col(kind) != theorem)).unionByName(theorems)


def instances(rows: DataFrame, templates: DataFrame, digest: str, name: str, suffix: str, key: str, template: str) -> DataFrame:
    """(key, template, suffix): equal digests, names that end with the suffix, the longest first, then the least template.

    A suffix that fits is the name from its start or from behind one of its dots, so both sides meet by equal keys, and of
    templates with equal digests and suffixes only the least can be the best.
    """
    parts = F.split(name, r"\.", -1)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    first = templates.groupBy(digest, suffix).agg(F.min(F.struct(template)).alias("_t"))
    tails = rows.filter(F.col(name).isNotNull()).select(key, digest, F.explode(ends).alias(suffix))
    best = F.min(F.struct((-F.length(suffix)).alias("l"), F.col(f"_t.{template}").alias(template), F.col(suffix))).alias("_m")
    return tails.join(first, [digest, suffix]).groupBy(key).agg(best).select(key, f"_m.{template}", f"_m.{suffix}")


def ranked_with_rest(groups: DataFrame, key: str, n: str, limit: int) -> DataFrame:
    """The first groups by size, and one row with a null key for the sum of the others."""
    top = groups.orderBy(F.desc(n), key).limit(limit)
    rest = groups.join(top.select(key), key, "left_anti").agg(F.lit(None).cast(groups.schema[key].dataType).alias(key), F.sum(n).alias(n)).filter(F.col(n).isNotNull())
    return top.select(key, n).union(rest.select(key, n))


def prune_plan(rows: DataFrame, name: str, order: Sequence[Column], keep: int) -> DataFrame:
    return rows.withColumn("doomed", F.row_number().over(Window.partitionBy(name).orderBy(*order)) > keep)


def removal_plan(keys: DataFrame, key: str, vectors: DataFrame) -> DataFrame:
    """(step, key) in the order in which they must be written: vectors, index, records."""
    step = lambda df, s: df.select(F.lit(s).alias("step"), key)
    return step(keys.join(vectors, key, "left_semi"), "1 vectors").union(step(keys, "2 index")).union(step(keys, "3 records"))


def store_check(view: DataFrame, vectors: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Counts of what a check of a store reports."""
    count = lambda df, fact: df.agg(F.lit(fact).alias("fact"), F.count("*").alias("n"))
    live = view.select(key)
    return count(live, "records").union(count(vectors.join(live, key, "left_anti"), "orphan vectors")).union(count(live.join(index, key, "left_anti"), "unindexed")).union(count(index.join(live, key, "left_anti"), "dangling"))


def applied(store: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    return store.join(writes.select(key), key, "left_anti").unionByName(writes)


def pre_image(store: DataFrame, writes: DataFrame, key: str) -> DataFrame:
    """What the written keys held before; `was_there` is false for new ones."""
    return writes.select(key).distinct().join(store.withColumn("was_there", F.lit(True)), key, "left").withColumn("was_there", F.coalesce("was_there", F.lit(False)))


def restore(store: DataFrame, image: DataFrame, key: str) -> DataFrame:
    back = image.filter("was_there").drop("was_there")
    return store.join(image.select(key), key, "left_anti").unionByName(back.select(*store.columns))
