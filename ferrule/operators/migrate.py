"""Migrations of whole stores: each gives new rows and stops at a gate before anything is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import records as rec
from ferrule.functions import vectors
from ferrule.functions.text import member_base

from . import upkeep


def rekeyed(rows: DataFrame, mapping: DataFrame, parts: str = "constituents") -> DataFrame:
    """Rows (uk, theory, tail, parts: (name, hash)) under the new hashes of their theories; composed keys from all parts.

    mapping (old, name, new): a hash that more than one theory had is told apart by its name. Unmapped hashes stay.
    Two rows that would share a key are an error.
    """
    one = mapping.groupBy("old").agg(F.when(F.count_distinct("new") == 1, F.min("new")).alias("only"))
    own = rows.join(one.withColumnRenamed("old", "theory"), "theory", "left").withColumn("theory", F.coalesce("only", "theory")).drop("only")
    each = own.select("uk", F.posexplode(parts).alias("place", "p")).select("uk", "place", "p.name", "p.hash")
    named = mapping.select(F.col("old").alias("hash"), "name", F.col("new").alias("by_name")).dropDuplicates(["hash", "name"])
    each = each.join(named, ["hash", "name"], "left").join(one.withColumnRenamed("old", "hash"), "hash", "left")
    each = each.withColumn("hash", F.coalesce("by_name", "only", "hash"))
    again = each.groupBy("uk").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "name", "hash"))), lambda x: F.struct(x["name"], x["hash"])).alias("_parts"))
    prefix = upkeep.xor_of_hashes(each.select("uk", F.unhex("hash").alias("h")), "uk", "h").select("uk", F.lower(F.hex("xor")).alias("_xor"))
    out = own.join(again, "uk", "left").join(prefix, "uk", "left")
    out = out.withColumn(parts, F.coalesce("_parts", parts)).withColumn("new_uk", F.concat(F.coalesce("_xor", "theory"), "tail")).drop("_parts", "_xor")
    upkeep.gate(out.groupBy("new_uk").agg(F.count("*").alias("n")).filter("n > 1"), "rows that would share a key")
    return out


def hash_change(records: DataFrame, registry: DataFrame, name: Column, new: str) -> DataFrame:
    """Rows of the newest finished theory of that name under a new hash."""
    latest = registry.filter("finished").filter(name).orderBy(F.desc("ts"), "theory").limit(1).select("theory")
    return records.join(F.broadcast(latest), "theory", "left_semi").withColumn("theory", F.lit(new))  # one row


def classified(rows: DataFrame, collections: DataFrame) -> DataFrame:
    """`from_collection` for members; an error where a member-like name without a position has no collection in its theory."""
    base = member_base(F.col("name"))
    like = rows.filter(~F.col("kind").isin(7, 8) & F.col("position").isNull() & base.isNotNull()).select("uk", "theory", base.alias("base"))
    known = like.join(collections.select("theory", F.col("name").alias("base")).distinct(), ["theory", "base"], "left_semi")
    upkeep.gate(like.join(known.select("uk"), "uk", "left_anti"), "members of no collection")
    return rows.drop("from_collection").join(known.select("uk", F.col("base").alias("from_collection")), "uk", "left")


def quantised(rows: DataFrame, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Vectors kept as floats (uk, v), quantised once, and counts by format; other lengths are left for a look."""
    kind = F.when(F.size("v") == dimension, "float32").otherwise("other")
    return rows.filter(kind == "float32").select("uk", vectors.encode_q15(F.col("v")).alias("q")), rows.groupBy(kind.alias("format")).agg(F.count("*").alias("n"))


def padded(rows: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Missing fields at the end, as nulls."""
    return rows.select(*rows.columns, *(F.lit(None).cast(t).alias(c) for c, t in fields.items() if c not in rows.columns))


def without_kinds(rows: DataFrame, kinds: list[int]) -> DataFrame:
    return rows.filter(~F.col("kind").isin(*kinds))


def positions_missing(rows: DataFrame) -> DataFrame:
    """By kind: records with and without a position."""
    return rows.groupBy("kind").agg(F.count("position").alias("have"), (F.count("*") - F.count("position")).alias("lack"))


def list_patterns(rows: DataFrame) -> DataFrame:
    """Patterns kept as JSON in `expr` of experiences move to their own field; broken ones become null."""
    old = (F.col("kind") == rec.EXPERIENCE) & F.col("goal_patterns").isNull()
    return rows.withColumns({"goal_patterns": F.when(old, F.from_json("expr", "array<string>")).otherwise(F.col("goal_patterns")), "expr": F.when(old, None).otherwise(F.col("expr"))})


def prune_targets(names: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, name, state): the exact name, else the only one that ends with a dot and it."""
    ends = names.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", r"\."))), lambda i: F.call_function("substring_index", F.col("name"), F.lit("."), -i))).alias("asked"))
    hits = asked.join(ends.join(asked.select("asked").distinct(), "asked", "left_semi"), "asked", "left")
    exact = F.max(F.when(F.col("name") == F.col("asked"), F.col("name")))
    found = hits.groupBy("asked").agg(exact.alias("exact"), F.count("name").alias("n"), F.min("name").alias("only"))
    return found.select("asked", F.coalesce("exact", F.when(F.col("n") == 1, F.col("only"))).alias("name"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, "ambiguous").otherwise("missing").alias("state"))


def read_dependencies(spark, path: str) -> DataFrame:
    """(node, loaded, path, parent) of tab-separated lines `DEP name loaded path parents`, parents with commas between."""
    rows = spark.read.csv(path, sep="\t", schema="tag string, node string, loaded string, path string, parents string").filter("tag = 'DEP'")
    return rows.select("node", (F.col("loaded") == "true").alias("loaded"), "path", F.explode_outer(F.filter(F.split("parents", ","), lambda x: x != "")).alias("parent"))


def newest_finished(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("name").orderBy(F.desc("ts"), "theory")
    return rows.filter("finished").withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")
