"""Maintenance of stores as relational programs: merge plans, re-keying, renames, generations, ranking by weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def orphan_groups(members: DataFrame, key: str, owner: str, registry: DataFrame, samples: int = 3) -> DataFrame:
    """Keys none of whose owners is registered, by their least owner: count and the first samples.

    The samples come from a window that keeps `samples` rows a group, so no group is gathered whole.
    """
    known = registry.select(F.col(owner), F.lit(1).alias("_known")).distinct()
    each = members.join(known, owner, "left").groupBy(key).agg(F.min(owner).alias(owner), F.max("_known").alias("_known")).filter("_known is null")
    counts = each.groupBy(owner).agg(F.count("*").alias("n"))
    few = each.withColumn("_r", F.row_number().over(Window.partitionBy(owner).orderBy(key))).filter(F.col("_r") <= samples)
    few = few.groupBy(owner).agg(F.array_join(F.sort_array(F.collect_list(key)).cast("array<string>"), ",").alias("samples"))
    return counts.join(few, owner)


def registry_gaps(keys: DataFrame, key: str, registry: DataFrame) -> DataFrame:
    """Keys in use that the registry lacks, with the number of uses: counted before the anti-join."""
    return keys.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).join(registry.select(key), key, "left_anti")


def registry_plan(local: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """(key, name, ts) of both sides to add, refresh, keep or conflict; a local entry without a name is a tombstone."""
    l, i = local.select(key, F.col("name").alias("l_name"), F.col("ts").alias("l_ts"), F.lit(True).alias("l")), incoming.select(key, F.col("name").alias("i_name"), F.col("ts").alias("i_ts"))
    action = F.when(F.col("l").isNull() | F.col("l_name").isNull(), "add").when(F.col("l_name") != F.col("i_name"), "conflict").when(F.col("i_ts") > F.col("l_ts"), "refresh").otherwise("keep")
    both = i.join(l, key, "left").withColumn("action", action)
    return both.select(key, "action", F.when(F.col("action").isin("add", "refresh"), F.col("i_name")).otherwise(F.col("l_name")).alias("name"), F.when(F.col("action").isin("add", "refresh"), F.col("i_ts")).otherwise(F.col("l_ts")).alias("ts"))


def vector_plan(local: DataFrame, incoming: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """(key, value) of vectors on both sides; vectors of records that the merge changes follow the incoming side or go."""
    l, i = local.select(key, F.col("value").alias("l")), incoming.select(key, F.col("value").alias("i"))
    both = l.join(i, key, "full").join(changed.select(key, F.lit(True).alias("c")), key, "left")
    of_changed = F.when(F.col("i").isNull(), "drop").when(F.col("l").isNull(), "add").when(F.col("l") == F.col("i"), "identical").otherwise("update")
    of_same = F.when(F.col("i").isNull(), "local").when(F.col("l").isNull(), "add").when(F.col("l") == F.col("i"), "identical").otherwise("keep_local")
    return both.select(key, F.when(F.col("c"), of_changed).otherwise(of_same).alias("action"))


def rekey(rows: DataFrame, key: str, mapping: DataFrame, new: str) -> DataFrame:
    """Rows under their new keys; unmapped ones stay. `collides` marks keys that more than one row then has."""
    moved = rows.join(mapping.select(key, new), key, "left").withColumn("to", F.coalesce(new, key))
    many = moved.groupBy("to").agg((F.count("*") > 1).alias("collides"))
    return moved.join(many, "to").select(key, "to", "collides")


def rename_siblings(rows: DataFrame, group: Sequence[str], name: str, position: str) -> DataFrame:
    """A row `base(i)` without a position takes the name and position of its group's first sibling that has one."""
    donor = rows.filter(F.col(position).isNotNull()).groupBy(*group).agg(F.min_by(F.struct(name, position), F.struct(position, name)).alias("_d"))
    joined = rows.join(donor, list(group), "left")
    takes = F.col(position).isNull() & F.col(name).rlike(r"^.*\(\d+\)$") & F.col("_d").isNotNull()
    return joined.withColumns({"new_name": F.when(takes, F.col(f"_d.{name}")).otherwise(F.col(name)), "new_position": F.when(takes, F.col(f"_d.{position}")).otherwise(F.col(position))}).drop("_d")


def dominant(rows: DataFrame, key: str, goal: str, word: str, tie: str) -> DataFrame:
    """One row for each key: a goal offset beats none, then the smaller one, then the smaller word offset (null: -1)."""
    order = F.struct(F.col(goal).isNull(), F.coalesce(F.col(goal).cast("long"), F.lit(0).cast("long")), F.coalesce(F.col(word).cast("long"), F.lit(-1).cast("long")), F.col(tie))
    return rows.groupBy(key).agg(F.min_by(tie, order).alias(tie))


def bump_versions(stored: DataFrame, current: DataFrame, key: str, counter: Column) -> DataFrame:
    """(key, digest, version, tracked) against (key, now): a changed digest takes counter + 1; no stored digest, no stamp."""
    both = stored.join(current.select(key, F.col("now")), key, "left")
    bump = F.col("tracked") & F.col("digest").isNotNull() & F.col("now").isNotNull() & (F.col("digest") != F.col("now"))
    return both.select(key, F.when(bump, counter + 1).otherwise(F.col("version")).alias("version"), F.coalesce(bump, F.lit(False)).alias("bumped"))


def mesh(legs: Sequence[tuple[DataFrame, float]], key: str, rank: str, base: float = 0.62) -> DataFrame:
    """Ranked legs to one score for each key: the weighted sum of base ** log2(rank + 1)."""
    parts = [leg.select(key, (F.lit(w) * F.pow(F.lit(base), F.log2(F.col(rank) + 1))).alias("s")) for leg, w in legs]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.round(F.sum("s"), 9).alias("score"))


def resolve(names: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked) to an exact name, else the one hex key with that prefix; `state` is name, prefix, ambiguous or missing.

    Prefixes of each length that is asked for are equal-joined, so no pair is compared that doesn't match.
    """
    exact = asked.join(names.groupBy(F.col("name").alias("asked")).agg(F.min("hex").alias("by_name"), F.count("*").alias("n_name")), "asked", "left")
    lengths = asked.select(F.length("asked").alias("_l")).distinct()
    heads = names.crossJoin(F.broadcast(lengths.filter("_l between 1 and 32"))).select(F.expr("substring(hex, 1, _l)").alias("asked"), "hex")  # at most 32 lengths
    heads = heads.join(asked.select("asked").distinct(), "asked", "left_semi").groupBy("asked").agg(F.min("hex").alias("by_hex"), F.count("*").alias("n_hex"))
    both = exact.join(heads, "asked", "left")
    state = F.when(F.col("n_name") == 1, "name").when(F.col("n_name") > 1, "ambiguous").when(F.col("n_hex") == 1, "prefix").when(F.col("n_hex") > 1, "ambiguous").otherwise("missing")
    return both.select("asked", state.alias("state"), F.when(state == "name", F.col("by_name")).when(state == "prefix", F.col("by_hex")).alias("hex"))


def final_scores(candidates: DataFrame, scored: DataFrame, key: str, default: Column, k: int) -> DataFrame:
    """Candidates by score, those without a vector by a default for their place; the best k, ties by key."""
    both = candidates.join(scored.select(key, "score"), key, "left").withColumn("score", F.coalesce("score", default))
    return both.orderBy(F.desc("score"), key).limit(k)
