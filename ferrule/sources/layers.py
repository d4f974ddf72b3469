"""Two-layer stores: a writable user layer over a read-only system layer, with tombstones.

A user row shadows the system row of its key; a user row with `deleted` hides it. Filters on either
side of the union reach both scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def layered(user: DataFrame, system: DataFrame, key: str) -> DataFrame:
    """The visible rows, without the `deleted` column."""
    return user.filter(~F.col("deleted")).drop("deleted").unionByName(system.join(user.select(key), key, "left_anti"), allowMissingColumns=True)


def multi_get(keys: DataFrame, view: DataFrame, key: str) -> DataFrame:
    """`keys` has (pos, key); a row for each, with nulls where the view has none."""
    return keys.join(view.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def contains(keys: DataFrame, view: DataFrame, key: str) -> DataFrame:
    return multi_get(keys, view.select(key).distinct(), key)


def prefix_scan(view: DataFrame, key: str, prefix: str) -> DataFrame:
    return view.filter(F.col(key).startswith(prefix))


def gather(domain: DataFrame, vectors: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """Each distinct key of the domain: kept, missing, or skipped for the wrong size."""
    state = F.when(F.col(vector).isNull(), "missing").when(F.size(vector) != size, "skipped").otherwise("kept")
    return domain.select(key).distinct().join(vectors.select(key, vector), key, "left").withColumn("state", state)


def compact(log: DataFrame, key: str, seq: str) -> DataFrame:
    """The last write of each key, deletions included; partial maxima go before the shuffle."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r")).select(key, "_r.*")


def copy_up(view: DataFrame, updates: DataFrame, key: str, field: str) -> DataFrame:
    """Rows for the user layer: one field changed, absent keys left out."""
    changed = updates.select(key, F.col(field).alias("_new"))
    return view.join(changed, key).withColumn(field, F.col("_new")).drop("_new").withColumn("deleted", F.lit(False))


def invalidate(keys: DataFrame, stores: DataFrame) -> DataFrame:
    """A tombstone in every vector store, however many there are."""
    return keys.crossJoin(stores).withColumn("deleted", F.lit(True))


def layer_label(user: Column, system: Column) -> Column:
    return F.when(user & system, "system+user").when(system, "system").when(user, "user").otherwise("removed")


def newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """Keep the first `n` of each group; Spark limits groups before the shuffle."""
    return rows.withColumn("generation", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("generation") <= n)


def ordered(user: DataFrame, system: DataFrame, key: str) -> DataFrame:
    """The visible rows in the order of their keys, with the layer that serves each."""
    return layered(user.withColumn("layer", F.lit("user")), system.withColumn("layer", F.lit("system")), key).orderBy(key)


EMBEDDED = ("kind", "name", "expr", "interpretation", "goal_patterns")  # fixed values: what a vector is made from


def backfill(view: DataFrame, entries: DataFrame, key: str, field: str) -> tuple[DataFrame, DataFrame]:
    """Rows for the user layer with one field filled, and one row of counts: hit, missing.

    A field that a vector is made from is refused, as its vectors would then be of another text.
    """
    if field in EMBEDDED:
        raise ValueError(f"{field} is part of what is embedded")
    rows = view.drop(field).join(entries.select(key, field), key).withColumn("deleted", F.lit(False))
    known = entries.select(key).join(view.select(key, F.lit(True).alias("_hit")), key, "left")
    return rows, known.agg(F.count("_hit").alias("hit"), (F.count("*") - F.count("_hit")).alias("missing"))


def delete(view: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Tombstones for the user layer with whether each key was visible; the same keys for `invalidate`, to be written first."""
    wanted = keys.select(key).distinct()
    return wanted.join(view.select(key, F.lit(True).alias("was_visible")), key, "left").select(key, F.coalesce("was_visible", F.lit(False)).alias("was_visible"), F.lit(True).alias("deleted")), wanted


def upsert(view: DataFrame, rows: DataFrame, key: str, stores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to write, in this order: tombstones of the vectors of keys that change, then the rows."""
    return invalidate(rows.select(key).distinct(), stores), rows.withColumn("deleted", F.lit(False))


def store_names(*layers_: DataFrame) -> DataFrame:
    """Names of all layers, each once, sorted."""
    every = layers_[0].select("name")
    for x in layers_[1:]:
        every = every.union(x.select("name"))
    return every.filter("name is not null").distinct().orderBy("name")


def three_states(keys: DataFrame, vectors: DataFrame, dead: DataFrame, key: str, vector: str) -> DataFrame:
    """value, tombstone or absent; only a value has a vector."""
    rows = keys.join(vectors.select(key, vector), key, "left").join(dead.select(key, F.lit(True).alias("_dead")), key, "left")
    state = F.when(F.col("_dead"), "tombstone").when(F.col(vector).isNull(), "absent").otherwise("value")
    return rows.withColumn("state", state).withColumn(vector, F.when(F.col("state") == "value", F.col(vector))).drop("_dead")
