"""Queries of source scans and of helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators import helpers
from ferrule.sources import theories

from .queries import Tables, query


@query("")
def source_offsets(t: Tables) -> DataFrame:
    """Documents as files: where the words of an item first stand, and first follow an article."""
    sources = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    items = t.benchmark.select("item_id", F.slice(F.split("text", r"\W+"), 1, 8).alias("w"))
    many = t.benchmark.count()  # a document asks for the words of one item
    names = t.documents.select("doc_id", (F.col("doc_id") % max(many, 1)).alias("item_id")).join(items, "item_id").select(F.col("doc_id").cast("string").alias("path"), F.explode("w").alias("name")).filter("name <> ''")
    return theories.offsets(sources, names, ("the", "der", "die", "de", "la"))


CONSTANTS = """c AS (SELECT CASE p_partkey % 8 WHEN 0 THEN p_brand || '.class.' || p_size WHEN 1 THEN replace(p_name, ' ', '.') || '_class' WHEN 2 THEN 'Tool.Abs_' || p_partkey WHEN 3 THEN 'Lib.eq_' || replace(p_type, ' ', '_') || '_inst.eq'
WHEN 4 THEN 'HOL.equal' || p_partkey WHEN 5 THEN 'Own.t' || p_size || '.con' || p_partkey WHEN 6 THEN 'a.k' || p_partkey || '_class.x' ELSE 'a.k' || (p_partkey - 1) || '.x' END AS name,
p_size % 10 = 0 AS concealed, p_size = 9 AS preserved, p_size AS origin, p_partkey % 16 = 1 AS is_prop, p_partkey, p_type FROM part),
d AS (SELECT name FROM c GROUP BY name HAVING arg_max(p_partkey % 3 = 0, p_partkey) = false AND bool_or(p_partkey % 50 = 7) AND arg_max(p_partkey % 50 = 7, p_partkey))"""


@query(f"""WITH {CONSTANTS}, b AS (SELECT *, string_split(name, '.')[-1] AS base FROM c), v AS (SELECT DISTINCT regexp_replace(name, '_class[.]x$', '.x') AS name FROM c WHERE regexp_matches(name, '_class[.]x$'))
SELECT name, name IN (SELECT name FROM d) OR (NOT preserved AND (concealed OR starts_with(name, 'HOL.equal') OR starts_with(name, 'Tool.') OR (contains(name, '_inst.') AND p_type LIKE 'PROMO%') OR name IN (SELECT name FROM v) OR starts_with(base, 'Abs_')
OR (starts_with(name, 'Own.t') AND origin % 4 = 1 AND p_partkey % 8 = 5) OR contains(name, '.class.') OR (ends_with(base, '_class') AND is_prop))) AS helper FROM b""")
def helper_constants(t: Tables) -> DataFrame:
    """Names made of those of parts, by all rules for constants."""
    k, size = F.col("p_partkey"), F.col("p_size")
    dots, under = F.replace("p_name", F.lit(" "), F.lit(".")), F.replace("p_type", F.lit(" "), F.lit("_"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    kinds = [text(F.col("p_brand"), ".class.", size), text(dots, "_class"), text("Tool.Abs_", k), text("Lib.eq_", under, "_inst.eq"), text("HOL.equal", k), text("Own.t", size, ".con", k), text("a.k", k, "_class.x")]
    name = F.coalesce(*[F.when(k % 8 == i, x) for i, x in enumerate(kinds)], text("a.k", k - 1, ".x"))
    rows = t.part.select(name.alias("name"), (size % 10 == 0).alias("concealed"), F.lit(False).alias("hidden"), (size == 9).alias("preserved"), size.alias("origin"), (k % 16 == 1).alias("is_prop"), k.alias("place"), "p_type")
    said = rows.select(F.lit("constant").alias("what"), "name", "place", (F.col("place") % 50 != 7).alias("undo")).unionByName(rows.filter("place % 3 = 0").select(F.lit("constant").alias("what"), "name", (F.col("place") + 0.5).alias("place"), F.lit(True).alias("undo")))
    spark = t.spark
    prefixes = spark.createDataFrame([("HOL.equal",), ("Tool.",)], "prefix string")
    types = t.part.filter(F.col("p_type").startswith("PROMO")).select(text("Lib.", under).alias("name"))
    made = t.part.select(text("Own.t", size, ".").alias("prefix"))
    origins = t.part.filter("p_size % 4 = 1").select(size.alias("origin"))
    return helpers.constants(rows.drop("p_type"), said, prefixes, types, spark.createDataFrame([], "name string"), made, origins)
