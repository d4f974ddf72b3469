"""Line dedup by distinct-site spread: boilerplate is what stands on many sites.

A line is known by the hash of its trimmed text. HyperLogLog sketches of the sites (sources) on
which it stands are merged by aggregation, so a line on a third of all rows costs a sketch for each
task. Lines whose estimate is within `BAND` of `MIN_SITES` get exact distinct counts; the others are
decided by their estimates, which are off by less than that by many standard errors (1.6 %). Lines on
`MIN_SITES` sites or more are taken out of all documents; the rest keeps its order.

Defined cases: null text has no lines and stays null; blank lines count as lines and always stay; a
null source is no site; equal rows give equal rows; a line on just as many sites as asked for goes;
texts and lines of any length are read whole; an empty table gives an empty result; other
columns are kept by `remove`, but that n_lines and n_removed take the place of columns with their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import Workspace, fresh, read

MIN_SITES = 10
BAND = 0.25
LG_K = 12


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def spread(lines: DataFrame) -> DataFrame:
    """(line, site) to (line, sketch, estimate)."""
    return lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch")).withColumn("estimate", F.hll_sketch_estimate("sketch"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """(line): hashes of the lines on `min_sites` sites or more."""
    work = Workspace(docs.sparkSession, "lines")
    lines = docs.filter("text is not null and source is not null").select(F.col("source").alias("site"), F.explode(F.transform(split_lines(F.col("text")), lambda x: F.trim(x))).alias("text"))
    lines = lines.filter("text <> ''").select("site", F.xxhash64("text").alias("line"))
    wide = work.save(spread(lines).filter(F.col("estimate") >= min_sites * (1 - band)).select("line", "estimate"), "wide")
    near = wide.filter(F.col("estimate") <= min_sites * (1 + band)).select("line")
    exact = lines.join(near, "line").distinct().groupBy("line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites).select("line")
    return work.save(wide.filter(F.col("estimate") > min_sites * (1 + band)).select("line").union(exact), "boilerplate")


def remove(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """All columns; text without boilerplate lines, n_lines and n_removed."""
    bad = boilerplate(docs, min_sites, band)
    key, gone = fresh(docs, "_key"), fresh(docs, "_gone")
    keyed = docs.withColumn(key, F.xxhash64("text"))
    rows = docs.filter("text is not null").select("doc_id", F.xxhash64("text").alias("_h"), F.posexplode(F.transform(split_lines(F.col("text")), lambda x: F.xxhash64(F.trim(x)))).alias("_at", "line"))
    hits = rows.join(bad, "line", "left_semi").groupBy(F.col("doc_id").alias("_i"), "_h").agg(F.collect_set("_at").alias(gone))
    out = keyed.join(hits, keyed["doc_id"].eqNullSafe(hits["_i"]) & (keyed[key] == hits["_h"]), "left").select(*[keyed[f"`{c}`"] for c in docs.columns], hits[gone])
    lines = split_lines(F.col("text"))
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n"))
    n = F.coalesce(F.size(lines), F.lit(0))
    out = out.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(n).cast("long"), "n_removed": F.greatest(F.coalesce(F.size(gone), F.lit(0)).cast("long"), F.lit(0).cast("long"))})
    return out.withColumn("text", kept).drop(gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("text_md5"), F.length("text").cast("long").alias("text_chars"))


SQL = r"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS at FROM documents WHERE text IS NOT NULL),
b AS (SELECT trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> '' AND source IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) >= 10),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(b.line) AS n_removed, coalesce(string_agg(l.line, chr(10) ORDER BY l.at) FILTER (b.line IS NULL), '') AS t
      FROM l LEFT JOIN b ON trim(l.line, ' ') = b.line GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, md5(k.t) AS text_md5, length(k.t)::BIGINT AS text_chars
FROM documents d LEFT JOIN k USING (doc_id)
"""
