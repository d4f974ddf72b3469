"""Queries of versions and of functions that users define."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions import user
from ferrule.sources import ranges, shared, snapshot

from .queries import Tables, query

NEW = "n AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 97 = 5 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 389 <> 7 UNION ALL SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id % 211 = 3)"


def versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents' figures, and the same after some changed, some went and some stand twice."""
    old = t.documents.select("doc_id", "lang", "source", "n_chars")
    key = F.col("doc_id")
    new = old.filter(key % 389 != 7).withColumn("n_chars", F.when(key % 97 == 5, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return old, new.unionByName(old.filter(key % 211 == 3))


@query(f"""WITH {NEW}, o AS (SELECT doc_id // 20 AS node, list((doc_id, lang, source, n_chars) ORDER BY doc_id, n_chars) AS r FROM documents GROUP BY 1), p AS (SELECT doc_id // 20 AS node, list((doc_id, lang, source, n_chars) ORDER BY doc_id, n_chars) AS r FROM n GROUP BY 1)
SELECT node, CASE WHEN o.r IS NULL THEN 'added' WHEN p.r IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN p USING (node) WHERE o.r IS DISTINCT FROM p.r""")
def changed_ranges(t: Tables) -> DataFrame:
    """Ranges of twenty keys in which two versions differ."""
    old, new = versions(t)
    leaf, save = ranges.by_number(F.col("doc_id"), 20), [shared.tables(t.spark, f"tree-{x}") for x in ("old", "new", "differ")]
    return ranges.changed(ranges.tree(old, leaf, 3, save[0]), ranges.tree(new, leaf, 3, save[1]), save[2])


@query("""WITH j AS (SELECT '{"doc_id":' || doc_id || CASE WHEN lang IS NULL THEN '' ELSE ',"lang":"' || lang || '"' END || CASE WHEN n_chars IS NULL THEN '' ELSE ',"n_chars":' || n_chars END || CASE WHEN source IS NULL THEN '' ELSE ',"source":"' || source || '"' END || '}' AS j FROM documents),
h AS (SELECT ('0x' || substr(sha256(j), 1, 15))::BIGINT AS a, ('0x' || substr(sha256(j), 16, 15))::BIGINT AS b FROM j)
SELECT format('{:x}-{:x}-{}', sum(a)::HUGEINT, sum(b)::HUGEINT, count(*)) AS digest FROM h""")
def table_digest(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(snapshot.digest(versions(t)[0]),)], "digest string")


@query("SELECT l_linestatus, l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(var_pop(l_extendedprice), 2) AS variance FROM lineitem GROUP BY ALL")
def merged_moments(t: Tables) -> DataFrame:
    """An aggregate of the user's, by states that merge."""
    out = user.aggregated(t.lineitem, ["l_linestatus", "l_returnflag"], "l_extendedprice", user.Moments(), "m")
    return out.select("l_linestatus", "l_returnflag", "m.n", F.round("m.mean", 4).alias("mean"), F.round("m.variance", 2).alias("variance"))


@query("""SELECT p_brand, CASE WHEN min(p_type) IS NULL THEN NULL ELSE (SELECT coalesce(max(substr(low, 1, i)), '') FROM (SELECT unnest(range(1, length(low) + 1)) AS i) WHERE substr(low, 1, i) = substr(high, 1, i)) END AS prefix
FROM (SELECT p_brand, p_type, min(p_type) OVER w AS low, max(p_type) OVER w AS high FROM part WINDOW w AS (PARTITION BY p_brand)) GROUP BY p_brand, low, high""")
def shared_prefixes(t: Tables) -> DataFrame:
    """The text with which all types of a brand begin."""
    return user.aggregated(t.part, ["p_brand"], "p_type", user.SharedPrefix(), "prefix")


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), i AS (SELECT item_id, w, unnest(range(0, len(w) - 2)) AS place FROM w)
SELECT w[place + 1] AS w1, w[place + 2] AS w2, w[place + 3] AS w3, count(*) AS n, min(place)::INT AS first FROM i GROUP BY ALL""")
def lateral_grams(t: Tables) -> DataFrame:
    """A table function of the user's in a lateral join: runs of three words in all items."""
    user.register(t.spark)
    return t.spark.sql("SELECT w1, w2, w3, count(*) AS n, min(place) AS first FROM {items}, LATERAL grams(text, 3) GROUP BY w1, w2, w3", items=t.benchmark)
