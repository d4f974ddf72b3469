"""Queries of the site search: filters, phrases, words, both legs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.functions import vectors
from ferrule.operators import site
from ferrule.sources import shared

from .queries import Q15, Tables, query

# Of these queries: kinds, and a phrase that must not stand in any field.
KINDS = ("en", "de", "es")
EXCLUDED = ("the", "the")
MASK = """m AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'de', 'es') AND NOT coalesce(contains(' ' || lower(text) || ' ', ' the the ') OR contains(' ' || source || ' ', ' the the '), false)
AND NOT coalesce(contains(' ' || source || ' ', ' src3 '), false))"""
PARTS = """d AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS tf FROM d WHERE w <> '' GROUP BY ALL), n AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
a AS (SELECT count(*) AS docs, avg(len) AS mean FROM n), q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE w <> ''), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
s AS (SELECT item_id, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM q JOIN tf USING (w) JOIN df USING (w) JOIN n USING (doc_id), a GROUP BY ALL)"""


def words(text: str):
    return F.split(F.lower(text), " ")


def indexed(t: Tables, name: str, **what: bool) -> site.Index:
    return site.build(t.documents.select(F.col("doc_id").alias("doc"), words("text").alias("words")), shared.tables(t.spark, name), **what)


def asked(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query"), words("text").alias("words"))


def mask(t: Tables) -> DataFrame:
    """Documents of three kinds without a phrase in any field, and without one source."""
    fields = {"text": words("text"), "name": F.split("source", " ")}
    conditions = [site.Condition(site.ALL, EXCLUDED, True), site.Condition("name", ("src3",), True)]
    held = site.predicate(conditions, fields, F.col("lang"), KINDS, {"text": F.lower("text")})
    return t.documents.filter(held).select(F.col("doc_id").alias("doc"))


@query(f"WITH {PARTS} SELECT item_id, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM s) WHERE r <= 10")
def bm25_pruned(t: Tables) -> DataFrame:
    """The best ten documents of all languages for each item, with blocks and words left out by their bounds."""
    found = site.best_words(indexed(t, "site-words", positions=False), asked(t), 10)
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("score", 4).alias("score"))


@query(f"WITH {MASK} SELECT doc_id FROM m")
def site_filter(t: Tables) -> DataFrame:
    return mask(t).withColumnRenamed("doc", "doc_id")


@query("""WITH p AS (SELECT item_id, array_to_string(list_slice(list_filter(string_split(lower(text), ' '), lambda x: true), 2, 4), ' ') AS p, len(string_split(text, ' ')) AS n FROM benchmark)
SELECT item_id, doc_id FROM p JOIN documents ON n >= 4 AND contains(' ' || lower(text) || ' ', ' ' || p || ' ')""")
def phrase_hits(t: Tables) -> DataFrame:
    """Documents with the second to the fourth word of an item side by side, by positions."""
    phrase = asked(t).filter(F.size("words") >= 4).select("query", F.slice("words", 2, 3).alias("words"))
    return site.phrases(indexed(t, "site-phrases", impacts=False), phrase).select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"))


@query(f"""WITH {MASK}, {PARTS}, l AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM s WHERE doc_id IN (SELECT doc_id FROM m)),
e AS MATERIALIZED (SELECT vec_id, {Q15} AS q FROM embeddings),
v AS (SELECT a.vec_id AS item_id, b.vec_id AS doc_id, list_sum(list_transform(list_zip(b.q, a.q), lambda t: CAST(floor((t[1] * t[2] + 16384) / 32768.0) AS BIGINT))) AS dot FROM e a JOIN benchmark ON a.vec_id = item_id JOIN e b ON b.vec_id IN (SELECT doc_id FROM m)),
k AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY dot DESC, doc_id) AS r FROM v),
f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS rrf FROM (SELECT * FROM l WHERE r <= 200 UNION ALL SELECT * FROM k WHERE r <= 200) GROUP BY ALL)
SELECT item_id, doc_id, round(rrf, 10) AS rrf, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, doc_id) AS rank FROM f) WHERE rank <= 200""")
def site_search(t: Tables) -> DataFrame:
    """All items by words and vectors, over the filter's documents alone."""
    q = t.embeddings.select(F.col("vec_id").alias("doc"), vectors.encode_q15(F.col("embedding")).alias("q"))
    queries = asked(t).join(q.withColumnRenamed("doc", "query"), "query", "left")
    found = site.hybrid(indexed(t, "site-both", positions=False), q, queries, mask(t))
    return found.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), F.round("rrf", 10).alias("rrf"), "rank")
