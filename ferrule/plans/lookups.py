"""Queries of lookups with filters made at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators import runtime
from ferrule.sources import shared

from .queries import Tables, query


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE 'PROMO%' AND p_size < 10)")
def lines_of_few_parts(t: Tables) -> DataFrame:
    few = t.part.filter("p_type like 'PROMO%' and p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return runtime.semi(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), few, ["l_partkey"])


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT p_partkey * 2 FROM part UNION ALL SELECT n_nationkey FROM nation UNION ALL SELECT vec_id FROM embeddings)""")
def outside_five_lists(t: Tables) -> DataFrame:
    """Members that none of five lists has."""
    one = lambda df, c: df.select(c.alias("o_orderkey"))
    lists = [one(t.documents, F.col("doc_id")), one(t.supplier, F.col("s_suppkey")), one(t.part, F.col("p_partkey") * 2), one(t.nation, F.col("n_nationkey").cast("long")), one(t.embeddings, F.col("vec_id"))]
    return runtime.anti(t.orders.select("o_orderkey"), lists, ["o_orderkey"], shared.tables(t.spark, "lists"))


@query("""SELECT x.doc_id, d.doc_id IS NOT NULL AS visible, md5(d.source) AS said FROM (SELECT DISTINCT doc_id * 2 AS doc_id FROM labels) x LEFT JOIN documents d USING (doc_id)""")
def available_keys(t: Tables) -> DataFrame:
    """Asked-for records, whether they are there, and what is kept of them."""
    asked = t.labels.select((F.col("doc_id") * 2).alias("doc_id"))
    return runtime.available(asked, t.documents, ["doc_id"], t.documents.select("doc_id", F.md5("source").alias("said")))
