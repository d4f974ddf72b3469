"""Queries of store upkeep and ranking, each with its SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import vectors
from ferrule.operators import maintenance as m

from .queries import Q15, Tables, query


@query("""WITH e AS (SELECT l_orderkey, min(l_suppkey) AS s_suppkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12))),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY l_orderkey) AS r FROM e)
SELECT s_suppkey, count(*) AS n, string_agg(CAST(l_orderkey AS VARCHAR), ',' ORDER BY l_orderkey) FILTER (r <= 3) AS samples FROM r GROUP BY s_suppkey""")
def orphan_groups(t: Tables) -> DataFrame:
    return m.orphan_groups(t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("s_suppkey")), "l_orderkey", "s_suppkey", t.supplier.filter("s_nationkey < 12"))


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) GROUP BY c_nationkey")
def registry_gaps(t: Tables) -> DataFrame:
    return m.registry_gaps(t.customer, "c_nationkey", t.nation.filter("n_regionkey <> 2").withColumnRenamed("n_nationkey", "c_nationkey"))


@query("""WITH u AS (SELECT source, doc_id, doc_id % 8 = 0 AS deleted FROM documents WHERE doc_id % 4 = 0), s AS (SELECT source, doc_id FROM documents WHERE doc_id % 3 <> 0),
b AS (SELECT coalesce(u.source, s.source) AS source, u.doc_id IS NOT NULL AND NOT u.deleted AS is_user, s.doc_id IS NOT NULL AND (u.doc_id IS NULL OR NOT u.deleted) AS is_system, coalesce(u.deleted, false) AS gone FROM u FULL JOIN s ON u.doc_id = s.doc_id),
c AS (SELECT source, sum(is_user::INT)::BIGINT AS n_user, sum(is_system::INT)::BIGINT AS n_system, sum(gone::INT)::BIGINT AS n_gone FROM b GROUP BY source)
SELECT *, CASE WHEN n_user > 0 AND n_system > 0 THEN 'system+user' WHEN n_system > 0 THEN 'system' WHEN n_user > 0 THEN 'user' ELSE 'removed' END AS label FROM c""")
def layer_labels(t: Tables) -> DataFrame:
    u = t.documents.filter("doc_id % 4 = 0").select("doc_id", F.col("source").alias("u_source"), (F.col("doc_id") % 8 == 0).alias("deleted"))
    s = t.documents.filter("doc_id % 3 <> 0").select("doc_id", F.col("source").alias("s_source"), F.lit(True).alias("in_system"))
    b = u.join(s, "doc_id", "full").withColumn("source", F.coalesce("u_source", "s_source"))
    live = F.coalesce(~F.col("deleted"), F.lit(True))
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    c = b.groupBy("source").agg(count(~F.col("deleted")).alias("n_user"), count(F.col("in_system") & live).alias("n_system"), count(F.col("deleted")).alias("n_gone"))
    label = F.when((F.col("n_user") > 0) & (F.col("n_system") > 0), "system+user").when(F.col("n_system") > 0, "system").when(F.col("n_user") > 0, "user").otherwise("removed")
    return c.withColumn("label", label)


@query("""WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_name END AS name, p_size AS ts FROM part WHERE p_partkey % 2 = 0),
i AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_brand ELSE p_name END AS name, p_size + p_partkey % 4 - 1 AS ts FROM part WHERE p_partkey % 3 = 0),
b AS (SELECT i.p_partkey, l.name AS ln, l.ts AS lt, i.name AS n, i.ts AS t, CASE WHEN l.p_partkey IS NULL OR l.name IS NULL THEN 'add' WHEN l.name <> i.name THEN 'conflict' WHEN i.ts > l.ts THEN 'refresh' ELSE 'keep' END AS action FROM i LEFT JOIN l USING (p_partkey))
SELECT p_partkey, action, CASE WHEN action IN ('add', 'refresh') THEN n ELSE ln END AS name, (CASE WHEN action IN ('add', 'refresh') THEN t ELSE lt END)::BIGINT AS ts FROM b""")
def registry_plan(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("long")
    local = t.part.filter("p_partkey % 2 = 0").select("p_partkey", F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")).alias("name"), size.alias("ts"))
    incoming = t.part.filter("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_brand")).otherwise(F.col("p_name")).alias("name"), (size + F.col("p_partkey") % 4 - 1).alias("ts"))
    return m.registry_plan(local, incoming, "p_partkey")


@query("""WITH l AS (SELECT p_partkey, p_size AS v FROM part WHERE p_partkey % 2 = 0), i AS (SELECT p_partkey, p_size + (p_partkey % 7 = 0)::INT AS v FROM part WHERE p_partkey % 3 <> 1)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CASE WHEN i.v IS NULL THEN 'drop' WHEN l.v IS NULL THEN 'add' WHEN l.v = i.v THEN 'identical' ELSE 'update' END
ELSE CASE WHEN i.v IS NULL THEN 'local' WHEN l.v IS NULL THEN 'add' WHEN l.v = i.v THEN 'identical' ELSE 'keep_local' END END AS action FROM l FULL JOIN i USING (p_partkey)""")
def vector_plan(t: Tables) -> DataFrame:
    local = t.part.filter("p_partkey % 2 = 0").select("p_partkey", F.col("p_size").alias("value"))
    incoming = t.part.filter("p_partkey % 3 <> 1").select("p_partkey", (F.col("p_size") + (F.col("p_partkey") % 7 == 0).cast("int")).alias("value"))
    return m.vector_plan(local, incoming, t.part.filter("p_partkey % 5 = 0"), "p_partkey")


@query("""WITH a AS (SELECT p.p_partkey, coalesce(q.k, p.p_partkey) AS "to" FROM part p LEFT JOIN (SELECT p_partkey, p_partkey // 3 * 2 AS k FROM part WHERE p_partkey % 4 = 0) q USING (p_partkey))
SELECT *, count(*) OVER (PARTITION BY "to") > 1 AS collides FROM a""")
def rekey_map(t: Tables) -> DataFrame:
    mapping = t.part.filter("p_partkey % 4 = 0").select("p_partkey", (F.floor(F.col("p_partkey") / 3) * 2).alias("k"))
    return m.rekey(t.part.select("p_partkey"), "p_partkey", mapping, "k")


@query(r"""WITH r AS (SELECT p_partkey, p_brand, p_type, CASE WHEN p_partkey % 3 = 0 THEN p_name || '(' || p_size || ')' ELSE p_name END AS name, CASE WHEN p_partkey % 3 = 1 THEN p_partkey END AS position FROM part),
d AS (SELECT p_brand, p_type, arg_min(name, position) AS dn, min(position) AS dp FROM r WHERE position IS NOT NULL GROUP BY ALL)
SELECT p_partkey, p_brand, p_type, name, position, CASE WHEN position IS NULL AND regexp_matches(name, '^.*\(\d+\)$') AND dp IS NOT NULL THEN dn ELSE name END AS new_name,
CASE WHEN position IS NULL AND regexp_matches(name, '^.*\(\d+\)$') AND dp IS NOT NULL THEN dp ELSE position END AS new_position FROM r LEFT JOIN d USING (p_brand, p_type)""")
def rename_siblings(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    rows = t.part.select(key, "p_brand", "p_type", F.when(key % 3 == 0, F.concat("p_name", F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).otherwise(F.col("p_name")).alias("name"), F.when(key % 3 == 1, key).alias("position"))
    return m.rename_siblings(rows, ["p_brand", "p_type"], "name", "position")


@query("""SELECT user_id, arg_min(event_id, {'a': g IS NULL, 'b': coalesce(g, 0), 'c': coalesce(w, -1), 'd': event_id}) AS event_id
FROM (SELECT user_id, event_id, CASE WHEN event_type = 'click' THEN event_id % 10 END AS g, CASE WHEN event_id % 3 > 0 THEN event_id % 7 END AS w FROM events) GROUP BY user_id""")
def dominance(t: Tables) -> DataFrame:
    i = F.col("event_id")
    return m.dominant(t.events.select("user_id", i, F.when(F.col("event_type") == "click", i % 10).alias("g"), F.when(i % 3 > 0, i % 7).alias("w")), "user_id", "g", "w", "event_id")


@query("""SELECT p_partkey, (CASE WHEN p_size % 4 <> 0 AND p_partkey % 7 <> 0 AND p_size <> p_partkey % 50 THEN 1 + (SELECT max(p_size) FROM part) ELSE p_size END)::BIGINT AS version,
p_size % 4 <> 0 AND p_partkey % 7 <> 0 AND p_size <> p_partkey % 50 AS bumped FROM part""")
def version_bump(t: Tables) -> DataFrame:
    size, key = F.col("p_size").cast("long"), F.col("p_partkey")
    top = t.part.agg(F.max(F.col("p_size").cast("long")).alias("counter"))  # one row
    stored = t.part.select(key, F.when(key % 7 != 0, size).alias("digest"), size.alias("version"), (size % 4 != 0).alias("tracked")).crossJoin(F.broadcast(top))
    return m.bump_versions(stored, t.part.select(key, (key % 50).alias("now")), "p_partkey", F.col("counter"))


@query("""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer QUALIFY r <= 200), b AS (SELECT c_custkey, row_number() OVER (ORDER BY c_name DESC, c_custkey) AS r FROM customer QUALIFY r <= 200)
SELECT c_custkey, round(sum(s), 9) AS score FROM (SELECT c_custkey, 0.5::DOUBLE * pow(0.62::DOUBLE, log2(r + 1)) AS s FROM a UNION ALL SELECT c_custkey, 0.5::DOUBLE * pow(0.62::DOUBLE, log2(r + 1)) FROM b) GROUP BY c_custkey""")
def mesh_rankings(t: Tables) -> DataFrame:
    def leg(*order):  # the best 200 by a distributed top-k; only they are numbered
        few = t.customer.orderBy(*order).limit(200)
        return few.withColumn("r", F.row_number().over(Window.orderBy(*order)))

    return m.mesh([(leg(F.desc("c_acctbal"), "c_custkey"), 0.5), (leg(F.desc("c_name"), "c_custkey"), 0.5)], "c_custkey", "r")


@query("""WITH n AS (SELECT s_name AS name, md5(CAST(s_suppkey AS VARCHAR)) AS hex FROM supplier),
q AS (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN 'Supplier#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') ELSE substring(md5(CAST(p_partkey AS VARCHAR)), 1, (1 + p_partkey % 4)::INT) END AS asked FROM part),
c AS (SELECT asked, (SELECT count(*) FROM n WHERE n.name = asked) AS a, (SELECT min(hex) FROM n WHERE n.name = asked) AS ah, (SELECT count(*) FROM n WHERE starts_with(n.hex, asked)) AS b, (SELECT min(hex) FROM n WHERE starts_with(n.hex, asked)) AS bh FROM q)
SELECT asked, CASE WHEN a = 1 THEN 'name' WHEN a > 1 THEN 'ambiguous' WHEN b = 1 THEN 'prefix' WHEN b > 1 THEN 'ambiguous' ELSE 'missing' END AS state, CASE WHEN a = 1 THEN ah WHEN a = 0 AND b = 1 THEN bh END AS hex FROM c""")
def resolve_identifiers(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    asked = t.part.select(F.when(k % 3 == 0, F.concat(F.lit("Supplier#"), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.md5(k.cast("string")).substr(F.lit(1), (1 + k % 4).cast("int"))).alias("asked")).distinct()
    return m.resolve(t.supplier.select(F.col("s_name").alias("name"), F.md5(F.col("s_suppkey").cast("string")).alias("hex")), asked)


@query("SELECT d.doc_id, CASE WHEN e.vec_id IS NOT NULL THEN round(e.embedding[1]::DOUBLE, 6) WHEN d.lang = 'en' THEN 0.05::DOUBLE ELSE 0.03::DOUBLE END AS score FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id ORDER BY score DESC, doc_id LIMIT 100")
def default_scores(t: Tables) -> DataFrame:
    scored = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("score"))
    return m.final_scores(t.documents.select("doc_id", "lang"), scored, "doc_id", F.when(F.col("lang") == "en", 0.05).otherwise(0.03), 100).select("doc_id", "score")


@query(f"WITH e AS MATERIALIZED (SELECT vec_id, {Q15} AS q FROM embeddings) SELECT vec_id, round(sqrt(list_sum(list_transform(q, lambda x: (x::DOUBLE / 32768.0) * (x::DOUBLE / 32768.0)))), 6) AS norm FROM e")
def q15_norm(t: Tables) -> DataFrame:
    q = t.embeddings.select("vec_id", vectors.encode_q15(F.col("embedding")).alias("q"))
    square = lambda a, x: a + (x.cast("double") / 32768.0) * (x.cast("double") / 32768.0)
    return q.select("vec_id", F.round(F.sqrt(F.aggregate("q", F.lit(0.0), square)), 6).alias("norm"))


@query("SELECT w AS token, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w")
def document_frequency(t: Tables) -> DataFrame:
    return t.part.select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


FIELDS = "contains(' ' || p_name || ' ', ' blue ') OR contains(' ' || p_type || ' ', ' BRUSHED ') OR contains(' ' || p_brand || ' ', ' Brand#13 ')"


@query(f"SELECT p_partkey, CASE WHEN {FIELDS} THEN 'any' ELSE 'none' END AS fields FROM part WHERE p_size IN (1, 2, 3, 5, 8, 13, 21)")
def fields_any_none(t: Tables) -> DataFrame:
    """Kinds are or-ed, conditions and-ed; a condition on all fields is an or, its exclusion the negation of that or."""
    holds = F.array_contains(F.split("p_name", " "), "blue") | F.array_contains(F.split("p_type", " "), "BRUSHED") | F.array_contains(F.split("p_brand", " "), "Brand#13")
    return t.part.filter(F.col("p_size").isin(1, 2, 3, 5, 8, 13, 21)).select("p_partkey", F.when(holds, "any").otherwise("none").alias("fields"))


@query("SELECT event_id, strftime(ts, '%Y.%m.%d.%H%M') AS version, ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAY AS expired FROM events")
def version_and_expiry(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("ts").alias("last"))  # one row
    return t.events.crossJoin(F.broadcast(last)).select("event_id", F.date_format("ts", "yyyy.MM.dd.HHmm").alias("version"), (F.col("ts") < F.col("last") - F.expr("INTERVAL 3 DAYS")).alias("expired"))


@query("""SELECT l_orderkey, bool_and(l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 20)) AS ships FROM lineitem GROUP BY l_orderkey""")
def ship_filter(t: Tables) -> DataFrame:
    """A key of many constituents ships only if all of them are persistent."""
    lasting = t.supplier.filter("s_nationkey < 20").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("p"))
    return t.lineitem.select("l_orderkey", "l_suppkey").join(lasting, "l_suppkey", "left").groupBy("l_orderkey").agg(F.bool_and(F.coalesce("p", F.lit(False))).alias("ships"))
