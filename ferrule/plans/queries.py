"""Queries over the given tables, each with its SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import text, vectors
from ferrule.operators import index, ordering, relational
from ferrule.sources import layers, shared
from ferrule.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def user(self) -> DataFrame:
        """User layer: every fourth document; every eighth a tombstone."""
        return self.documents.filter("doc_id % 4 = 0").select("doc_id", F.concat(F.lit("user:"), "text").alias("name"), "lang", (F.col("doc_id") % 8 == 0).alias("deleted"))

    def system(self) -> DataFrame:
        return self.documents.filter("doc_id % 3 <> 0").select("doc_id", F.concat(F.lit("sys:"), "text").alias("name"), "lang")

    def view(self) -> DataFrame:
        return layers.layered(self.user(), self.system(), "doc_id")


VIEW = """u AS (SELECT doc_id, 'user:' || text AS name, lang, doc_id % 8 = 0 AS deleted FROM documents WHERE doc_id % 4 = 0),
s AS (SELECT doc_id, 'sys:' || text AS name, lang FROM documents WHERE doc_id % 3 <> 0),
v AS (SELECT doc_id, name, lang FROM u WHERE NOT deleted UNION ALL SELECT doc_id, name, lang FROM s WHERE doc_id NOT IN (SELECT doc_id FROM u))"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


Q15 = "list_transform(embedding, lambda x: CAST(round_even(0.95::DOUBLE * (x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-12)) * 32768.0, 0) AS INTEGER))"


@query(f"""WITH e AS MATERIALIZED (SELECT vec_id, {Q15} AS q FROM embeddings),
d AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(b.q, a.q), lambda t: CAST(floor((t[1] * t[2] + 16384) / 32768.0) AS BIGINT))) AS dot FROM e a JOIN e b ON a.vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, dot::DOUBLE / 29573.12::DOUBLE)) AS score FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM r)
SELECT query_id, vec_id, round(score, 9) AS score, rank::INTEGER AS rank FROM k WHERE rank <= 10""")
def top_k(t: Tables) -> DataFrame:
    q = t.embeddings.select("vec_id", vectors.encode_q15(F.col("embedding")).alias("q"))
    return relational.top_k(q, q.filter("vec_id % 20 = 0"), 10).withColumn("score", F.round("score", 9))


@query(SQL["top_k"])
def top_k_all_due(t: Tables) -> DataFrame:
    """The search of top_k for every query that is due."""
    q = t.embeddings.select("vec_id", vectors.encode_q15(F.col("embedding")).alias("q"))
    return relational.top_k(q, q.filter("vec_id % 20 = 0"), 10).withColumn("score", F.round("score", 9))


@query(f"SELECT vec_id, list_sum({Q15})::BIGINT AS total, {Q15}[1]::INTEGER AS first FROM embeddings")
def encode_q15(t: Tables) -> DataFrame:
    q = t.embeddings.select("vec_id", vectors.encode_q15(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.element_at("q", 1).alias("first"))


@query(f"WITH {VIEW} SELECT * FROM v")
def layered_view(t: Tables) -> DataFrame:
    return t.view()


@query(f"WITH {VIEW}, k AS (SELECT doc_id AS pos, doc_id * 2 AS doc_id FROM documents) SELECT pos, k.doc_id, v.name, v.lang, v.doc_id IS NOT NULL AS found FROM k LEFT JOIN v USING (doc_id)")
def multi_get(t: Tables) -> DataFrame:
    keys = t.documents.select(F.col("doc_id").alias("pos"), (F.col("doc_id") * 2).alias("doc_id"))
    return layers.multi_get(keys, t.view(), "doc_id")


@query(f"WITH {VIEW} SELECT * FROM v WHERE doc_id = 5")
def point_get(t: Tables) -> DataFrame:
    return t.view().filter("doc_id = 5")


@query(f"WITH {VIEW} SELECT * FROM v WHERE starts_with(name, 'user:T')")
def prefix_scan(t: Tables) -> DataFrame:
    return layers.prefix_scan(t.view(), "name", "user:T")


@query("SELECT d.doc_id, CASE WHEN e.vec_id IS NULL THEN 'missing' WHEN e.label = 0 THEN 'skipped' ELSE 'kept' END AS state FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def gather_vectors(t: Tables) -> DataFrame:
    v = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.when(F.col("label") == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("e"))
    return layers.gather(t.documents, v, "doc_id", "e", 64).select("doc_id", "state")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(event_type, event_id) = 'error' AS deleted FROM events GROUP BY user_id")
def upsert_compaction(t: Tables) -> DataFrame:
    log = t.events.select("user_id", "event_id", "event_type", (F.col("event_type") == "error").alias("deleted"))
    return layers.compact(log, "user_id", "event_id")


@query(f"WITH {VIEW}, n AS (SELECT doc_id, 'q' || quality AS lang FROM labels) SELECT v.doc_id, v.name, n.lang, false AS deleted FROM v JOIN n USING (doc_id)")
def copy_up(t: Tables) -> DataFrame:
    return layers.copy_up(t.view(), t.labels.select("doc_id", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("lang")), "doc_id", "lang")


@query("SELECT l.doc_id, m.lang AS model, true AS deleted FROM labels l CROSS JOIN (SELECT DISTINCT lang FROM documents) m WHERE l.toxic = 1")
def invalidate_vectors(t: Tables) -> DataFrame:
    return layers.invalidate(t.labels.filter("toxic = 1").select("doc_id"), t.documents.select(F.col("lang").alias("model")).distinct())


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS with_k FROM events GROUP BY event_type")
def json_decode(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").isNotNull().cast("long")).alias("with_k"))


@query("SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND contains(lower(source), 'src1') AND NOT contains(text, 'License')")
def context_filter(t: Tables) -> DataFrame:
    return t.documents.filter(F.col("lang").isin("en", "de") & F.lower("source").contains("src1") & ~F.col("text").contains("License")).select("doc_id", "lang", "source")


@query("""WITH w AS (SELECT item_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark),
n AS (SELECT DISTINCT string_split(text, ' ')[1:4] AS w, array_to_string(string_split(text, ' ')[1:4], ' ') AS needle FROM benchmark WHERE len(string_split(text, ' ')) >= 4)
SELECT d.doc_id, n.needle FROM documents d, n WHERE contains(' ' || d.text || ' ', ' ' || n.needle || ' ')""")
def token_sequence(t: Tables) -> DataFrame:
    """Documents that hold the first four words of a benchmark item next to each other, in order: every item, whole texts."""
    words = F.split("text", " ")
    needles = t.benchmark.filter(F.size(words) >= 4).select(F.slice(words, 1, 4).alias("w")).distinct()
    return text.find_sequences(t.documents.select("doc_id", words.alias("h")), "doc_id", needles, 4).select("doc_id", F.array_join("w", " ").alias("needle"))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING bool_and(l_suppkey % 3 <> 0)")
def set_containment(t: Tables) -> DataFrame:
    loaded = t.supplier.filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return relational.contained(t.lineitem.select("l_orderkey", "l_suppkey"), loaded, "l_orderkey", "l_suppkey")


INDEXED = "SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN l_suppkey END AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"


def size(t: Tables) -> int | None:
    """Tasks for the index of orders; the rows stand in the files' footers."""
    return index.tasks(t.spark, t.orders.count() + t.lineitem.count())


def entries(t: Tables) -> DataFrame:
    """Orders by supplier, as often as lines say so; every thirteenth has an empty list of constituents and is always available."""
    n = size(t)
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    rows = index.dealt(t.orders.select("o_orderkey"), "o_orderkey", n).join(index.dealt(lines, "o_orderkey", n), "o_orderkey", "left")
    return rows.select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("l_suppkey")).alias("part"))


def postings(t: Tables) -> DataFrame:
    return index.of_entries(entries(t), "o_orderkey", "part")


@query(f"SELECT DISTINCT o_orderkey FROM ({INDEXED}) WHERE s IS NULL OR s IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)")
def index_candidates(t: Tables) -> DataFrame:
    return index.candidates(entries(t), t.supplier.filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("part")))


@query(f"SELECT s AS part, count(DISTINCT o_orderkey) AS n, min(o_orderkey) AS low FROM ({INDEXED}) GROUP BY s")
def index_rebuild(t: Tables) -> DataFrame:
    return postings(t).groupBy("part").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"))


@query(f"""WITH i AS (SELECT DISTINCT o_orderkey, s FROM ({INDEXED})), a AS (SELECT c_custkey AS o_orderkey, c_nationkey AS s FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 5 = 1)
SELECT o_orderkey, s AS part FROM (SELECT * FROM i UNION SELECT * FROM a) WHERE o_orderkey % 7 <> 2""")
def index_update(t: Tables) -> DataFrame:
    """Entries added twice stand once; removed keys lose all their entries."""
    c, n = F.col("c_custkey"), size(t)
    more = t.customer.filter(c % 5 < 2).select(c.alias("o_orderkey"), F.when(c % 5 == 0, F.array(F.col("c_nationkey").cast("long"))).otherwise(F.array().cast("array<bigint>")).alias("s"))
    both = index.add(index.add(postings(t), more, "o_orderkey", "s", n), more, "o_orderkey", "s", n)
    return index.remove(both, t.orders.filter("o_orderkey % 7 = 2").select("o_orderkey").union(t.customer.filter("c_custkey % 7 = 2").select("c_custkey")), "o_orderkey", n)


@query(f"""WITH i AS (SELECT DISTINCT o_orderkey FROM ({INDEXED}) WHERE o_orderkey % 3 = 0), r AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(i.o_orderkey, r.o_orderkey) AS o_orderkey, CASE WHEN r.o_orderkey IS NULL THEN 'dangling' ELSE 'unindexed' END AS state FROM i FULL JOIN r USING (o_orderkey) WHERE i.o_orderkey IS NULL OR r.o_orderkey IS NULL""")
def index_reconcile(t: Tables) -> DataFrame:
    return index.reconcile(postings(t).filter("o_orderkey % 3 = 0"), t.orders.filter("o_orderkey % 2 = 0").select("o_orderkey"), "o_orderkey", size(t))


@query("SELECT l_suppkey, count(DISTINCT l_orderkey) AS n, min(l_orderkey) AS low, max(l_orderkey) AS high FROM lineitem GROUP BY l_suppkey")
def posting_lists(t: Tables) -> DataFrame:
    pairs = t.lineitem.select("l_suppkey", "l_orderkey").distinct()
    return pairs.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.min("l_orderkey").alias("low"), F.max("l_orderkey").alias("high"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(t: Tables) -> DataFrame:
    return t.documents.select("doc_id").join(t.embeddings.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0 AND vec_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 4 = 0)")
def purge_vectors(t: Tables) -> DataFrame:
    return t.embeddings.filter("vec_id % 2 = 0").select("vec_id").join(t.user().select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query(f"WITH {VIEW} SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM v)")
def orphan_vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id").join(t.view().select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


@query("SELECT s_suppkey, coalesce(n_name, '?') AS name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey")
def registry_names(t: Tables) -> DataFrame:
    names = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return t.supplier.join(names, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.lit("?")).alias("name"))


@query("""SELECT doc_id, CASE WHEN b.quality IS NULL THEN 'added' WHEN a.toxic IS NULL THEN 'local-only' WHEN a.toxic = b.quality THEN 'identical' ELSE 'updated' END AS action
FROM (SELECT * FROM labels WHERE doc_id % 5 <> 0) a FULL JOIN (SELECT * FROM labels WHERE doc_id % 7 <> 0) b USING (doc_id)""")
def merge_plan(t: Tables) -> DataFrame:
    side = lambda m, c: t.labels.filter(f"doc_id % {m} <> 0").select("doc_id", F.col(c).alias("x"))
    return relational.merge_plan(side(5, "toxic"), side(7, "quality"), "doc_id", "x")


@query("SELECT lang, source, count(*) AS n, count_if(doc_id % 4 = 0 AND doc_id % 8 <> 0) AS in_user, count_if(doc_id % 3 <> 0 AND doc_id % 4 <> 0) AS in_system, count_if(doc_id % 8 = 0) AS tombstones FROM documents GROUP BY lang, source")
def layer_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_if(F.expr("doc_id % 4 = 0 and doc_id % 8 <> 0")).alias("in_user"), F.count_if(F.expr("doc_id % 3 <> 0 and doc_id % 4 <> 0")).alias("in_system"), F.count_if(F.expr("doc_id % 8 = 0")).alias("tombstones"))


@query("SELECT l_orderkey, bit_xor(l_partkey * 7919 + l_suppkey) AS xor FROM lineitem GROUP BY l_orderkey")
def xor_aggregate(t: Tables) -> DataFrame:
    return relational.xor_hashes(t.lineitem.select("l_orderkey", (F.col("l_partkey") * 7919 + F.col("l_suppkey")).alias("h")), "l_orderkey", "h")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS cost, max(event_id) AS last FROM events GROUP BY event_type")
def cost_sums(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("cost"), F.max("event_id").alias("last"))


@query("SELECT n_chars // 100 AS bin, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(t: Tables) -> DataFrame:
    return t.documents.groupBy(F.floor(F.col("n_chars") / 100).alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT lang, quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def contingency(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT c_name, c_mktsegment, count(*) AS n FROM (SELECT c_custkey % 50 AS c_name, c_mktsegment FROM customer) GROUP BY ALL HAVING count(*) > 1")
def name_collisions(t: Tables) -> DataFrame:
    return t.customer.select((F.col("c_custkey") % 50).alias("c_name"), "c_mktsegment").groupBy("c_name", "c_mktsegment").agg(F.count("*").alias("n")).filter("n > 1")


@query("""WITH w AS (SELECT unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS place FROM benchmark)
SELECT word, min(place)::INTEGER AS first, count(*) AS n FROM w GROUP BY word""")
def first_occurrence(t: Tables) -> DataFrame:
    return t.benchmark.select(F.posexplode(F.split("text", " ")).alias("at", "word")).groupBy("word").agg(F.min("at").alias("first"), F.count("*").alias("n"))


@query("SELECT lang, quantile_cont(n_chars, 0.25) AS p25, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.75) AS p75, max(n_chars) AS top, sum(n_chars)::BIGINT AS total, count_if(n_chars > 1000) AS over_1000 FROM documents GROUP BY lang")
def length_percentiles(t: Tables) -> DataFrame:
    p = F.percentile("n_chars", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = t.documents.groupBy("lang").agg(p.alias("p"), F.max("n_chars").alias("top"), F.sum("n_chars").alias("total"), F.count_if(F.col("n_chars") > 1000).alias("over_1000"))
    return out.select("lang", F.col("p")[0].alias("p25"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p75"), "top", "total", "over_1000")


@query("SELECT source, arg_min(doc_id, (lang, n_chars, doc_id)) AS pick, min(lang) AS lang FROM documents GROUP BY source")
def deterministic_pick(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.min(F.struct("lang", "n_chars", "doc_id")).alias("m")).select("source", F.col("m.doc_id").alias("pick"), "m.lang")


@query("SELECT o_custkey, o_orderkey, generation::INTEGER AS generation FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS generation FROM orders) WHERE generation <= 2")
def newest_generations(t: Tables) -> DataFrame:
    return layers.newest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")], 2).select("o_custkey", "o_orderkey", "generation")


@query("SELECT conv_id, turn, role FROM (SELECT *, lag(role) OVER w AS p, row_number() OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE r = 1 OR role IS DISTINCT FROM p")
def collapse_runs(t: Tables) -> DataFrame:
    return relational.runs(t.conversations.select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query("SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4)::BIGINT AS batch FROM conversations")
def batches(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return t.conversations.select("conv_id", "turn", F.floor(n / 4).alias("batch"))


@query("""WITH l AS (SELECT doc_id AS id, n_chars AS s FROM documents WHERE contains(text, 'the') ORDER BY s DESC, id LIMIT 200), r AS (SELECT doc_id AS id, quality * 1000 + doc_id % 997 AS s FROM labels ORDER BY s DESC, id LIMIT 200),
p AS (SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY s DESC, id)) AS part FROM l UNION ALL SELECT id, 1.0::DOUBLE / (60 + row_number() OVER (ORDER BY s DESC, id)) FROM r),
f AS (SELECT id, round(sum(part), 12) AS rrf FROM p GROUP BY id) SELECT * FROM f ORDER BY rrf DESC, id LIMIT 200""")
def rank_fusion(t: Tables) -> DataFrame:
    left = t.documents.filter(F.col("text").contains("the")).select(F.col("doc_id").alias("id"), F.col("n_chars").alias("s"))
    right = t.labels.select(F.col("doc_id").alias("id"), (F.col("quality") * 1000 + F.col("doc_id") % 997).alias("s"))
    return relational.reciprocal_ranks([left, right], "id", "s")


@query("SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS doc_id, max(n_chars) AS n_chars, array_to_string(list_sort(list_distinct(list(lang))), ',') AS kinds FROM documents GROUP BY source")
def group_collapse(t: Tables) -> DataFrame:
    return relational.best_per_group(t.documents, "source", "lang", "doc_id", "n_chars").withColumn("kinds", F.array_join("kinds", ","))


@query("WITH p AS (SELECT DISTINCT doc_id AS x FROM labels), g AS (SELECT x, x - row_number() OVER (ORDER BY x) AS g FROM p) SELECT min(x) AS low, max(x) AS high FROM g GROUP BY g")
def gaps_and_islands(t: Tables) -> DataFrame:
    return relational.islands(t.labels, "doc_id")


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_brand) = 1 THEN p_brand ELSE p_brand || '(' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) || ')' END AS name FROM part")
def member_names(t: Tables) -> DataFrame:
    rows = ordering.placed(t.part.select("p_brand", "p_partkey"), ["p_brand"], [F.col("p_partkey")], shared.tables(t.spark, "names"))
    return rows.select("p_partkey", ordering.member_name(F.col("p_brand")).alias("name"))


@query("SELECT o_orderstatus, o_orderkey, n::INTEGER AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 5")
def quotas(t: Tables) -> DataFrame:
    return layers.newest(t.orders, ["o_orderstatus"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).select("o_orderstatus", "o_orderkey", F.col("generation").alias("n"))


@query("SELECT source FROM documents WHERE lang = 'en' EXCEPT SELECT source FROM documents WHERE lang = 'es' AND n_chars > 5000")
def set_difference(t: Tables) -> DataFrame:
    return t.documents.filter("lang = 'en'").select("source").subtract(t.documents.filter("lang = 'es' and n_chars > 5000").select("source"))


@query("SELECT p_partkey, upper(p_brand) || ' ' || p_name || ': ' || CASE WHEN length(p_type) > 8 THEN substring(p_type, 1, 8) || '…' ELSE p_type END AS line, split_part(p_brand, '#', -1) AS base FROM part")
def pretty_print(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat(F.upper("p_brand"), F.lit(" "), F.col("p_name"), F.lit(": "), text.truncated(F.col("p_type"), 8)).alias("line"), F.substring_index("p_brand", "#", -1).alias("base"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+([^?#]*)", 1).alias("path"))


@query("SELECT event_id, strftime(ts, '%Y.%m.%d.%H%M') AS version FROM events")
def snapshot_versions(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_format("ts", "yyyy.MM.dd.HHmm").alias("version"))


@query("SELECT o_custkey, arg_max(o_orderkey, (floor(o_totalprice / 1000), -o_orderkey)) AS latest FROM orders GROUP BY o_custkey")
def newest_version(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct(F.floor(F.col("o_totalprice") / 1000), -F.col("o_orderkey"))).alias("latest"))


@query("SELECT doc_id, sha256(text) AS sha, length(text)::BIGINT AS n FROM documents")
def content_digest(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha2("text", 256).alias("sha"), F.length("text").cast("long").alias("n"))


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS s, (p_partkey * 7 + 3) % (SELECT count(*) FROM part) + 1 AS d FROM part WHERE p_partkey % 9 <> 0 UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey % 5 = 0),
c(node, dst) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT c.node, e.d FROM c JOIN e ON c.dst = e.s)
SELECT c.node, max(p.p_size)::BIGINT AS eff FROM c JOIN part p ON p.p_partkey = c.dst GROUP BY c.node""")
def effective_versions(t: Tables) -> DataFrame:
    """Each part depends on one or two others; the key beyond the last is no part."""
    save, count = shared.tables(t.spark, "eff"), t.part.count()
    nodes = t.part.select(F.col("p_partkey").alias("node"), F.col("p_size").alias("version"))
    edges = t.part.filter("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % count + 1).alias("dst"))
    edges = edges.union(t.part.filter("p_partkey % 5 = 0").select("p_partkey", F.floor(F.col("p_partkey") / 2)))
    return incremental.effective_versions(nodes, edges, save)


@query("""WITH e AS (SELECT d.doc_id, max(e.event_id) AS eff FROM documents d JOIN events e ON e.user_id = d.doc_id GROUP BY d.doc_id)
SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN e USING (doc_id) WHERE doc_id % 11 <> 0 AND (quality IS NULL OR quality <> doc_id % 2 OR doc_id % 13 = 0 OR doc_id % 6 = 0 OR coalesce(eff, 0) > CASE WHEN doc_id % 4 = 0 THEN 0 ELSE n_chars END)""")
def stale_records(t: Tables) -> DataFrame:
    """All four reasons: no or another digest, other dependencies (order and repeats are nothing), older than what it depends on; every eleventh is not tracked."""
    k = F.col("doc_id")
    eff = t.events.groupBy(F.col("user_id").alias("doc_id")).agg(F.max("event_id").alias("eff"))  # the newest version that it depends on
    tracked = k % 11 != 0
    deps = F.array(k, k + 1, k)
    stored = F.when(k % 13 == 0, F.lit(None)).when(k % 6 == 0, F.array(k, k + 2)).otherwise(F.array(k + 1, k))
    rows = t.documents.join(t.labels, "doc_id", "left").join(eff, "doc_id", "left").select(
        "doc_id", F.when(tracked, k % 2).alias("digest"), F.col("quality").alias("stored_digest"), F.when(tracked, deps).alias("deps"), stored.alias("stored_deps"), "eff", F.when(k % 4 != 0, F.col("n_chars")).alias("interpreted_at")
    )
    return incremental.stale(rows).select("doc_id")


FLAGSHIP = "top_k"
