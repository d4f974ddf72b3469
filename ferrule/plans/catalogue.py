"""Queries of records, keys, texts and reports, each with its SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions import lexer
from ferrule.functions import prompts, terms
from ferrule.functions import records as r
from ferrule.functions import text as tx
from ferrule.functions import vectors
from ferrule.operators import embedding, graphs, ordering, search, upkeep
from ferrule.operators import workload as work
from ferrule.sources import codec, layers, shared

from .queries import VIEW, Tables, query


@query(f"WITH {VIEW} SELECT d.doc_id * 2 AS doc_id, v.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN v ON v.doc_id = d.doc_id * 2")
def existence(t: Tables) -> DataFrame:
    return layers.contains(t.documents.select((F.col("doc_id") * 2).alias("doc_id")), t.view(), "doc_id")


@query("""WITH u AS (SELECT doc_id, lang, doc_id % 8 = 0 AS deleted FROM documents WHERE doc_id % 4 = 0), s AS (SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id, lang, 'user' AS layer FROM u WHERE NOT deleted UNION ALL SELECT doc_id, lang, 'system' FROM s WHERE doc_id NOT IN (SELECT doc_id FROM u) ORDER BY doc_id""")
def ordered_scan(t: Tables) -> DataFrame:
    return layers.ordered(t.user().drop("name"), t.system().drop("name"), "doc_id")


@query(f"WITH {VIEW}, e AS (SELECT doc_id * 3 AS doc_id FROM labels) SELECT count(v.doc_id) AS hit, count(*) - count(v.doc_id) AS missing FROM e LEFT JOIN v USING (doc_id)")
def backfill_field(t: Tables) -> DataFrame:
    return layers.backfill(t.view(), t.labels.select((F.col("doc_id") * 3).alias("doc_id"), F.col("quality").alias("position")), "doc_id", "position")[1]


@query(f"WITH {VIEW} SELECT l.doc_id, v.doc_id IS NOT NULL AS was_visible FROM labels l LEFT JOIN v USING (doc_id) WHERE toxic = 1")
def delete_records(t: Tables) -> DataFrame:
    return layers.delete(t.view(), t.labels.filter("toxic = 1").select("doc_id"), "doc_id")[0].select("doc_id", "was_visible")


@query("SELECT DISTINCT name FROM (SELECT lang AS name FROM documents UNION ALL SELECT r_name FROM region) ORDER BY name")
def store_names(t: Tables) -> DataFrame:
    return layers.store_names(t.documents.select(F.col("lang").alias("name")), t.region.select(F.col("r_name").alias("name")))


@query("SELECT d.doc_id, CASE WHEN d.doc_id % 8 = 0 THEN 'tombstone' WHEN e.vec_id IS NULL THEN 'absent' ELSE 'value' END AS state, CASE WHEN d.doc_id % 8 <> 0 THEN round(e.embedding[1]::DOUBLE, 6) END AS first FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def vector_states(t: Tables) -> DataFrame:
    """Value, tombstone or absent; a tombstone gives no vector on any path."""
    dead = t.documents.filter("doc_id % 8 = 0").select("doc_id")
    return layers.three_states(t.documents.select("doc_id"), t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding"), dead, "doc_id", "embedding").select("doc_id", "state", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"))


KEYS = "SELECT doc_id, substring(md5(CAST(doc_id AS VARCHAR)), 1, 32) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '0' || (doc_id % 10) || md5(text) END AS h FROM documents"


@query(f"""WITH k AS ({KEYS}) SELECT doc_id, CASE WHEN length(h) = 32 THEN 'status' WHEN doc_id % 10 BETWEEN 1 AND 8 THEN 'entity' ELSE 'meta' END AS class, ('0x' || substring(h, 1, 2))::INT % 2 = 0 AS persistent,
CASE WHEN length(h) > 32 THEN substring(h, 1, 32) || '12' || substring(h, 35) END AS face FROM k""")
def key_classes(t: Tables) -> DataFrame:
    """Kinds 0 and 9 are none."""
    k = F.col("doc_id")
    h = F.concat(F.md5(k.cast("string")), F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("0"), (k % 10).cast("string"), F.md5("text"))))
    rows = t.documents.select(k, F.unhex(h).alias("key"))
    key = F.col("key")
    return rows.select(k, r.key_class(key).alias("class"), r.is_persistent(key).alias("persistent"), F.when(F.octet_length(key) > 16, F.lower(F.hex(r.retag(key, F.lit(0x12))))).alias("face"))


@query("""SELECT l_orderkey, lower(printf('%016x%016x', bit_xor(('0x' || substring(md5(CAST(l_suppkey AS VARCHAR)), 1, 16))::UBIGINT), bit_xor(('0x' || substring(md5(CAST(l_suppkey AS VARCHAR)), 17, 16))::UBIGINT))) AS xor FROM lineitem GROUP BY l_orderkey""")
def xor_keys(t: Tables) -> DataFrame:
    """XOR of 16-byte hashes, as two numbers of eight bytes."""
    return upkeep.xor_of_hashes(t.lineitem.select("l_orderkey", F.unhex(F.md5(F.col("l_suppkey").cast("string"))).alias("h")), "l_orderkey", "h").select("l_orderkey", F.lower(F.hex("xor")).alias("xor"))


@query("""SELECT l_suppkey, count(DISTINCT l_orderkey) FILTER (l_orderkey % 4 = 0 AND l_orderkey % 8 <> 0) AS n_user, count(DISTINCT l_orderkey) FILTER (l_orderkey % 4 <> 0) AS n_system, count(DISTINCT l_orderkey) FILTER (l_orderkey % 8 = 0) AS n_gone FROM lineitem GROUP BY l_suppkey""")
def owner_counts(t: Tables) -> DataFrame:
    """Records of several owners count once for each of them."""
    k = F.col("l_orderkey")
    return t.lineitem.select("l_suppkey", k).distinct().groupBy("l_suppkey").agg(F.count_if((k % 4 == 0) & (k % 8 != 0)).alias("n_user"), F.count_if(k % 4 != 0).alias("n_system"), F.count_if(k % 8 == 0).alias("n_gone"))


@query("""SELECT count(*) AS records, count(*) FILTER (lang = 'en') AS experiences, count(*) FILTER (quality IS NULL) AS legacy, count(*) FILTER (quality IS NOT NULL AND quality <> doc_id % 2) AS mismatched FROM documents LEFT JOIN labels USING (doc_id)""")
def consistency_counts(t: Tables) -> DataFrame:
    q = F.col("quality")
    return t.documents.join(t.labels, "doc_id", "left").agg(F.count("*").alias("records"), F.count_if(F.col("lang") == "en").alias("experiences"), F.count_if(q.isNull()).alias("legacy"), F.count_if(q.isNotNull() & (q != F.col("doc_id") % 2)).alias("mismatched"))


@query("SELECT 'documents' AS store, count(*) AS entries, sum(strlen(coalesce(text, '')))::BIGINT AS bytes FROM documents UNION ALL SELECT 'pages', count(*), sum(strlen(coalesce(html, '')))::BIGINT FROM pages")
def manifest_stats(t: Tables) -> DataFrame:
    one = lambda df, name, c: df.agg(F.lit(name).alias("store"), F.count("*").alias("entries"), F.sum(F.octet_length(F.coalesce(c, F.lit("")))).alias("bytes"))
    return one(t.documents, "documents", "text").unionByName(one(t.pages, "pages", "html"))


@query("SELECT event_type, max(ts) AS newest FROM events GROUP BY event_type")
def newest_change(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type").agg(F.max("ts").alias("newest"))


@query("""WITH a AS (SELECT lang AS kind, count(*) AS before FROM documents GROUP BY lang), b AS (SELECT lang AS kind, count(*) AS after FROM documents WHERE doc_id % 9 <> 4 GROUP BY lang)
SELECT kind, before, coalesce(after, 0) AS after, before = coalesce(after, 0) AS conserved FROM a LEFT JOIN b USING (kind)""")
def census(t: Tables) -> DataFrame:
    return upkeep.census(t.documents.select(F.col("lang").alias("kind")), t.documents.filter("doc_id % 9 <> 4").select(F.col("lang").alias("kind")), "kind")


@query("""WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT l_orderkey AS k FROM lineitem WHERE l_suppkey % 2 = 0) SELECT count(DISTINCT k) AS todo FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE k NOT IN (SELECT doc_id FROM documents)""")
def workload(t: Tables) -> DataFrame:
    k = t.orders.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id")).union(t.lineitem.filter("l_suppkey % 2 = 0").select("l_orderkey")).distinct()
    return k.join(t.documents.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("todo"))


@query("""WITH p AS (SELECT p_partkey, list_transform(range(1, len(a) + 1), lambda i: list_sum(list_transform(a[1:i], lambda x: length(x)))) AS x, list_transform(range(1, len(b) + 1), lambda i: list_sum(list_transform(b[1:i], lambda x: length(x)))) AS y, array_to_string(a, '') = array_to_string(b, '') AS same
FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split_regex(CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'b', ' b') WHEN p_partkey % 3 = 1 THEN replace(p_name, ' ', '') ELSE p_name || CASE WHEN p_partkey % 2 = 0 THEN '!' ELSE '' END END, ' +') AS b FROM part))
SELECT CASE WHEN NOT same THEN 'content' WHEN list_sort(x) = list_sort(y) THEN 'same' WHEN list_has_all(y, x) THEN 'refinement' WHEN list_has_all(x, y) THEN 'merge' ELSE 'mixed' END AS class, count(*) AS n FROM (SELECT same, list_distinct(list_filter(x, lambda v: v > 0)) AS x, list_distinct(list_filter(y, lambda v: v > 0)) AS y FROM p) GROUP BY 1""")
def token_diff(t: Tables) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    other = F.when(k % 3 == 0, F.replace(name, F.lit("b"), F.lit(" b"))).when(k % 3 == 1, F.replace(name, F.lit(" "), F.lit(""))).otherwise(F.concat(name, F.when(k % 2 == 0, F.lit("!")).otherwise("")))
    return t.part.select(tx.token_change(F.split(name, " "), F.split(other, " +")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("SELECT l_partkey AS part FROM (SELECT l_partkey, lag(l_partkey) OVER (ORDER BY l_partkey, l_orderkey, l_linenumber) AS p FROM lineitem) WHERE p IS DISTINCT FROM l_partkey")
def adjacent_duplicates(t: Tables) -> DataFrame:
    """A sorted domain without repeats is its distinct values."""
    return t.lineitem.select(F.col("l_partkey").alias("part")).distinct()


@query("""SELECT o_orderkey, local FROM (SELECT o_orderkey, o_custkey % 2 = 0 AS local, row_number() OVER (PARTITION BY o_custkey % 2 = 0 ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderkey NOT IN (SELECT doc_id FROM documents)) WHERE n <= 25""")
def two_quotas(t: Tables) -> DataFrame:
    rows = t.orders.join(t.documents.select(F.col("doc_id").alias("o_orderkey")), "o_orderkey", "left_anti").withColumn("local", F.col("o_custkey") % 2 == 0)
    return layers.newest(rows, ["local"], [F.asc("o_orderdate"), F.asc("o_orderkey")], 25).select("o_orderkey", "local")


@query("""SELECT l_orderkey, l_linenumber, r // 20 AS b20, r // 256 AS b256, r // 2048 AS b2048, r // 10000 AS b10000 FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS r FROM lineitem)""")
def batch_sizes(t: Tables) -> DataFrame:
    rows = ordering.placed(t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber"), ["l_returnflag"], [F.col("l_orderkey"), F.col("l_linenumber")], shared.tables(t.spark, "batches"))
    return rows.select("l_orderkey", "l_linenumber", *(ordering.batch_of(s).alias(f"b{s}") for s in (20, 256, 2048, 10000)))


@query("""SELECT p_partkey, name FROM (SELECT p_partkey, p_size, CASE WHEN count(*) OVER (PARTITION BY p_brand) = 1 THEN p_brand ELSE p_brand || '(' || row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) || ')' END AS name FROM part) WHERE p_size > 20""")
def filtered_members(t: Tables) -> DataFrame:
    """Members are numbered in the whole bin, before any is left out."""
    rows = ordering.placed(t.part.select("p_brand", "p_partkey", "p_size"), ["p_brand"], [F.col("p_partkey")], shared.tables(t.spark, "members"))
    return rows.filter("p_size > 20").select("p_partkey", ordering.member_name(F.col("p_brand")).alias("name"))


@query("""SELECT p_partkey, CASE WHEN name IS NULL THEN NULL ELSE kind END AS kind, name, known FROM (SELECT p.p_partkey, CASE WHEN d.doc_id IS NOT NULL THEN d.lang ELSE 'part' END AS kind, CASE WHEN d.doc_id IS NOT NULL THEN d.source WHEN p.p_partkey % 3 = 0 THEN p.p_name END AS name, d.doc_id IS NOT NULL AS known
FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey * 2) WHERE name IS NOT NULL""")
def placeholders(t: Tables) -> DataFrame:
    """Records, or the live name alone; keys with neither go."""
    d = t.documents.select((F.col("doc_id") / 2).alias("_half"), "doc_id", "lang", "source")
    rows = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).alias("live")).join(d, F.col("_half") == F.col("p_partkey"), "left")
    known = F.col("doc_id").isNotNull()
    return rows.select("p_partkey", F.when(known, F.col("lang")).otherwise("part").alias("kind"), F.when(known, F.col("source")).otherwise(F.col("live")).alias("name"), known.alias("known")).filter("name is not null")


FACES = "SELECT p_partkey, p_brand AS head, p_size % 5 AS kind, p_type AS tail FROM part"


@query(f"""WITH f AS ({FACES}), b AS (SELECT * FROM f WHERE p_partkey % 3 <> 0), x AS (SELECT * FROM f WHERE p_partkey % 2 = 0 AND p_partkey NOT IN (SELECT p_partkey FROM b) AND kind IN (1, 2, 3))
SELECT p_partkey, kind FROM b UNION ALL SELECT p_partkey, kind FROM x WHERE kind <> 2 OR NOT EXISTS (SELECT 1 FROM b WHERE b.head = x.head AND b.tail = x.tail AND b.kind <> 2)""")
def extended_domain(t: Tables) -> DataFrame:
    """Extras of the wanted kinds join the context once; a theorem goes where one of its faces is there."""
    f = t.part.select("p_partkey", F.col("p_brand").alias("head"), (F.col("p_size") % 5).alias("kind"), F.col("p_type").alias("tail"))
    return upkeep.extend(f.filter("p_partkey % 3 <> 0"), f.filter("p_partkey % 2 = 0 and kind in (1, 2, 3)"), "p_partkey", ["head", "tail"], "kind", 2).select("p_partkey", "kind")


@query("""SELECT DISTINCT l_suppkey AS coll, l_partkey AS uk FROM lineitem WHERE l_orderkey % 2 = 0 EXCEPT SELECT l_suppkey, l_partkey FROM lineitem WHERE l_orderkey % 2 = 1""")
def new_members(t: Tables) -> DataFrame:
    """What a bin has that the same bin of no parent has."""
    rows = t.lineitem.select(F.col("l_suppkey").alias("coll"), F.col("l_partkey").alias("uk"), "l_orderkey")
    return rows.filter("l_orderkey % 2 = 0").select("coll", "uk").distinct().join(rows.filter("l_orderkey % 2 = 1"), ["coll", "uk"], "left_anti")


@query("""WITH a AS (SELECT p_partkey AS k, p_type AS digest, p_brand || '.' || split_part(p_name, ' ', 2) || '.' || split_part(p_name, ' ', 3) AS name FROM part WHERE p_partkey % 2 = 0),
b AS (SELECT p_partkey AS t, p_type AS digest, CASE WHEN p_partkey % 4 = 1 THEN split_part(p_name, ' ', 2) || '.' || split_part(p_name, ' ', 3) ELSE split_part(p_name, ' ', 3) END AS suffix FROM part WHERE p_partkey % 2 = 1),
m AS (SELECT a.k, b.t, b.suffix, row_number() OVER (PARTITION BY a.k ORDER BY length(b.suffix) DESC, b.t) AS r FROM a JOIN b ON a.digest = b.digest AND (a.name = b.suffix OR ends_with(a.name, '.' || b.suffix)))
SELECT k, t, suffix FROM m WHERE r = 1""")
def instances(t: Tables) -> DataFrame:
    """Equal digests, then the longest suffix of the name."""
    part = lambda i: F.element_at(F.split("p_name", " "), i)
    a = t.part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("digest"), F.concat_ws(".", "p_brand", F.coalesce(F.try_element_at(F.split("p_name", " "), F.lit(2)), F.lit("")), F.coalesce(F.try_element_at(F.split("p_name", " "), F.lit(3)), F.lit(""))).alias("name"))
    two, three = F.coalesce(F.try_element_at(F.split("p_name", " "), F.lit(2)), F.lit("")), F.coalesce(F.try_element_at(F.split("p_name", " "), F.lit(3)), F.lit(""))
    b = t.part.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("t"), F.col("p_type").alias("digest"), F.when(F.col("p_partkey") % 4 == 1, F.concat_ws(".", two, three)).otherwise(three).alias("suffix"))
    return upkeep.instances(a, b, "digest", "name", "suffix", "k", "t")


PHRASES = {"en": "constants", "de": "lemmas", "es": "types"}


@query("""WITH k AS (SELECT source, CASE lang WHEN 'en' THEN 'constants' WHEN 'de' THEN 'lemmas' WHEN 'es' THEN 'types' ELSE 'constructs' END AS p, lang FROM documents WHERE lang IS NOT NULL),
l AS (SELECT source, list(p ORDER BY lang) AS ps FROM (SELECT DISTINCT source, p, lang FROM k) GROUP BY source)
SELECT source, CASE WHEN len(ps) = 1 THEN ps[1] ELSE array_to_string(ps[1:len(ps) - 1], ', ') || ' and ' || ps[len(ps)] END AS phrase FROM l""")
def kinds_phrases(t: Tables) -> DataFrame:
    kinds = t.documents.filter("lang is not null").groupBy("source").agg(F.array_sort(F.collect_set("lang")).alias("k"))
    return kinds.select("source", r.kinds_phrase(F.col("k"), PHRASES).alias("phrase"))


@query(f"""SELECT doc_id, md5(CASE WHEN lang = 'en' THEN CASE WHEN doc_id % 5 <> 0 THEN '{r.EXPERIENCE_HEAD}' || chr(10) || '- ' || source || chr(10) || '- ' || lang || chr(10) || '{r.EXPERIENCE_WHEN}' || chr(10) || text END ELSE lang || ' ' || source || ': ' || chr(10) || text END) AS digest FROM documents WHERE text IS NOT NULL""")
def document_texts(t: Tables) -> DataFrame:
    """Every fifth record of the first kind has no patterns, so no text."""
    kind = F.when(F.col("lang") == "en", r.EXPERIENCE).otherwise(1)
    patterns = F.when(F.col("doc_id") % 5 != 0, F.array("source", "lang")).otherwise(F.array().cast("array<string>"))
    body = r.document_text(kind, F.concat("lang", F.lit(" "), "source", F.lit(": ")), F.col("text"), patterns)
    return t.documents.filter("text is not null").select("doc_id", F.md5(body).alias("digest"))


@query("SELECT item_id, md5('Instruct: find ' || item_id || chr(10) || 'Query: ' || text) AS digest, 'org__' || item_id AS store, 'org/' || item_id AS model FROM benchmark")
def templates(t: Tables) -> DataFrame:
    task, model = F.concat(F.lit("find "), F.col("item_id").cast("string")), F.concat(F.lit("org/"), F.col("item_id").cast("string"))
    return t.benchmark.select("item_id", F.md5(r.apply_template("Instruct: {task}\nQuery: {text}", F.col("text"), task)).alias("digest"), r.store_name(model).alias("store"), r.model_name(r.store_name(model)).alias("model"))


@query("""WITH s AS (SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS s, label FROM embeddings), e AS (SELECT vec_id, s, 'entity' AS track FROM s WHERE label <> 3 ORDER BY s DESC, vec_id LIMIT 40), x AS (SELECT vec_id, s + (1 - s) * 0.25 * (label / 10.0::DOUBLE) AS s, 'experience' AS track FROM (SELECT * FROM s WHERE label = 3 ORDER BY s DESC, vec_id LIMIT 40))
SELECT vec_id, track, round(s, 9) AS score FROM (SELECT vec_id, s + (1 - s) * 0.25 AS s, track FROM e UNION ALL SELECT vec_id, s, track FROM x) ORDER BY s DESC, vec_id LIMIT 50""")
def two_tracks(t: Tables) -> DataFrame:
    """Entities hit all patterns; experiences are raised by their hit rate."""
    s = t.embeddings.select("vec_id", F.round(F.element_at("embedding", 1).cast("double"), 6).alias("score"), "label")
    one = lambda track, rows, hit: (rows.orderBy(F.desc("score"), "vec_id").limit(40).select("vec_id", F.lit(track).alias("track"), r.boosted(F.col("score"), hit, F.lit(2)).alias("score")))
    both = one("entity", s.filter("label <> 3"), F.lit(1.0)).union(one("experience", s.filter("label = 3"), F.col("label") / 10.0))
    return both.orderBy(F.desc("score"), "vec_id").limit(50).withColumn("score", F.round("score", 9))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '//[^/@]*@', '//') AS shown, nullif(regexp_extract(url || '/v' || (page_id % 3) || '/x', '/(v[0-9]+[a-z0-9]*)(?:/|$)', 1), '') AS version FROM pages")
def urls_shown(t: Tables) -> DataFrame:
    return t.pages.select("page_id", r.redacted(F.col("url")).alias("shown"), r.version_segment(F.concat("url", F.lit("/v"), (F.col("page_id") % 3).cast("string"), F.lit("/x"))).alias("version"))


@query(r"""WITH n AS (SELECT p_partkey, replace(p_name, ' ', '.') AS name, '/opt/' || p_brand || '/' || p_name AS path FROM part)
SELECT p_partkey, split_part(name, '.', -1) AS base, CASE WHEN contains(name, '.') THEN regexp_extract(name, '^(.*)\.[^.]*$', 1) ELSE '' END AS qualifier, array_to_string(string_split(name, '.')[2:len(string_split(name, '.')) - 1], '.') AS middle,
CASE WHEN starts_with(path, '/opt/Brand#1/') THEN '$ONE' || substring(path, 13) WHEN starts_with(path, '/opt/') THEN '$OPT' || substring(path, 5) ELSE path END AS path, regexp_extract(name || '(' || p_partkey || ')', '^(.*)\((\d+)\)$', 1) AS member FROM n""")
def dotted_names(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"), F.concat(F.lit("/opt/"), "p_brand", F.lit("/"), "p_name").alias("path"))
    name = F.col("name")
    return rows.select("p_partkey", tx.base_name(name).alias("base"), r.qualifier(name).alias("qualifier"), r.middle(name).alias("middle"), r.portable_path(F.col("path"), {"/opt/Brand#1": "$ONE", "/opt": "$OPT"}).alias("path"), tx.member_base(F.concat(name, F.lit("("), F.col("p_partkey").cast("string"), F.lit(")"))).alias("member"))


@query("""SELECT doc_id, len(string_split(p, chr(10))) AS line, strlen(string_split(p, chr(10))[-1]) + 1 AS col FROM (SELECT doc_id, substring(text, 1, (n_chars // 2)::INT) AS p FROM documents WHERE text IS NOT NULL)""")
def byte_columns(t: Tables) -> DataFrame:
    at = r.line_and_column(F.col("text"), F.floor(F.col("n_chars") / 2))
    return t.documents.filter("text is not null").select("doc_id", at["line"].cast("long").alias("line"), at["col"].cast("long").alias("col"))


@query("SELECT user_id, round(sum((t - least(greatest(c, 0), t)) * 3.0 + least(greatest(c, 0), t) * 0.3 + o * 15.0) / 1e6, 9) AS cost FROM (SELECT user_id, event_id % 1000 AS t, event_id % 1500 - 100 AS c, event_id % 77 AS o FROM events) GROUP BY user_id")
def token_costs(t: Tables) -> DataFrame:
    e = F.col("event_id")
    return t.events.groupBy("user_id").agg(F.round(F.sum(r.cost(e % 1000, e % 1500 - 100, e % 77, (3.0, 0.3, 15.0))), 9).alias("cost"))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 3 = 0 ELSE s_nationkey % 4 <> 0 AND s_nationkey % 4 = 1 END AS interpreted, s_suppkey IN (1, 5, 7) OR s_nationkey IN (1, 5, 7) AS belongs, (s_nationkey < 12) AS scoped FROM supplier""")
def theory_tests(t: Tables) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("long")
    done = r.interpreted(k % 2 == 0, F.when(k % 3 == 0, True), F.when(n % 4 != 0, n % 4), F.lit(1).cast("long"))
    theories = F.array(F.concat(F.when(n < 12, "HOL").otherwise("Own"), F.lit(".x")), F.lit("Main.y"))
    return t.supplier.select("s_suppkey", done.alias("interpreted"), r.belongs(k, F.array(n), F.array(*(F.lit(x).cast("long") for x in (1, 5, 7)))).alias("belongs"), r.in_scope(theories, ["HOL", "Main"]).alias("scoped"))


RULE_NAMES = ("foo_induct", "bar.cases", "conjI", "conjE", "size_multi", "bridge", "foo_rule", "ex.intros", "x_dest", "fooOI", "wf_ind", "z_case", "I", "plain", "E.elims", "someE")


@query(f"""WITH e AS (SELECT p_partkey, p_size, replace(p_name, ' ', '.') || '.' || [{", ".join(f"'{x}'" for x in RULE_NAMES)}][1 + p_partkey % {len(RULE_NAMES)}] AS name FROM part UNION ALL SELECT -p_partkey, p_size, 'Abs_' || replace(p_type, ' ', '_') FROM part),
b AS (SELECT *, string_split(name, '.')[-1] AS base FROM e)
SELECT p_partkey, CASE WHEN base SIMILAR TO '.*_(induct|ind)' THEN 'induction' WHEN base SIMILAR TO '.*_(cases|case)' THEN 'case_split' WHEN base SIMILAR TO '.*[^A-Z]I' OR name SIMILAR TO '.*[_.]intros?' THEN 'introduction'
WHEN base SIMILAR TO '.*[^A-Z]E' OR name SIMILAR TO '.*[_.](elims?|dest)' THEN 'elimination' END AS class, p_size = 7 OR (p_size <> 9 AND (p_size % 10 = 0 OR starts_with(name, 'Abs_'))) AS infra FROM b""")
def rules_and_helpers(t: Tables) -> DataFrame:
    """Names made of those of parts, with all kinds of ends."""
    k, size = F.col("p_partkey"), F.col("p_size")
    end = F.element_at(F.array(*map(F.lit, RULE_NAMES)), (k % len(RULE_NAMES) + 1).cast("int"))
    rules = t.part.select(k, size, F.concat(F.replace("p_name", F.lit(" "), F.lit(".")), F.lit("."), end).alias("name"))
    made = t.part.select((-k).alias("p_partkey"), size, F.concat(F.lit("Abs_"), F.replace("p_type", F.lit(" "), F.lit("_"))).alias("name"))
    return rules.union(made).select("p_partkey", r.rule_class(F.col("name")).alias("class"), r.infrastructure(F.col("name"), {"concealed": size % 10 == 0}, size == 9, size == 7).alias("infra"))


@query(r"""WITH n AS (SELECT p_partkey, p_size % 9 AS kind, CASE WHEN p_partkey % 4 = 0 THEN p_brand || '(' || p_size || ')' ELSE p_brand END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS position FROM part)
SELECT p_partkey, CASE WHEN kind NOT IN (7, 8) AND position IS NULL AND p_partkey % 4 = 0 AND regexp_extract(name, '^(.*)\((\d+)\)$', 1) IN ('Brand#11', 'Brand#22', 'Brand#33') THEN regexp_extract(name, '^(.*)\((\d+)\)$', 1) END AS collection FROM n""")
def collection_members(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.concat("p_brand", F.lit("("), F.col("p_size").cast("string"), F.lit(")"))).otherwise(F.col("p_brand"))
    member = r.is_member(name, F.col("p_size") % 9, F.when(k % 3 == 0, k), F.array(*map(F.lit, ("Brand#11", "Brand#22", "Brand#33"))))
    return t.part.select(k, F.when(member, tx.member_base(name)).alias("collection"))


@query("SELECT format, count(*) AS n FROM (SELECT CASE vec_id % 4 WHEN 0 THEN 'float32' WHEN 3 THEN 'other' ELSE 'q15' END AS format FROM embeddings) GROUP BY format")
def vector_formats(t: Tables) -> DataFrame:
    k = F.col("vec_id")
    length = F.when(k % 4 == 0, 256).when(k % 4 == 3, 100).otherwise(128)
    return t.embeddings.select(r.format_class(length, 64).alias("format")).groupBy("format").agg(F.count("*").alias("n"))


@query("""SELECT vec_id, total FROM (SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: round_even(0.95::DOUBLE * (x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-12)) * 32768.0, 0) / 32768.0)), 9) AS total FROM embeddings)""")
def decoded_vectors(t: Tables) -> DataFrame:
    """Dequantised with a check of the length."""
    q = vectors.encode_q15(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(F.aggregate(vectors.decode_checked(q, 64), F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


@query("""WITH d AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents), tf AS (SELECT doc_id, w, count(*) AS tf FROM d WHERE w <> '' GROUP BY ALL), n AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
a AS (SELECT count(*) AS docs, avg(len) AS mean FROM n), q AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark) WHERE w <> ''), df AS (SELECT w, count(*) AS df FROM tf GROUP BY w),
s AS (SELECT item_id, doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))) AS score FROM q JOIN tf USING (w) JOIN df USING (w) JOIN n USING (doc_id), a GROUP BY ALL)
SELECT item_id, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS r FROM s) WHERE r <= 10""")
def bm25(t: Tables) -> DataFrame:
    return search.bm25(t.documents.select("doc_id", F.split(F.lower("text"), " ").alias("words")), t.benchmark.select("item_id", F.split(F.lower("text"), " ").alias("words")), "doc_id", "item_id", 10)


@query("""WITH p AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), k AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) AS r FROM p)
SELECT o_custkey, n FROM k WHERE r <= 20 UNION ALL SELECT NULL, sum(n)::BIGINT FROM k WHERE r > 20 HAVING count(*) > 0""")
def ranked_with_rest(t: Tables) -> DataFrame:
    return upkeep.ranked_with_rest(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", "n", 20)


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY serial NULLS LAST, kind_rank, p_name, p_partkey) AS place FROM (SELECT *, CASE WHEN p_size % 3 <> 0 THEN p_size END AS serial, CASE WHEN p_type LIKE 'STANDARD%' THEN 0 ELSE 1 END AS kind_rank FROM part)")
def send_order(t: Tables) -> DataFrame:
    order = [F.asc_nulls_last(F.when(F.col("p_size") % 3 != 0, F.col("p_size"))), F.when(F.col("p_type").startswith("STANDARD"), 0).otherwise(1), F.col("p_name"), F.col("p_partkey")]
    rows = ordering.placed(t.part.select("p_brand", "p_partkey", "p_size", "p_type", "p_name"), ["p_brand"], order, shared.tables(t.spark, "send"))
    return rows.select("p_partkey", F.col("_place").alias("place"))


@query("SELECT s_suppkey, coalesce(n_name, md5(CAST(s_suppkey AS VARCHAR))) AS shown FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey ORDER BY shown, s_suppkey LIMIT 30")
def listed_theories(t: Tables) -> DataFrame:
    n = t.nation.filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return t.supplier.join(n, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.md5(F.col("s_suppkey").cast("string"))).alias("shown")).orderBy("shown", "s_suppkey").limit(30)


@query("""SELECT o_custkey, arg_max(v, (list_transform(string_split(v, '.'), lambda x: coalesce(TRY_CAST(x AS INT), -1)), b)) AS newest FROM (SELECT o_custkey, (o_orderkey % 12) || '.' || CASE WHEN o_orderkey % 5 = 0 THEN 'rc' ELSE CAST(o_orderkey % 20 AS VARCHAR) END AS v, o_orderkey AS b FROM orders) GROUP BY o_custkey""")
def newest_builds(t: Tables) -> DataFrame:
    """Dotted numbers, then the build; what is no number is lowest."""
    k = F.col("o_orderkey")
    v = F.concat((k % 12).cast("string"), F.lit("."), F.when(k % 5 == 0, "rc").otherwise((k % 20).cast("string")))
    return t.orders.select("o_custkey", v.alias("v"), k).groupBy("o_custkey").agg(F.max_by("v", F.struct(tx.version_key(F.col("v")), "o_orderkey")).alias("newest"))


@query("SELECT l_partkey, l_orderkey FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def first_of_each(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.min(F.struct("l_shipdate", "l_orderkey", "l_linenumber"))["l_orderkey"].alias("l_orderkey"))


@query("""WITH f AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents) SELECT doc_id, r // 20 AS page FROM f WHERE r < 200""")
def result_pages(t: Tables) -> DataFrame:
    few = t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(200)
    return few.select("doc_id", F.floor((F.row_number().over(Window.orderBy(F.desc("n_chars"), "doc_id")) - 1) / 20).alias("page"))


@query("""SELECT conv_id, array_to_string(list(role ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, turn), ' ') AS roles FROM conversations GROUP BY conv_id""")
def segment_order(t: Tables) -> DataFrame:
    """Segments by rank, stable within one."""
    rank = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "turn", "role"))).alias("s")).select("conv_id", F.array_join(F.col("s.role"), " ").alias("roles"))


@query("""WITH o AS (SELECT o_custkey % 40 AS name, o_custkey AS hash, max(o_orderdate) AS ts FROM orders GROUP BY ALL), g AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts DESC, hash) AS r FROM o)
SELECT hash, r > 2 AS doomed FROM g""")
def prune_plan(t: Tables) -> DataFrame:
    rows = t.orders.groupBy((F.col("o_custkey") % 40).alias("name"), F.col("o_custkey").alias("hash")).agg(F.max("o_orderdate").alias("ts"))
    return upkeep.prune_plan(rows, "name", [F.desc("ts"), F.asc("hash")], 2).select("hash", "doomed")


@query(f"""WITH {VIEW}, k AS (SELECT v.doc_id FROM v JOIN documents d USING (doc_id) WHERE d.source IN (SELECT source FROM documents WHERE doc_id = 1))
SELECT step, count(*) AS n FROM (SELECT '1 vectors' AS step FROM k JOIN embeddings ON vec_id = doc_id UNION ALL SELECT '2 index' FROM k UNION ALL SELECT '3 records' FROM k) GROUP BY step""")
def removal_plan(t: Tables) -> DataFrame:
    """Vectors first, records last."""
    chosen = t.documents.filter("doc_id = 1").select("source")
    keys = t.view().select("doc_id").join(t.documents.join(F.broadcast(chosen), "source", "left_semi").select("doc_id"), "doc_id", "left_semi")
    return upkeep.removal_plan(keys, "doc_id", t.embeddings.select(F.col("vec_id").alias("doc_id"))).groupBy("step").agg(F.count("*").alias("n"))


@query(f"""WITH {VIEW} SELECT 'records' AS fact, count(*) AS n FROM v UNION ALL SELECT 'orphan vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM v) UNION ALL SELECT 'unindexed', count(*) FROM v WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'dangling', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM v)""")
def store_check(t: Tables) -> DataFrame:
    return upkeep.store_check(t.view(), t.embeddings.select(F.col("vec_id").alias("doc_id")), t.labels.select("doc_id"), "doc_id")


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN lang = 'en' THEN list_count(list_filter(string_split(text, ' '), lambda x: x = 'the')) ELSE 0 END AS n FROM (SELECT doc_id, lang, text FROM documents WHERE text IS NOT NULL)""")
def pattern_lists(t: Tables) -> DataFrame:
    """Lists kept as JSON in a text field; what is no JSON list gives null."""
    words = F.filter(F.split("text", " "), lambda x: x == "the")
    stored = F.when(F.col("doc_id") % 7 == 0, F.lit("[broken")).when(F.col("lang") == "en", F.to_json(words)).otherwise("[]")
    return t.documents.filter("text is not null").select("doc_id", F.size(F.from_json(stored, "array<string>")).cast("long").alias("_n"), stored.alias("_s")).select("doc_id", F.when(F.from_json("_s", "array<string>").isNotNull(), F.col("_n")).alias("n"))


@query("""WITH e AS (SELECT p_partkey, p_size AS v, p_partkey % 3 = 0 AS had FROM part) SELECT p_partkey, CASE WHEN had THEN v ELSE (SELECT max(p_size) FROM part) END::BIGINT AS version FROM e""")
def first_versions(t: Tables) -> DataFrame:
    """A record that is written first takes the counter as it is, never 0."""
    top = t.part.agg(F.greatest(F.max("p_size"), F.lit(1)).cast("long").alias("counter"))  # one row
    return t.part.crossJoin(F.broadcast(top)).select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("long")).otherwise(F.col("counter")).alias("version"))


@query("""WITH pre AS (SELECT doc_id, quality FROM labels), w AS (SELECT doc_id, doc_id % 9 AS quality FROM documents WHERE doc_id % 2 = 0) SELECT doc_id, quality::BIGINT AS quality FROM pre""")
def undo(t: Tables) -> DataFrame:
    """Writes, then what they overwrote put back."""
    pre = t.labels.select("doc_id", F.col("quality").cast("long").alias("quality"))
    writes = t.documents.filter("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 9).alias("quality"))
    image = upkeep.pre_image(pre, writes, "doc_id")
    return upkeep.restore(upkeep.applied(pre, writes, "doc_id"), image, "doc_id")


@query("""SELECT p_partkey, p_type FROM part WHERE p_partkey % 2 = 0 OR (p_partkey % 4 = 1 AND p_type NOT LIKE 'PROMO%')""")
def work_in_progress(t: Tables) -> DataFrame:
    """Keys that aren't persistent go for good, but for those still in use."""
    odd = F.col("p_partkey") % 2 == 1
    return t.part.filter(~odd | ((F.col("p_partkey") % 4 == 1) & ~F.col("p_type").startswith("PROMO"))).select("p_partkey", "p_type")


@query("SELECT doc_id, 1 + length(coalesce(lang, ''))::INT AS kind, source AS name, md5(text) AS digest, n_chars AS version, doc_id::INT AS line FROM documents WHERE doc_id % 6 <> 0")
def record_codec(t: Tables) -> DataFrame:
    """Records written in the stored form and read back; tombstones and what can't be read are left out."""
    d = t.documents
    values = {"kind": 1 + F.length(F.coalesce("lang", F.lit(""))), "name": F.col("source"), "interpretation": F.col("text"), "version": F.col("n_chars"), "position": F.struct(F.col("source").alias("file"), F.col("doc_id").cast("int").alias("line"), F.lit(1).alias("col"))}
    fields = F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in codec.RECORD))
    body = F.when(F.col("doc_id") % 12 == 0, F.unhex(F.lit(""))).when(F.col("doc_id") % 6 == 0, F.unhex(F.lit("c1ff"))).otherwise(codec.encode(fields))
    store = d.select(F.concat(F.unhex(F.md5("source")), F.encode(F.col("doc_id").cast("string"), "utf-8")).alias("uk"), body.alias("value"))
    return codec.records(store).select(F.decode(F.substring("uk", 17, 20), "utf-8").cast("long").alias("doc_id"), "kind", "name", F.md5("interpretation").alias("digest"), "version", F.col("position.line").alias("line"))


def tokens_sql(table: str, key: str) -> str:
    """Subtokens by the asset's classes, as far as code points of Latin texts go."""
    asset, top = lexer.default_asset(), 0x250
    points = lambda low, high: f"\\x{{{low:x}}}-\\x{{{high:x}}}"
    cls = lambda name: "".join(points(a, min(b, top)) for a, b in asset[name] if a < top)
    each = lambda text: "".join(points(ord(c), ord(c)) for c in text)
    plain = "".join(points(c, c) for a, b in asset["digits"] for c in range(a, min(b, top) + 1) if chr(c) not in asset["rendered_digits"])
    token = f"[{cls('letters')}][{cls('letters')}{cls('digits')}{each(asset['quasi_letters'])}]*|[{plain}]+|[{each(asset['ascii_symbolic'])}]+|[^{cls('spaces')}{each(asset['discarded'])}]"
    return f"""WITH t AS (SELECT {key}, unnest(regexp_extract_all(nfc_normalize(text), '{token}')) AS tok FROM {table}),
p AS (SELECT {key}, tok, list_filter(string_split_regex(tok, '[{each(asset['separators'])}]'), lambda x: x <> '') AS p FROM t),
s AS (SELECT {key}, unnest(CASE WHEN len(p) > 0 THEN p WHEN regexp_full_match(tok, '[{each(asset['rendered_subsup'])}]+') THEN [tok] ELSE [] END) AS token FROM p)
SELECT token, count(DISTINCT {key}) AS n FROM s GROUP BY token"""


@query(tokens_sql("benchmark", "item_id"))
def subtokens(t: Tables) -> DataFrame:
    """Words of formulas in all item texts, by how many items have them."""
    return t.benchmark.select(F.explode(F.array_distinct(lexer.subtokens_of(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(tokens_sql("documents", "doc_id"))
def document_tokens(t: Tables) -> DataFrame:
    """The same of all documents, whole."""
    return t.documents.select(F.explode(F.array_distinct(lexer.subtokens_of(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("")
def search_after_embedding(t: Tables) -> DataFrame:
    """All items against all documents; documents without a vector get one first."""
    none = t.spark.createDataFrame([], "doc_id long, q array<int>")
    return embedding.search(t.documents.select("doc_id", "text"), none, t.benchmark.select(F.col("item_id").alias("query_id"), "text"), "doc_id", "text", "words", 5)[0]


@query("")
def theory_hashes(t: Tables) -> DataFrame:
    """Hashes of parts over their parents: the half and the third of a key."""
    k = F.col("p_partkey")
    nodes = t.part.select(k.alias("node"), F.col("p_name").alias("name"), F.col("p_type").alias("content"))
    edges = t.part.filter("p_partkey > 0").select(k.alias("node"), F.explode(F.array(F.struct(F.lit(0).alias("place"), F.floor(k / 2).alias("parent")), F.struct(F.lit(1).alias("place"), F.floor(k / 3).alias("parent")))).alias("e")).select("node", "e.place", "e.parent")
    return graphs.merkle(nodes, edges, shared.tables(t.spark, "hashes")).select("node", F.lower(F.hex("hash")).alias("hash"))


def imports(t: Tables) -> DataFrame:
    """Every part imports the half and the third of its key."""
    k = F.col("p_partkey")
    return t.part.filter("p_partkey > 0").select(k.alias("node"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("parent")).distinct()


IMPORTS = "e AS (SELECT p_partkey AS node, p_partkey // 2 AS parent FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 0)"


@query(f"""WITH RECURSIVE {IMPORTS}, w AS (SELECT p_partkey AS node, 0 AS wave FROM part UNION SELECT e.node, wave + 1 FROM w JOIN e ON e.parent = w.node)
SELECT node, max(wave)::INT AS wave FROM w GROUP BY node""")
def import_waves(t: Tables) -> DataFrame:
    """The order in which parts can be done, those of a wave side by side."""
    return work.waves(t.part.select(F.col("p_partkey").alias("node")), imports(t), shared.tables(t.spark, "waves"))


@query(f"""WITH RECURSIVE {IMPORTS}, r AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 7 = 3), s AS (SELECT node FROM r UNION SELECT e.parent FROM s JOIN e ON e.node = s.node),
h AS (SELECT e.node, e.parent FROM e JOIN s ON s.node = e.node UNION SELECT h.node, e.parent FROM h JOIN e ON e.node = h.parent WHERE h.parent % 5 = 2)
SELECT DISTINCT node, parent FROM h WHERE node % 5 <> 2 AND parent % 5 <> 2""")
def import_cone(t: Tables) -> DataFrame:
    """What some parts need, with excluded parts walked through."""
    key = F.col("p_partkey").alias("node")
    return work.cone(imports(t), t.part.filter("p_partkey % 7 = 3").select(key), t.part.filter("p_partkey % 5 = 2").select(key), shared.tables(t.spark, "cone"))[1]


@query("""SELECT p_partkey, 4 + (p_type LIKE 'PROMO%')::INT AS size, p_size = 1 AS same, p_type LIKE 'PROMO%' AS promo, p_size > 25 AS listed,
CASE WHEN p_size > 25 THEN 'list;' ELSE '' END || 'nat;' AS types FROM part""")
def term_patterns(t: Tables) -> DataFrame:
    """Formulas made of parts' columns, by their size, patterns and types."""
    nat, listed = '["t","nat"]', '["t","list",["t","nat"]]'
    kind = F.when(F.col("p_size") > 25, F.lit(listed)).otherwise(F.lit(nat))
    left = F.concat(F.lit('["c","n'), F.col("p_size").cast("string"), F.lit(f'",{nat}]'))
    body = F.concat(F.lit(f'["a",["c","eq",{nat}],'), left, F.lit(f',["c","n1",{nat}],["f",'), F.expr("substring(to_json(array(p_brand)), 2, length(to_json(array(p_brand))) - 2)"), F.lit(","), kind, F.lit("]]"))
    formula = F.when(F.col("p_type").startswith("PROMO"), F.concat(F.lit(f'["l","x",{nat},'), body, F.lit("]"))).otherwise(body)
    rows = t.part.select("p_partkey", formula.alias("f"))
    m = terms.matches(F.col("f"), [f'["a",["c","eq",{nat}],["v","x",{nat}],["v","x",{nat}]]', f'["l","y",{nat},["a",["c","eq",{nat}],["v","a",{nat}],["v","b",{nat}],["v","c",{nat}]]]'], [listed])
    names = F.array_join(F.transform(F.filter(terms.dependencies(F.col("f")), lambda d: d["kind"] == "type"), lambda d: F.concat(d["name"], F.lit(";"))), "")
    return rows.select("p_partkey", terms.size(F.col("f")).alias("size"), m.alias("m"), names.alias("types")).select("p_partkey", "size", F.col("m")[0].alias("same"), F.col("m")[1].alias("promo"), F.col("m")[2].alias("listed"), "types")


@query(r"""SELECT item_id, '#Fact' || chr(10) || CASE WHEN len(w) <= 57 THEN '###Variables' || chr(10) || 'set' || chr(10) || chr(10) || '###Statement' || chr(10) || text
ELSE '###Variables set ###Statement ' || array_to_string(list_slice(w, 1, 57), ' ') END AS prompt
FROM (SELECT item_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark)""")
def fact_prompts(t: Tables) -> DataFrame:
    """Items as facts of 60 words at most."""
    return t.benchmark.select("item_id", prompts.facts(F.col("text"), F.array(F.lit("set")), F.lit(None).cast("string"), 60).alias("prompt"))
