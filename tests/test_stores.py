"""Codec, snapshots, providers and walks on small fixtures."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ferrule.functions import records as rec
from ferrule.functions import vectors
from ferrule.operators import embedding, graphs, upkeep
from ferrule.sources import codec, layers, shared, snapshot
from ferrule.streaming import incremental


@pytest.mark.parametrize("value", [None, True, False, 0, -1, -33, 127, 128, 1 << 40, -(1 << 40), 1.5, "", "é" * 40, b"", b"x" * 300, [], [1, [2, "x"]], list(range(40)), {"a": 1, "b": [None]}])
def test_pack(value):
    assert codec.unpack(codec.pack(value)) == value


def test_records(spark):
    full = [2, "A.b", "x = y", "says", {"qualifier": "q"}, [["T", b"h" * 16]], None, None, b"d" * 16, [b"k"], 5, 6, ["f.thy", 3, 9], "coll"]
    rows = [
        (b"a" * 32, codec.pack(full)), (b"b" * 32, codec.pack(full[:6])), (b"c" * 32, codec.pack([8, "e", json.dumps(["p", "q"]), "when"])), (b"d" * 32, codec.pack([8, "e", "[broken", "when"])),
        (b"s" * 16, codec.pack({"finished": True})), (b"t" * 32, b""), (b"u" * 32, b"\xc1"), (b"v" * 32, codec.pack("text")), (b"w" * 32, codec.pack(full)[:-2]),
    ]
    store = spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in rows], "uk binary, value binary")
    got = {bytes(r["uk"])[:1]: r for r in codec.records(store).collect()}
    assert set(got) == {b"a", b"b", b"c", b"d"}
    a = got[b"a"]
    assert (a["kind"], a["name"], a["version"], a["position"]["line"], a["from_collection"], a["constituents"][0]["name"]) == (2, "A.b", 5, 3, "coll", "T")
    assert got[b"b"]["version"] is None and got[b"c"]["goal_patterns"] == ["p", "q"] and got[b"c"]["expr"] is None and got[b"d"]["goal_patterns"] is None
    again = codec.records(codec.records(store).select("uk", codec.encode(F.struct(*[f.name for f in codec.RECORD])).alias("value")))
    assert {bytes(r["uk"])[:1]: r for r in again.collect()} == got
    marks = spark.createDataFrame([(bytearray(codec.pack({b"finished": True})),), (bytearray(b""),)], "v binary").select(codec.status(F.col("v")).alias("s")).collect()
    assert [r["s"]["finished"] for r in marks] == [True, None]


def test_snapshots(spark, tmp_path):
    at = f"file://{tmp_path}"
    tables = {"records": spark.range(10).toDF("uk"), "vectors": spark.range(4).toDF("uk")}
    manifest = snapshot.export(spark, tables, f"{at}/one")
    assert manifest["tables"]["records"]["entries"] == 10 and snapshot.check(spark, f"{at}/one") == manifest
    with pytest.raises(ValueError, match="gap"):
        snapshot.export(spark, tables, f"{at}/two", {"gap": spark.range(1)})
    assert snapshot.find(spark, [f"{at}/none", f"{at}/one"]) == f"{at}/one" and snapshot.find(spark, [f"{at}/two"]) is None
    assert snapshot.install(spark, f"{at}/one", f"{at}/system") and not snapshot.install(spark, f"{at}/one", f"{at}/system") and snapshot.install(spark, f"{at}/one", f"{at}/system", force=True)
    (tmp_path / "system").rename(tmp_path / "system.old")
    snapshot.heal(spark, f"{at}/system")
    assert spark.read.parquet(f"{at}/system/records").count() == 10 and not (tmp_path / "system.old").exists()
    spark.range(3).toDF("uk").write.mode("append").parquet(f"{at}/one/records")
    with pytest.raises(ValueError, match="differs"):
        snapshot.install(spark, f"{at}/one", f"{at}/system")
    snapshot.backup(spark, f"{at}/system", f"{at}/copy")
    assert snapshot.check(spark, f"{at}/copy") == manifest
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet")
    assert snapshot.set_aside(spark, f"{at}/bad", tables["records"].schema).count() == 0
    builds = spark.createDataFrame([("a", "2.9", 1), ("b", "2.10", 0), ("c", "2.10", 3), ("d", "2.rc", 9)], "file string, version string, build_number int")
    assert snapshot.newest_build(builds).first()["file"] == "c"


def test_missing_vectors_are_made_before_a_search(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green pear"), (3, "red pear tree"), (4, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, q array<int>")
    queries = spark.createDataFrame([(1, "red apple"), (2, "pear")], "query_id long, text string")
    hits, new = embedding.search(docs, none, queries, "doc_id", "text", "words", 3)
    assert {r["doc_id"] for r in new.collect()} == {1, 2, 3}
    best = {r["query_id"]: r["doc_id"] for r in hits.filter("rank = 1").collect()}
    assert best == {1: 1, 2: 2}
    counts = embedding.complete(docs, new.filter("doc_id = 1"), "doc_id", "text", "words")[1].first()
    assert tuple(counts) == (3, 1, 2)
    got, fresh = embedding.embed_cached(docs.union(docs), "text", "words", spark.createDataFrame([], "digest string, q array<int>"))
    assert fresh.count() == 3 and got.filter("q is not null").count() == 6
    order = embedding.rerank(hits, docs, queries, "doc_id", "overlap", 2).collect()
    assert {(r["query_id"], r["rank"]): r["doc_id"] for r in order}[1, 1] == 1 and len(order) == 4


def test_providers_are_tried_again():
    tries = []

    def shaky(texts):
        tries.append(1)
        if len(tries) < 4:
            raise OSError
        return [[1.0]] * len(texts)

    assert embedding.called(shaky, ["a"]).shape == (1, 1) and len(tries) == 4
    with pytest.raises(OSError):
        embedding.called(lambda texts: (_ for _ in ()).throw(OSError()), ["a"])


def test_walks(spark):
    edges = spark.createDataFrame([(i, 2 * i) for i in range(1, 50)] + [(i, 2 * i + 1) for i in range(1, 50)], "src long, dst long")
    got = {r["node"]: r["level"] for r in graphs.closure(edges, spark.createDataFrame([(1,)], "node long"), shared.tables(spark, "walk"), 20).collect()}
    assert got == {n: n.bit_length() - 1 for n in range(1, 32)}
    nodes = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "node long, name string, content string")
    links = spark.createDataFrame([(2, 0, 1), (3, 0, 1), (3, 1, 2)], "node long, place int, parent long")
    one = {r["node"]: bytes(r["hash"]) for r in graphs.merkle(nodes, links, shared.tables(spark, "m1")).collect()}
    other = nodes.withColumn("content", F.when(F.col("node") == 1, "new").otherwise(F.col("content")))
    two = {r["node"]: bytes(r["hash"]) for r in graphs.merkle(other, links, shared.tables(spark, "m2")).collect()}
    assert len(one) == 3 and all(one[i] != two[i] and len(one[i]) == 16 and one[i][0] % 2 == 0 for i in one)
    with pytest.raises(ValueError, match="cycle"):
        graphs.merkle(nodes, links.union(spark.createDataFrame([(1, 0, 3)], links.schema)), shared.tables(spark, "m3"))


def test_merkle_sends_no_level_through_the_driver(spark):
    parents = {n: [n // 2, n // 3, n // 2][: n % 4] for n in range(1, 40)} | {0: []}
    nodes = spark.createDataFrame([(n, f"n{n}", f"c{n}" if n % 5 else None) for n in parents], "node long, name string, content string")
    links = spark.createDataFrame([(n, i, p) for n, ps in parents.items() for i, p in enumerate(ps)] + [(99, 0, 1)], "node long, place int, parent long")
    plans, put = [], shared.tables(spark, "m4")

    def save(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(df, name)

    expected = {}
    for n in sorted(parents):
        text = "\0".join([f"n{n}", f"c{n}" if n % 5 else "", ",".join(expected[p].hex() for p in parents[n])])
        raw = bytearray(hashlib.sha256(text.encode()).digest()[:16])
        raw[0] -= raw[0] % 2
        expected[n] = bytes(raw)
    assert {r["node"]: bytes(r["hash"]) for r in graphs.merkle(nodes, links, save).collect()} == expected
    assert not any("Broadcast" in x for x in plans)


def test_guards(spark):
    view = spark.createDataFrame([(1, "a")], "uk long, name string")
    with pytest.raises(ValueError, match="embedded"):
        layers.backfill(view, view, "uk", "name")
    with pytest.raises(ValueError, match="orphans"):
        upkeep.gate(view, "orphans")
    df = spark.createDataFrame([([1, 2],), ([1, 2, 3],), (None,)], "q array<int>")
    assert df.filter("q is null or size(q) = 2").select(vectors.decode_checked(F.col("q"), 2)).count() == 2
    for wrong in (3, 1):
        with pytest.raises(Exception, match="migrated|length"):
            spark.createDataFrame([([0] * (2 * wrong),)], "q array<int>").select(vectors.decode_checked(F.col("q"), wrong if wrong == 3 else 5)).collect()
    with pytest.raises(Exception, match="must not contain"):
        spark.createDataFrame([("a", "{text}")], "x string, t string").select(rec.apply_template("{task} {text}", F.col("x"), F.col("t"))).collect()


def test_texts_and_keys(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert row(rec.single_line(F.lit("lemma a:\r\n  b begin"))) == "lemma a: b"
    assert [row(rec.human_bytes(F.lit(n))) for n in (5, 2048, 5 << 20)] == ["5 B", "2.0 KiB", "5.0 MiB"]
    assert row(rec.has_suffix(F.lit("a.b.c"), F.lit("b.c"))) and not row(rec.has_suffix(F.lit("a.xb.c"), F.lit("b.c")))
    assert row(rec.live_name(F.lit("n"), F.lit("m(2)"), F.lit("c"))) == "m(2)" and row(rec.live_name(F.lit("n"), F.lit("m"), F.lit("c"))) == "n"
    key = F.unhex(F.lit("01" + "00" * 31))
    assert not row(rec.is_persistent(key)) and row(rec.ships(key, F.array(F.unhex(F.lit("02" * 16))), F.lit(True)))
    assert [row(rec.value_class(F.unhex(F.lit("00" * n)), 8)) for n in (0, 8, 3)] == ["tombstone", "vector", "marker"]
    assert row(rec.without_surrogates(F.lit("a b"))) == "a b"


def test_streamed_upserts(spark, tmp_path):
    incoming, log = tmp_path / "in", str(tmp_path / "log")
    rows = [(1, 1, "a"), (2, 2, "b"), (1, 3, "c")]
    schema = "uk long, seq long, value string"
    spark.createDataFrame(rows, schema).write.parquet(str(incoming))
    stream = lambda: spark.readStream.schema(schema).parquet(str(incoming))
    incremental.upserts(stream(), log, str(tmp_path / "ck"), "uk", "seq").awaitTermination(60)
    spark.createDataFrame([(2, 4, "d")], schema).write.mode("append").parquet(str(incoming))
    incremental.upserts(stream(), log, str(tmp_path / "ck"), "uk", "seq").awaitTermination(60)
    got = layers.compact(spark.read.parquet(log).drop("batch"), "uk", "seq")
    assert sorted((r["uk"], r["value"]) for r in got.collect()) == [(1, "c"), (2, "d")]
    assert spark.read.parquet(log).count() == 3


def test_a_store_from_first_record_to_snapshot(spark, tmp_path):
    from ferrule.store import SCHEMAS, Store, main

    store = Store(spark, f"file://{tmp_path}/store")
    row = lambda uk, theory, kind, text, parts=None, patterns=None, lasting=True: (uk, theory, kind, f"n_{uk}", "x", text, parts, patterns, lasting)
    put = lambda *rows: spark.createDataFrame(list(rows), SCHEMAS["records"])
    store.append("registry", spark.createDataFrame([("aa", "A", 1), ("ab", "A", 2), ("cc", "B", 1)], SCHEMAS["registry"]))
    store.put(put(row("1", "aa", 2, "red apple"), row("2", "ab", 2, "green pear"), row("3", "cc", 1, None), row("4", "cc", 2, "blue sky", None, None, False)))
    store.put_experience(put(row("5", None, 8, "pears are red", ["aa", "cc"], ["?a = ?b"])), "words")
    queries = spark.createDataFrame([(1, "red apple")], "query_id long, text string")
    hits = store.query_knn(queries, "words", 2).orderBy("rank").collect()
    assert hits[0]["uk"] == "1" and store.models() == ["words"] and store.view("vectors").count() == 4
    assert "5" not in {r["uk"] for r in store.query_knn(queries, "words", 9, loaded=["aa"]).collect()}
    assert store.query_knn(queries, "words", 9, kinds=[1]).count() == 0
    store.put(put(row("1", "aa", 2, "a new text")))
    assert store.view("vectors").filter("uk = '1'").count() == 0  # invalid until it is embedded again
    assert store.embed_missing("words") == {"missing": 2, "unrenderable": 1, "embedded": 1}
    assert store.fsck()["records"] == 5 and {r["state"] for r in store.generations(1).filter("doomed").selectExpr("theory as state").collect()} == {"aa"}
    assert main([store.path, "prune", "1"], spark) == "1" and store.view("records").count() == 5
    assert store.clean_unfinished() == 1 and store.remove(["aa"], dry=True) == 2
    with pytest.raises(ValueError, match="ambiguous"):
        store.remove(["A"])
    manifest = store.export(f"file://{tmp_path}/out")
    assert manifest["tables"]["records"]["entries"] == 4
    other = Store(spark, f"file://{tmp_path}/other")
    assert other.pull(f"file://{tmp_path}/out") and not other.pull(f"file://{tmp_path}/out")
    found = other.delete(spark.createDataFrame([("1",), ("9",)], "uk string"))
    assert {r["uk"]: r["was_visible"] for r in found.collect()} == {"1": True, "9": False}
    assert other.status()["records"] == {"user": 0, "tombstones": 2, "system": 4} and other.view("records").count() == 3
    assert other.reindex() == 2 and other.fsck(fix=True)["orphan vectors"] == 0
    assert {r["uk"]: r["found"] for r in other.contains(spark.createDataFrame([("1",), ("2",)], "uk string")).collect()} == {"1": False, "2": True}


def test_migrations(spark, tmp_path):
    from ferrule.operators import migrate

    h = lambda c: c * 32
    rows = spark.createDataFrame([("k1", h("a"), "01", [("A", h("a"))]), ("k2", None, "02", [("A", h("a")), ("B", h("b"))]), ("k3", h("d"), "03", None)], "uk string, theory string, tail string, constituents array<struct<name:string,hash:string>>")
    mapping = spark.createDataFrame([(h("a"), "A", h("1")), (h("b"), "B", h("2")), (h("b"), "C", h("3"))], "old string, name string, new string")
    got = {r["uk"]: r["new_uk"] for r in migrate.rekeyed(rows, mapping).collect()}
    assert got == {"k1": h("1") + "01", "k2": h("3") + "02", "k3": h("d") + "03"}  # 1 xor 2 is 3
    with pytest.raises(ValueError, match="share a key"):
        migrate.rekeyed(rows.withColumn("tail", F.lit("00")).withColumn("constituents", F.lit(None).cast(rows.schema["constituents"].dataType)).withColumn("theory", F.lit(h("a"))), mapping)
    members = spark.createDataFrame([("1", "t", 2, "c(1)", None), ("2", "t", 2, "c", 5), ("3", "t", 7, "m(1)", None)], "uk string, theory string, kind int, name string, position int")
    bins = spark.createDataFrame([("t", "c")], "theory string, name string")
    assert {r["uk"]: r["from_collection"] for r in migrate.classified(members, bins).collect()} == {"1": "c", "2": None, "3": None}
    with pytest.raises(ValueError, match="no collection"):
        migrate.classified(members, bins.limit(0))
    (tmp_path / "deps.tsv").write_text("DEP\tA\ttrue\t/a\t\nother\nDEP\tB\tfalse\t/b\tA,C\n")
    assert sorted((r["node"], r["parent"] or "") for r in migrate.read_dependencies(spark, str(tmp_path / "deps.tsv")).collect()) == [("A", ""), ("B", "A"), ("B", "C")]
    names = spark.createDataFrame([("x.a",), ("y.a",), ("x.b",), ("b",)], "name string")
    asked = spark.createDataFrame([("a",), ("b",), ("x.a",), ("z",)], "asked string")
    assert {r["asked"]: (r["name"], r["state"]) for r in migrate.prune_targets(names, asked).collect()} == {"a": (None, "ambiguous"), "b": ("b", "exact"), "x.a": ("x.a", "exact"), "z": (None, "missing")}
    old = spark.createDataFrame([(8, '["p"]', None), (8, "[broken", None), (2, "e", None)], "kind int, expr string, goal_patterns array<string>")
    assert [(r["expr"], r["goal_patterns"]) for r in migrate.list_patterns(old).collect()] == [(None, ["p"]), (None, None), ("e", None)]
    q, counts = migrate.quantised(spark.createDataFrame([("1", [1.0, 0.0]), ("2", [1.0])], "uk string, v array<float>"), 2)
    assert q.first()["q"][0] == 31130 and {r["format"]: r["n"] for r in counts.collect()} == {"float32": 1, "other": 1}
    assert migrate.padded(old, {"version": "long"}).columns[-1] == "version" and migrate.without_kinds(old, [8]).count() == 1
    assert {r["kind"]: (r["have"], r["lack"]) for r in migrate.positions_missing(members).collect()} == {2: (1, 1), 7: (0, 1)}
    theories = spark.createDataFrame([("a1", "A", 1, True), ("a2", "A", 2, False), ("a3", "A", 0, True)], "theory string, name string, ts long, finished boolean")
    assert migrate.newest_finished(theories).first()["theory"] == "a1"
    moved = migrate.hash_change(spark.createDataFrame([("r", "a1"), ("s", "a2")], "uk string, theory string"), theories, F.col("name") == "A", "new")
    assert [(r["uk"], r["theory"]) for r in moved.collect()] == [("r", "new")]


def test_integers_beside_nulls_stay_exact(spark):
    kind = "kind int, name string, expr string, interpretation string, provenance map<string,string>, constituents array<struct<name:string,hash:binary>>, experience string, goal_patterns array<string>, digest binary, deps array<binary>, version long, interpreted_at long, position struct<file:string,line:int,col:int>, from_collection string"
    rows = [(1, "a", None, None, {"k": "00ff"}, [("T", bytearray(b"h" * 16))], None, ["p"], None, [bytearray(b"d")], 2**53 + 1, None, ("f", 3, 4), None), (2, "b", None, None, None, None, None, None, None, None, None, 2**62 + 3, None, None)]
    df = spark.createDataFrame(rows, kind).coalesce(1)
    back = df.select(codec.decode(codec.encode(F.struct(*df.columns))).alias("r")).select("r.*").collect()
    assert [(r["version"], r["interpreted_at"]) for r in back] == [(2**53 + 1, None), (None, 2**62 + 3)]
    assert back[0]["constituents"][0]["name"] == "T" and back[0]["position"]["line"] == 3 and back[0]["provenance"] == {"k": "00ff"} and back[1]["constituents"] is None


def test_damaged_bytes_are_dropped(spark):
    nested = b"\x91" * 5000 + b"\xc0"
    df = spark.createDataFrame([(bytearray(nested),), (bytearray(b"\x85\xa1"),), (bytearray(b"\xc1"),), (None,)], "v binary")
    got = df.select(codec.decode(F.col("v")).alias("r"), codec.status(F.col("v")).alias("s")).collect()
    assert all(r["r"]["kind"] is None and r["s"]["finished"] is None for r in got)


def test_of_a_key_given_twice_the_last_row_wins(spark, tmp_path):
    from ferrule.store import Store

    store = Store(spark, str(tmp_path / "store"))
    key = bytearray(b"k" * 16 + b"\x01x")
    store.put(spark.createDataFrame([(key, 1, f"n{i}") for i in range(40)], "uk binary, kind int, name string").coalesce(1))
    assert [r["name"] for r in store.user("records").collect()] == ["n39"]


def test_a_passing_failure_leaves_a_table(spark, tmp_path):
    with pytest.raises(Exception, match="(?i)no such|not exist|not found"):
        snapshot.set_aside(spark, str(tmp_path / "absent"), "a long")
    assert not list(tmp_path.glob("absent.corrupt*"))


def test_records_of_a_large_batch_come_back(spark):
    """More rows than are Python objects at once, in one batch, with tombstones and damaged bytes between them."""
    n = 3 * codec.ROWS + 1
    values = {"kind": F.lit(2), "name": F.concat(F.lit("n"), F.col("id")), "version": F.col("id")}
    fields = F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in codec.RECORD))
    body = F.when(F.col("id") % 7 == 0, F.unhex(F.lit(""))).when(F.col("id") % 5 == 0, F.unhex(F.lit("c1ff"))).otherwise(codec.encode(fields))
    store = spark.range(n).coalesce(1).select(F.encode(F.lpad(F.col("id").cast("string"), 20, "0"), "utf-8").alias("uk"), body.alias("value"))
    got = sorted((r["version"], r["name"]) for r in codec.records(store).select("version", "name").collect())
    assert got == [(i, f"n{i}") for i in range(n) if i % 7 and i % 5]
