"""Filters, phrases and both legs of the site search against plain models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ferrule.operators import search, site
from ferrule.operators.search import K1, B
from ferrule.sources import shared


def corpus(n=300):
    rng = random.Random(2)
    rare = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        size = rng.randint(0, 60)
        docs.append((i, [rng.choice(["the", "of", "a"]) if rng.random() < 0.5 else rng.choice(rare[: 20 + i]) for _ in range(size)]))
    return [*docs, (n, []), (n + 1, ["", "the", ""]), (n + 2, docs[5][1]), (n + 3, ["the"] * 5000)]


def scores(docs, words):
    docs = [(i, [w for w in d if w]) for i, d in docs if any(d)]
    mean = sum(len(d) for _, d in docs) / len(docs)
    out = {}
    for i, d in docs:
        total = 0.0
        for w in {x for x in words if x}:
            df, tf = sum(w in e for _, e in docs), d.count(w)
            if tf:
                total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(d) / mean))
        if total:
            out[i] = total
    return out


@pytest.fixture(scope="module")
def built(spark):
    docs = corpus()
    kept = {}
    save = shared.tables(spark, "site-test")

    def watched(df, name):
        kept[name] = save(df, name)
        return kept[name]

    return docs, site.build(spark.createDataFrame(docs, "doc long, words array<string>").repartition(3), watched), kept


def test_best_words_against_all_scores(spark, built):
    docs, index, kept = built
    rng = random.Random(3)
    queries = [(q, rng.sample([f"w{i}" for i in range(300)], rng.randint(1, 4)) + rng.choice([[], ["the"], ["the", "of", "the", "nowhere"]])) for q in range(12)] + [(50, ["the", "of", "a"]), (51, []), (52, ["nowhere"])]
    mask = [i for i, _ in docs if i % 3]
    for k, allowed in ((3, None), (10, mask), (10_000, mask)):
        m = None if allowed is None else spark.createDataFrame([(i,) for i in allowed], "doc long")
        got = site.best_words(index, spark.createDataFrame(queries, "query long, words array<string>"), k, m).collect()
        for q, words in queries:
            plain = {i: s for i, s in scores(docs, words).items() if allowed is None or i in allowed}
            best = sorted(plain, key=lambda i: (-round(plain[i], 6), i))[:k]
            mine = {r["doc"]: r["score"] for r in got if r["query"] == q}
            assert sorted(mine, key=lambda i: (-round(mine[i], 6), i)) == best
            assert all(math.isclose(mine[i], plain[i], rel_tol=1e-9) for i in best)
        if k == 3:  # a common word beside a rare one brings no documents of its own
            reached = sum(len(scores(docs, words)) for _, words in queries)
            assert kept["candidates"].count() < reached / 3


def test_phrases_by_positions(spark, built):
    docs, index, _ = built
    asked = [(1, ["the", "of"]), (2, ["the", "the", "the"]), (3, docs[7][1][2:5]), (4, ["of", "nowhere"]), (5, []), (6, ["a"])]
    got = {(r["query"], r["doc"]) for r in site.phrases(index, spark.createDataFrame(asked, "query long, words array<string>")).collect()}
    holds = lambda d, p: bool(p) and any(d[i : i + len(p)] == p for i in range(len(d)))
    assert got == {(q, i) for q, p in asked for i, d in docs if holds(d, p)}


def test_filter_tree(spark):
    rows = [(1, "inf", "order_less", "a < b", ["A B"]), (2, "sup", "less_order", "less order", ["C"]), (3, "inf", None, "x", []), (4, "max", "one", None, ["A", "B"])]
    df = spark.createDataFrame(rows, "i int, kind string, name string, expr string, theories array<string>")
    cut = lambda c: F.split(c, "[ _]")
    fields = {"name": cut("name"), "expr": cut("expr")}
    type_ = lambda text: text.replace("_", " ").split()
    one = lambda *a: site.condition(*a[:2], type_, *a[2:])
    run = lambda conditions, kinds=(): [r[0] for r in df.filter(site.predicate(conditions, fields, F.col("kind"), kinds, {"name": F.col("name")})).select("i").orderBy("i").collect()]
    assert run([]) == [1, 2, 3, 4] and run([], ["inf", "max"]) == [1, 3, 4]
    assert run([one("name", "order less")]) == [1] and run([one(site.ALL, "less order")]) == [2]
    assert run([one("name", "order_less", True)]) == [2, 3, 4] and run([one(site.ALL, "less", True)]) == [3, 4]
    assert run([one("name", "less"), one("expr", "less", True)], ["inf", "sup"]) == [1]
    for bad in ("_", "", "x" * 600):
        with pytest.raises(ValueError):
            one("name", bad)
    with pytest.raises(ValueError):
        site.predicate([site.Condition("name", ())], fields)
    theories = df.select("i", site.theories_of(F.col("kind") == "inf", F.col("theories"), F.concat(F.lit("Own."), "kind")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in theories] == [["A B"], ["Own.sup"], [], ["Own.max"]]


def test_an_index_is_one_table_and_rows_of_a_document_stay_apart(spark):
    """Words with the separator and repeated documents count; a phrase doesn't go from one row to another."""
    docs = [(1, ["a", "b"]), (1, ["x", "c"]), (2, ["a\x01", "c", "a"]), (3, ["a", "c", "", "b"]), (None, ["a", "c"])]
    frame, kept = spark.createDataFrame(docs, "doc long, words array<string>"), []
    save = shared.tables(spark, "site-rows")

    def watched(df, name):
        kept.append(name)
        return save(df, name)

    words = site.build(frame, watched, positions=False)
    assert kept == ["blocks"]
    asked = [(1, ["a", "c"]), (2, ["a\x01"]), (3, ["b"])]
    queries = spark.createDataFrame(asked, "query long, words array<string>")
    merged = [(1, ["a", "b", "x", "c"]), *docs[2:]]
    for got in (site.best_words(words, queries, 5).collect(), search.bm25(frame, queries, "doc", "query", 5).collect()):
        for q, w in asked:
            plain = {i: s for i, s in scores(merged, w).items() if i is not None}
            mine = {r["doc"]: r["score"] for r in got if r["query"] == q}
            assert mine.keys() == plain.keys() and all(math.isclose(mine[i], plain[i], abs_tol=1e-4) for i in plain)
    places = site.build(frame, watched, impacts=False)
    assert kept.count("places") == 1
    assert {(r["query"], r["doc"]) for r in site.phrases(places, queries).collect()} == {(1, 3), (2, 2), (3, 1), (3, 3)}


def shuffled(spark):
    """Rows that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_search_leaves_the_index_where_it_lies(spark, built):
    """Also where Spark broadcasts nothing by itself: only postings that are asked for are shuffled, and few times."""
    docs, index, _ = built
    queries = spark.createDataFrame([(1, ["w3", "w7"]), (2, ["w7", "w11", "nowhere"])], "query long, words array<string>")
    mask = spark.createDataFrame([(i,) for i, _ in docs if i % 3], "doc long")
    postings = sum(len({w for w in d if w}) for _, d in docs)
    before, began = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert site.best_words(index, queries, 5, mask).count() == 10
        assert shuffled(spark) - began < postings / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(("asked", "sent", "pairs"), [(10**6, 10**6, 100), (0, 0, 10**6)])
def test_best_words_within_other_limits(spark, built, monkeypatch, asked, sent, pairs):
    """Whatever goes to all tasks, and whether bounds leave out much (few rare words, k of 2) or nothing (k of 500)."""
    for name, value in (("ASKED", asked), ("SENT", sent), ("PAIRS", pairs)):
        monkeypatch.setattr(site, name, value, raising=False)
    docs, index, kept = built
    rare = [(1, ["w3", "the"]), (2, ["w150", "of", "the"]), (None, ["w9"])]
    long = [(q, [f"w{i}" for i in range(q, 60, 5)] + ["the", "of", "a"]) for q in range(3)]
    mask = [i for i, _ in docs if i % 3]
    for queries, k, allowed in ((rare, 2, mask), (long, 500, mask)):
        m = spark.createDataFrame([(i,) for i in [*allowed, *allowed[:9], None]], "doc long")
        got = site.best_words(index, spark.createDataFrame(queries, "query long, words array<string>"), k, m).collect()
        if sent:
            assert ("score" in kept["candidates"].columns) == (k == 500)
        for q, words in queries:
            plain = {i: s for i, s in scores(docs, words).items() if i in allowed}
            best = sorted(plain, key=lambda i: (-round(plain[i], 6), i))[:k]
            mine = {r["doc"]: r["score"] for r in got if r["query"] == q}
            assert len(mine) == sum(r["query"] == q for r in got)
            assert sorted(mine, key=lambda i: (-round(mine[i], 6), i)) == best
            assert all(math.isclose(mine[i], plain[i], rel_tol=1e-9) for i in best)


def test_a_search_of_nothing(spark):
    save = shared.tables(spark, "site-nothing")
    none, some = (spark.createDataFrame(rows, "doc long, words array<string>") for rows in ([], [(1, ["a", ""]), (2, None), (None, ["a"])]))
    ask = lambda *words: spark.createDataFrame([(1, list(w)) for w in words], "query long, words array<string>")
    assert site.best_words(site.build(none, save, positions=False), ask(["a"]), 3).count() == 0
    index = site.build(some, save, positions=False)
    assert [r["doc"] for r in site.best_words(index, ask(["a", ""]), 3).collect()] == [1]
    assert site.best_words(index, ask([""], []), 3).count() == 0
    assert site.best_words(index, ask(["a"]), 3, none.select("doc")).count() == 0


def test_an_index_is_made_in_tasks_of_few_words(spark, built, monkeypatch):
    monkeypatch.setattr(search, "WORDS", 500, raising=False)
    docs, index, _ = built
    save, most = shared.tables(spark, "site-tasks"), []

    def watched(df, name):
        most.append(df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
        return save(df, name)

    again = site.build(spark.createDataFrame(docs, "doc long, words array<string>"), watched, positions=False)
    assert most[0] < 1000
    assert sorted(map(tuple, again.blocks.collect())) == sorted(map(tuple, index.blocks.collect()))
