"""Operators against brute force on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.operators import index, relational
from ferrule.plans import queries
from ferrule.sources import shared
from ferrule.streaming import incremental


@pytest.mark.parametrize("seed", range(4))
def test_islands_over_block_edges(spark, seed):
    rng = random.Random(seed)
    points = sorted({rng.randrange(200) for _ in range(rng.choice([0, 1, 90, 190]))} | ({*range(65530, 65545)} if seed else set()))
    expected, last = [], None
    for x in points:
        if last is not None and x == last + 1:
            expected[-1][1] = x
        else:
            expected.append([x, x])
        last = x
    df = spark.createDataFrame([(x,) for x in [*points, *points[:3], None]], "x long")
    for width in (4, 65536):
        assert sorted(map(list, relational.islands(df, "x", width).collect())) == expected


@pytest.mark.parametrize("n,edges", [(40, 0.5), (60, 1.0), (60, 2.0), (300, 1.0)])
def test_effective_versions_on_graphs_with_cycles(spark, n, edges):
    rng = random.Random(int(n * edges))
    nodes = [(i, rng.choice([None, rng.randrange(1000)])) for i in range(n)]
    links = {(rng.randrange(n), rng.randrange(n + 3)) for _ in range(int(n * edges))} if n < 300 else {(i, (i + 1) % n) for i in range(n)}
    to = {}
    for a, b in links:
        to.setdefault(a, set()).add(b)
    version = {i: v or 0 for i, v in nodes}

    def closure(i):
        seen, todo = {i}, [i]
        while todo:
            for b in to.get(todo.pop(), ()):
                if b not in seen and b in version:
                    seen.add(b)
                    todo.append(b)
        return max(version[x] for x in seen)

    got = incremental.effective_versions(spark.createDataFrame(nodes, "node long, version long"), spark.createDataFrame(sorted(links), "src long, dst long"), shared.tables(spark, "test"))
    assert {r["node"]: r["eff"] for r in got.collect()} == {i: closure(i) for i in version}


@pytest.mark.parametrize("k", [0, 1, 7, 500])
def test_top_k_against_all_scores(spark, k):
    rng = np.random.default_rng(k)
    rows = rng.integers(-29000, 29000, (300, 16)) // rng.choice([1, 4, 64], (300, 1))
    rows[50] = rows[51]
    data = [(i, [int(x) for x in r]) for i, r in enumerate(rows)] + [(900, None)]
    df = spark.createDataFrame(data, "vec_id long, q array<int>").repartition(5)
    got = {}
    for r in relational.top_k(df, df.filter("vec_id % 20 = 0"), k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, 300, 20) if k else ():
        dots = ((rows * rows[q] + 16384) >> 15).sum(1)
        assert got[q] == sorted(range(300), key=lambda i: (-dots[i], i))[:k]
    assert k or not got


def most_rows(df):
    """Of a task of the result, as Spark plans it."""
    return max(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect())


def test_index_update_holds_few_rows_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(index, "TASK", 500, raising=False)
    out = queries.QUERIES["index_update"](spark, "/root/testdata/sf0.01")
    assert out.count() == 48119 and most_rows(out) < 1000


def test_index_candidates_holds_few_rows_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(index, "TASK", 500, raising=False)
    out = queries.QUERIES["index_candidates"](spark, "/root/testdata/sf0.01")
    assert out.count() == 13193 and most_rows(out) < 1000


def test_index_candidates_stays_dealt_where_spark_broadcasts_nothing(spark, monkeypatch):
    monkeypatch.setattr(index, "TASK", 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = queries.QUERIES["index_candidates"](spark, "/root/testdata/sf0.01")
        assert out.count() == 13193 and most_rows(out) < 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_index_candidates_by_short_and_long_lists(spark, monkeypatch, most):
    monkeypatch.setattr(index, "LOADED", most, raising=False)
    entries = spark.createDataFrame([(1, 5), (1, 6), (1, 6), (2, None), (3, 7), (4, 5), (None, 6), (5, 9)], "loaded long, part long")
    for parts, keys in (((6, 6, None), {1, 2, None}), ((), {2}), ((5, 9), {1, 2, 4, 5}), ((None,), {2})):
        got = [r[0] for r in index.candidates(entries, spark.createDataFrame([(p,) for p in parts], "part long")).collect()]
        assert len(got) == len(keys) and set(got) == keys


def test_index_keeps_what_is_always_available(spark):
    rows = spark.createDataFrame([(1, [5, 6, 5]), (2, []), (3, None), (4, [7])], "key long, parts array<long>")
    built = index.build(rows, "key", "parts")
    assert sorted(map(tuple, built.collect()), key=str) == [(1, 5), (1, 6), (2, None), (4, 7)]
    assert sorted(r[0] for r in index.candidates(built, spark.createDataFrame([(6,), (6,)], "part long")).collect()) == [1, 2]
    again = index.add(built, rows, "key", "parts")
    assert again.count() == 4 and index.remove(again, rows.select("key").filter(F.col("key") < 3), "key").count() == 1
