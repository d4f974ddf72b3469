"""Digests of tables and ranges, aggregates with merging states, table functions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from ferrule.functions import user
from ferrule.sources import ranges, shared, snapshot


def test_digest_counts_repeated_rows(spark):
    table = lambda *v: spark.createDataFrame([(x,) for x in v], "a long")
    digests = [snapshot.digest(table(*v)) for v in ((1, 1), (2, 2), (1,), (1, 2), (1, 1, 1, 2), (1, 2, 2, 2))]
    assert len(set(digests)) == 6 and snapshot.digest(table(2, 1, 1)) == snapshot.digest(table(1, 2, 1).repartition(3))
    empty, null, texts = spark.createDataFrame([], "a string"), spark.createDataFrame([(None,)], "a string"), spark.createDataFrame([("",), ("null",)], "a string")
    assert len({snapshot.digest(x) for x in (empty, null, texts)}) == 3 and snapshot.digest(empty) == "0-0-0"


def test_an_altered_table_is_not_installed(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    snapshot.export(spark, {"t": spark.createDataFrame([(1,), (1,)], "a long")}, at)
    assert snapshot.check(spark, at)
    spark.createDataFrame([(2,), (2,)], "a long").write.mode("overwrite").parquet(f"{at}/t")
    with pytest.raises(ValueError):
        snapshot.check(spark, at)


def test_changed_ranges_alone_are_read(spark, tmp_path):
    rows = [(i, f"v{i % 7}") for i in range(4000)]
    after = [(i, "new" if i in (17, 1999) else v) for i, v in rows if not 3000 <= i < 3010] + [(9999, "x"), (40, "v5")]
    old, new = (spark.createDataFrame(r, "k long, v string") for r in (rows, after))
    leaf = ranges.by_number(F.col("k"), 10)
    trees = [ranges.tree(df, leaf, 3, shared.tables(spark, name)) for df, name in ((old, "a"), (new, "b"))]
    found = shared.tables(spark, "found")(ranges.changed(*trees, shared.tables(spark, "c")), "found")
    assert {(r["node"], r["change"]) for r in found.collect()} == {(1, "changed"), (199, "changed"), (300, "removed"), (999, "added"), (4, "changed")}
    ranges.write(new, leaf, f"{tmp_path}/new")
    got = ranges.read(spark, f"{tmp_path}/new", found)
    assert {r["k"] for r in got.collect()} == {k for k, _ in after if k // 10 in (1, 199, 999, 4)}
    assert "dynamicpruning" in got._jdf.queryExecution().toString().lower()
    none = trees[0].limit(0)
    assert ranges.changed(none, none, shared.tables(spark, "n")).count() == 0
    assert ranges.changed(none, trees[0], shared.tables(spark, "n")).filter("change = 'added'").count() == 400


def test_ranges_of_binary_keys_are_in_their_order(spark):
    keys = [b"", b"\x00", b"\x7f\xff", b"\x80", b"\x80\x01", b"\xff\xff\x01"]
    got = [r[0] for r in spark.createDataFrame([(bytearray(k),) for k in keys], "k binary").coalesce(1).select(ranges.by_prefix(F.col("k"))).collect()]
    assert got == sorted(got) == [0, 0, 0x7FFF, 0x8000, 0x8001, 0xFFFF]


def test_moments_and_prefixes_merge(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.gauss(5, 2) if rng.random() < 0.9 else None, rng.choice(["abc", "abd", "ab", None])) for _ in range(3000)] + [("none", None, None), ("one", 4.0, "whole")]
    df = spark.createDataFrame(rows, "g string, x double, t string").repartition(7)
    got = {r["g"]: r["m"] for r in user.aggregated(df, ["g"], "x", user.Moments(), "m").collect()}
    for g in {r[0] for r in rows}:
        x = [r[1] for r in rows if r[0] == g and r[1] is not None]
        assert got[g]["n"] == len(x)
        if x:
            mean = sum(x) / len(x)
            second, third = (sum((v - mean) ** p for v in x) / len(x) for p in (2, 3))
            assert math.isclose(got[g]["mean"], mean, rel_tol=1e-12) and math.isclose(got[g]["variance"], second, rel_tol=1e-9, abs_tol=1e-12)
            assert got[g]["skewness"] is None if second == 0 else math.isclose(got[g]["skewness"], third / second**1.5, rel_tol=1e-6, abs_tol=1e-9)
    assert got["none"]["mean"] is None
    shared_ = {r["g"]: r["p"] for r in user.aggregated(df, ["g"], "t", user.SharedPrefix(), "p").collect()}
    assert shared_["hot"] == "ab" and shared_["one"] == "whole" and shared_["none"] is None
    assert user.aggregated(df.limit(0), ["g"], "x", user.Moments(), "m").count() == 0


def test_grams_in_lateral_joins(spark):
    user.register(spark)
    spark.createDataFrame([(1, "a b c"), (2, "a"), (3, None)], "i int, t string").createOrReplaceTempView("gram_rows")
    got = spark.sql("SELECT i, g.* FROM gram_rows, LATERAL grams(t, 2) g ORDER BY i, place")
    assert got.columns == ["i", "place", "w1", "w2"] and [tuple(r) for r in got.collect()] == [(1, 0, "a", "b"), (1, 1, "b", "c")]
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT * FROM gram_rows, LATERAL grams(t, 0)").collect()
