"""Joins with filters made at run time give what plain joins give."""

import random

import pytest

from ferrule.operators import runtime
from ferrule.sources import shared


@pytest.mark.parametrize("most", [1 << 24, 64])
def test_filters_change_no_result(spark, most):
    rng = random.Random(4)
    rows = spark.createDataFrame([(rng.choice([None, *range(500)]), rng.choice("ab"), i) for i in range(3000)], "k long, g string, i long").repartition(3)
    keys = spark.createDataFrame([(rng.choice([None, *range(60)]), rng.choice("ab")) for _ in range(80)], "k long, g string")
    plain = sorted(map(tuple, rows.join(keys.distinct(), ["k", "g"], "left_semi").select(rows.columns).collect()))
    assert sorted(map(tuple, runtime.semi(rows, keys, ["k", "g"], most).collect())) == plain and plain
    lists = [keys.filter("k % 2 = 0"), keys.filter("k % 2 = 1"), keys.limit(0)]
    out = runtime.anti(rows, lists, ["k", "g"], shared.tables(spark, "anti"), most)
    assert sorted((r["i"] for r in out.collect())) == sorted(set(range(3000)) - {r[2] for r in plain})
    assert runtime.semi(rows, keys.limit(0), ["k", "g"], most).count() == 0 and runtime.semi(rows.limit(0), keys, ["k", "g"], most).count() == 0


def test_the_filter_passes_every_key_and_few_others(spark):
    table, size = runtime.bloom(spark.range(0, 4000, 4).toDF("k"), ["k"])
    passed = {r[0] for r in spark.range(8000).toDF("k").filter(runtime.may_match(["k"], table, size)).collect()}
    assert passed >= set(range(0, 4000, 4)) and len(passed) < 1000 + 7000 * 0.02
    assert runtime.bloom(spark.range(100).toDF("k"), ["k"], 1000) is None
