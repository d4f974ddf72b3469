"""Streams of work that are done once, and places in large groups."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.operators import ordering
from ferrule.sources import shared
from ferrule.streaming import marks

TEXT = "k long, text string"


def agents():
    def make():
        def say(part):
            if any(r["text"] == "bad" for r in part):
                raise OSError("refused")
            return {r["k"]: f"says {r['text']}" for r in part if r["text"] != "mute"} | {-1: "nobody"}

        return say

    return make


def test_a_bad_record_spoils_nothing_else(spark):
    rows = [(i, "bad" if i % 10 == 3 else "mute" if i % 10 == 4 else f"t{i}") for i in range(100)]
    got = {r["k"]: (r["answer"], r["failure"]) for r in marks.answers(spark.createDataFrame(rows, TEXT).repartition(3), "k", agents()).collect()}
    assert len(got) == 100 and all((got[i][0] == f"says t{i}") == (i % 10 not in (3, 4)) for i in range(100))
    assert got[3][1] == "OSError: refused" and got[4][1] == "no answer" and got[5][1] is None


def test_replayed_batches_add_nothing(spark, tmp_path):
    at, source = str(tmp_path / "work"), str(tmp_path / "in")
    versions = iter(range(7, 100))
    feed = lambda rows: spark.createDataFrame(rows, TEXT).coalesce(1).write.mode("append").parquet(source)
    go = lambda checkpoint: marks.interpret(spark.readStream.schema(TEXT).option("maxFilesPerTrigger", 1).parquet(source), at, str(tmp_path / checkpoint), "k", agents(), lambda: next(versions)).awaitTermination()
    feed([(1, "a"), (2, "bad"), (1, "a")])
    feed([(3, "c"), (4, "mute")])
    assert marks.marks(spark, at).count() == 0
    go("one")
    first = sorted(map(tuple, marks.read(spark, at, "k").select("k", "answer").collect()))
    assert first == [(1, "says a"), (2, None), (3, "says c"), (4, None)]
    m = marks.marks(spark, at).agg(F.sum("asked"), F.sum("answered"), F.sum("failed"), F.min("interpreted_at")).first()
    assert tuple(m) == (4, 2, 2, 7) and {r["k"] for r in marks.read(spark, at, "k", "failed").collect()} == {2, 4}
    go("one")  # nothing new
    go("two")  # all batches once more, as after a lost checkpoint
    assert sorted(map(tuple, marks.read(spark, at, "k").select("k", "answer").collect())) == first and marks.marks(spark, at).agg(F.sum("asked")).first()[0] == 4
    marks.answers(spark.createDataFrame([(9, "x")], TEXT), "k", agents()).write.parquet(f"{at}/answers/batch=50")  # cut short before its mark
    assert {r["k"] for r in marks.read(spark, at, "k").collect()} == {1, 2, 3, 4}


def test_marks_of_theories(spark):
    records = spark.createDataFrame([("A", "a", "t", 3), ("A", "b", None, 9), ("B", "c", "t", 1), ("B", "d", "t", 2), ("C", "e", "t", 8)], "theory string, uk string, text string, version long")
    now = marks.embedded(records, spark.createDataFrame([("a",), ("c",), ("e",), ("e",)], "uk string"))
    assert {r["theory"]: (r["embeddable"], r["missing"], r["done"]) for r in now.collect()} == {"A": (1, 0, True), "B": (2, 1, False), "C": (1, 0, True)}
    held = spark.createDataFrame([("A", 3), ("B", 9), ("C", 7)], "theory string, version long")
    assert [r[0] for r in marks.still_embedded(now, held).collect()] == ["A"]


@pytest.mark.parametrize("parts", ["1", "13"])
def test_places_in_a_group_of_most_rows(spark, parts):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None, ""]), rng.randrange(10_000), i) for i in range(4000)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = ordering.placed(spark.createDataFrame(rows, "g string, x long, i long"), ["g"], [F.desc("x"), F.col("i")], shared.tables(spark, "places")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for g in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert {r["i"]: r["_place"] for r in got if r["g"] == g} == {r[2]: n for n, r in enumerate(order, 1)}
        assert {r["_size"] for r in got if r["g"] == g} == {len(order)}
