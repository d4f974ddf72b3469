"""A store whose program is killed at every write in turn."""

import pytest
from pyspark.sql import functions as F

from ferrule import transaction
from ferrule.sources import snapshot
from ferrule.store import Store


class Killed(Exception):
    pass


def state(store):
    return {t: sorted(map(repr, store.user(t).collect())) for t in ("records", "vectors", "registry")}, sorted(map(repr, store.view("records").collect()))


def made(spark, path):
    store = Store(spark, f"file://{path}")
    spark.createDataFrame([("a", "T1", 1, "sys", True), ("b", "T1", 1, "sys", True)], "uk string, theory string, kind int, name string, persistent boolean").selectExpr("uk", "theory", "kind", "name", "cast(null as string) expr", "cast(null as string) interpretation", "cast(null as array<string>) constituents", "cast(null as array<string>) goal_patterns", "persistent").write.parquet(f"file://{path}/system/records")
    store.append("records", spark.createDataFrame([("b", "T1", 1, "own"), ("c", "T2", 1, "own")], "uk string, theory string, kind int, name string"))
    store.append("vectors", spark.createDataFrame([("b", "m", [1]), ("c", "m", [2])], "uk string, model string, q array<int>"))
    return store


def changes(spark):
    records = spark.createDataFrame([("a", "T1", 1, "new", False), ("b", "T1", 1, "new", False), ("c", None, None, None, True), ("d", "T3", 2, "new", False)], "uk string, theory string, kind int, name string, deleted boolean")
    vectors = spark.createDataFrame([("b", "m", None, True), ("d", "m", [7], False)], "uk string, model string, q array<int>, deleted boolean")
    return {"records": records, "vectors": vectors}


def dying(monkeypatch, after):
    """Every write from the one numbered `after` on fails."""
    from pyspark.sql.readwriter import DataFrameWriter

    count, table, text = [0], DataFrameWriter.parquet, snapshot.write_text

    def step(write):
        def run(*a, **k):
            count[0] += 1
            if count[0] > after:
                raise Killed
            return write(*a, **k)

        return run

    monkeypatch.setattr(DataFrameWriter, "parquet", step(table))
    monkeypatch.setattr(snapshot, "write_text", step(text))


def test_all_or_nothing_wherever_it_is_killed(spark, tmp_path, monkeypatch):
    store = made(spark, tmp_path / "whole")
    before = state(store)
    number = transaction.run(store, changes(spark))
    after = state(store)
    assert [r["name"] for r in store.view("records").orderBy("uk").collect()] == ["new", "new", "new"] and transaction.recover(store) == {}
    transaction.undo(store, number)
    assert state(store) == before
    seen = set()
    for n in range(12):
        store = made(spark, tmp_path / f"killed-{n}")
        with monkeypatch.context() as m:
            dying(m, n)
            try:
                transaction.run(store, changes(spark))
                finished = True
            except Killed:
                finished = False
        transaction.recover(store)
        got = state(store)
        assert got in (before, after) and transaction.recover(store) == {} and state(store) == got
        seen.add((finished, got == after))
        if finished:
            break
    assert seen == {(False, False), (False, True), (True, True)}


def test_taking_back_survives_a_kill(spark, tmp_path, monkeypatch):
    store = made(spark, tmp_path / "undo")
    before = state(store)
    number = transaction.run(store, changes(spark))
    with monkeypatch.context() as m:
        dying(m, 2)
        with pytest.raises(Killed):
            transaction.undo(store, number)
    assert list(transaction.recover(store).values()) == ["finished"] and state(store) == before
    later = transaction.run(store, changes(spark))
    transaction.run(store, {"registry": spark.createDataFrame([("T1", "one", 5, False)], "theory string, name string, ts long, deleted boolean")})
    with pytest.raises(ValueError):
        transaction.undo(store, later)
    assert transaction.forget(store, 1) == 2 and len(transaction.numbers(store)) == 1


def test_merge_of_a_snapshot_and_back(spark, tmp_path):
    store = made(spark, tmp_path / "merge")
    before = state(store)
    cols = "uk string, theory string, kind int, name string, expr string, interpretation string, constituents array<string>, goal_patterns array<string>, persistent boolean"
    rows = [("a", "T1", 1, "sys", None, None, None, None, True), ("b", "T1", 1, "theirs", None, None, None, None, True), ("e", "T9", 1, "e", None, None, None, None, True), ("w", "W", 1, "w", None, None, None, None, False)]
    vectors = spark.createDataFrame([("e", "m", [3]), ("c", "m", [9])], "uk string, model string, q array<int>")
    names = spark.createDataFrame([("T9", "nine", 4), ("W", "wip", 4)], "theory string, name string, ts long")
    plan, report = transaction.merge(store, spark.createDataFrame(rows, cols), vectors, names)
    counts = {(r["table"], r["action"]): r["n"] for r in report.collect()}
    assert counts == {("records", "identical"): 1, ("records", "updated"): 1, ("records", "added"): 1, ("records", "local-only"): 1, ("vectors", "drop"): 1, ("vectors", "add"): 1, ("vectors", "keep_local"): 1, ("registry", "add"): 1}
    number = transaction.run(store, plan)
    assert {r["uk"]: r["name"] for r in store.view("records").collect()} == {"a": "sys", "b": "theirs", "c": "own", "e": "e"}
    assert {(r["uk"], r["q"][0]) for r in store.view("vectors").collect()} == {("c", 2), ("e", 3)} and [r["name"] for r in store.view("registry").collect()] == ["nine"]
    transaction.undo(store, number)
    assert state(store) == before
    assert store.view("registry").filter(F.col("theory") == "T9").count() == 0
