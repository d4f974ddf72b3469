"""Changes to several tables of a store that happen as a whole, can be taken back, and survive a kill between any two writes.

A transaction has a folder, `<store>/transactions/<number>`. What the keys held before and what they shall hold are written
there first; the marker `prepared` makes it binding. Then each table's log gets its rows, under the transaction's own
number, so writing them again changes nothing; `committed` ends it. `recover` is to be called before a store is used: without
`prepared` nothing has happened and the folder goes, with it the rest is done. Taking back works alike, with
`undoing` and `undone` and a number of its own, and restores also that a key had no entry.

Deciding what a merge does, doing it and taking it back are `merge`, `run` and `undo`.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators import maintenance, relational
from ferrule.sources import shared, snapshot
from ferrule.store import KEYS, SCHEMAS, Store

MARKS = ("prepared", "committed", "undoing", "undone")


def _root(store: Store) -> str:
    return f"{store.path}/transactions"


def _names(table: str) -> list[str]:
    return [f.split(" ")[0] for f in SCHEMAS[table].split(", ")]


def _mark(store: Store, number: str, mark: str, text: str = "") -> None:
    snapshot.write_text(store.spark, f"{_root(store)}/{number}/{mark}", text or mark)


def _marked(store: Store, number: str, mark: str) -> bool:
    return snapshot.exists(store.spark, f"{_root(store)}/{number}/{mark}")


def numbers(store: Store) -> list[str]:
    """Transactions in order; one folder each."""
    fs, at = snapshot._fs(store.spark, _root(store))
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def _aligned(store: Store, table: str, rows: DataFrame) -> DataFrame:
    schema = store.spark.createDataFrame([], SCHEMAS[table]).schema
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(schema[c].dataType).alias(c) for c in _names(table)], "deleted")


def _same(left: DataFrame, right: DataFrame, keys: list[str]):
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[f"_{k}"])
    return out


def begin(store: Store, changes: Mapping[str, DataFrame]) -> str:
    """Writes what tables are to hold, rows with `deleted`, and what their keys hold now; nothing is bound yet."""
    number = f"{time.time_ns():020d}"
    at = f"{_root(store)}/{number}"
    for table, rows in changes.items():
        _aligned(store, table, rows).dropDuplicates(KEYS[table]).write.parquet(f"{at}/redo/{table}")
        redo = store.spark.read.parquet(f"{at}/redo/{table}")
        keys = redo.select(*[F.col(k).alias(f"_{k}") for k in KEYS[table]]).distinct()
        own = store.user(table)
        before = keys.join(own, _same(own, keys, KEYS[table]), "left")
        kept = [F.col(f"_{c}").alias(c) if c in KEYS[table] else F.col(c) for c in _names(table)]
        before.select(*kept, F.col("deleted")).write.parquet(f"{at}/undo/{table}")  # deleted is null where there was no entry
    return number


def _tables(store: Store, number: str, side: str) -> list[str]:
    return [t for t in SCHEMAS if snapshot.exists(store.spark, f"{_root(store)}/{number}/{side}/{t}")]


def _replayed(store: Store, number: str, side: str, seq: int) -> None:
    """Adds the rows to the logs; vectors go first and records are last, as in other writes."""
    order = ["vectors", "index", "registry", "records"]
    for table in sorted(_tables(store, number, side), key=order.index):
        rows = store.spark.read.parquet(f"{_root(store)}/{number}/{side}/{table}")
        rows.select(*_names(table), "deleted", F.lit(seq).alias("seq"), F.lit(0).cast("long").alias("place")).write.mode("append").parquet(f"{store.path}/user/{table}")


def finish(store: Store, number: str) -> None:
    """Does what is bound and not yet done; doing it twice is the same as once."""
    if _marked(store, number, "prepared") and not _marked(store, number, "committed"):
        _replayed(store, number, "redo", int(number))
        _mark(store, number, "committed")
    if _marked(store, number, "undoing") and not _marked(store, number, "undone"):
        seq = int(snapshot.read_text(store.spark, f"{_root(store)}/{number}/undoing"))
        _replayed(store, number, "undo", seq)
        _mark(store, number, "undone")


def run(store: Store, changes: Mapping[str, DataFrame]) -> str:
    """All changes or none; the transaction's number."""
    recover(store)
    number = begin(store, changes)
    _mark(store, number, "prepared")
    finish(store, number)
    return number


def undo(store: Store, number: str) -> None:
    """Restores what the keys held before; later writes to them are lost, so it is refused where a later transaction stands."""
    recover(store)
    if not _marked(store, number, "committed"):
        raise ValueError(f"no such transaction: {number}")
    if any(n > number and not _marked(store, n, "undone") for n in numbers(store)):
        raise ValueError("a later transaction stands")
    if not _marked(store, number, "undoing"):
        _mark(store, number, "undoing", str(time.time_ns()))
    finish(store, number)


def recover(store: Store) -> dict[str, str]:
    """Finishes or drops what was cut short; what became of each such transaction."""
    out = {}
    for number in numbers(store):
        if not _marked(store, number, "prepared"):
            shared.delete(store.spark, f"{_root(store)}/{number}")
            out[number] = "dropped"
        elif not _marked(store, number, "committed") or _marked(store, number, "undoing") and not _marked(store, number, "undone"):
            finish(store, number)
            out[number] = "finished"
    return out


def forget(store: Store, keep: int) -> int:
    """Drops the folders of all but the newest `keep` transactions, which can then not be taken back."""
    recover(store)
    old = numbers(store)[: -keep or None]
    for number in old:
        shared.delete(store.spark, f"{_root(store)}/{number}")
    return len(old)


def merge(store: Store, records: DataFrame, vectors: DataFrame, registry: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What a snapshot's tables change, and (table, action, n) of the plan; unfinished records and names of them stay out.

    A record that is new or differs takes the incoming one; its vectors follow the incoming side or go. Names that are new
    or newer are taken; two names for one theory are an error.
    """
    save = shared.tables(store.spark, "merge")
    incoming = records.filter(F.coalesce("persistent", F.lit(True)))
    names = [c for c in _names("records") if c != "uk"]
    marked = lambda df: df.select("uk", F.sha2(F.to_json(F.struct(*names)), 256).alias("value"))
    plan = save(relational.merge_plan(marked(incoming), marked(store.view("records")), "uk", "value"), "records")
    taken = plan.filter("action in ('added', 'updated')").select("uk")
    kept = incoming.join(taken, "uk", "left_semi").withColumn("deleted", F.lit(False))
    pair = lambda df: df.select(F.struct("uk", "model").alias("k"), F.to_json(F.struct("q")).alias("value"))
    of_changed = vectors.select("uk", "model").union(store.view("vectors").select("uk", "model")).distinct().join(taken, "uk", "left_semi").select(F.struct("uk", "model").alias("k"))
    both = save(maintenance.vector_plan(pair(store.view("vectors")), pair(vectors), of_changed, "k"), "vectors")
    moved = vectors.join(both.filter("action in ('add', 'update')").select("k.uk", "k.model"), ["uk", "model"], "left_semi").withColumn("deleted", F.lit(False))
    gone = both.filter("action = 'drop'").select("k.uk", "k.model", F.lit(None).cast("array<int>").alias("q"), F.lit(True).alias("deleted"))
    known = records.filter("theory is not null").groupBy("theory").agg(F.bool_or(F.coalesce("persistent", F.lit(True))).alias("ready"))
    ready = registry.join(known.filter("not ready").select("theory"), "theory", "left_anti")
    titles = save(maintenance.registry_plan(store.view("registry"), ready, "theory"), "registry")
    if titles.filter("action = 'conflict'").limit(1).count():
        raise ValueError("a theory has two names")
    said = titles.filter("action in ('add', 'refresh')").select("theory", "name", "ts", F.lit(False).alias("deleted"))
    counts = lambda df, table: df.groupBy("action").agg(F.count("*").alias("n")).select(F.lit(table).alias("table"), "action", "n")
    report = counts(plan, "records").union(counts(both, "vectors")).union(counts(titles, "registry"))
    return {"records": kept, "vectors": moved.unionByName(gone), "registry": said}, report
