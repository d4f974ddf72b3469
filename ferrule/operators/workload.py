"""What has to be interpreted, whether to start it, in which order, and the loop that asks until all is answered."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators import paths

ASK_FROM = 400  # fixed value: fewer records are done without asking
BATCH = 20
STALLED = 10
RENEWED = 8
TOGETHER = 16  # turns whose tables are read together before they are written as one

Answer = Callable[[Sequence[Mapping]], Mapping]  # records to {key: interpretation} of those it answered


def workload(todo: Sequence[DataFrame], key: str) -> int:
    """Records to be done over all channels, each once."""
    every = todo[0].select(key)
    for x in todo[1:]:
        every = every.union(x.select(key))
    return every.distinct().count()


def policy(n: Callable[[], int], enabled: bool, ask: Callable[[int], bool | None] | None = None, threshold: int = ASK_FROM) -> str:
    """`run`, `skip`, `none` (nothing to do), `off`, or `warn` where nobody could be asked; n is counted only where it matters."""
    if not enabled:
        return "off"
    count = n()
    if not count:
        return "none"
    if count < threshold:
        return "run"
    said = ask(count) if ask else None
    return "warn" if said is None else "run" if said else "skip"


def cone(edges: DataFrame, roots: DataFrame, excluded: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(node) and (node, parent): the roots and all their ancestors without the excluded ones, whose children get their parents instead.

    Walks by level; paths through excluded nodes are cut short in turns that each double their length.
    """
    near, turn = save(roots.select("node").distinct(), "near-0"), 0
    seen = near
    while near.limit(1).count():
        turn += 1
        near = save(near.join(edges, "node").select(F.col("parent").alias("node")).distinct().join(seen, "node", "left_anti"), f"near-{turn}")
        seen = seen.union(near)
        if turn % TOGETHER == 0:
            seen = save(seen, f"seen-{turn}")
    seen = save(seen, "seen")
    out = excluded.select("node").distinct()
    inner = edges.join(seen, "node", "left_semi").select("node", "parent").distinct()
    through = out.select(F.col("node").alias("parent"))
    # (node, parent, open): open parents are excluded nodes that are still to be walked through
    hops = save(inner.join(through.withColumn("open", F.lit(True)), "parent", "left").select("node", "parent", F.coalesce("open", F.lit(False)).alias("open")), "hops-0")
    turn = 0
    while hops.filter("open").limit(1).count():
        turn += 1
        if turn > 64:  # paths of 2^64 nodes
            raise ValueError("the graph has a cycle")
        step = hops.select(F.col("node").alias("parent"), F.col("parent").alias("above"), F.col("open").alias("still"))
        further = hops.filter("open").join(step, "parent").select("node", F.col("above").alias("parent"), F.col("still").alias("open"))
        hops = save(hops.filter("not open").union(further).distinct(), f"hops-{turn}")
    return seen.join(out, "node", "left_anti"), hops.join(out, "node", "left_anti").select("node", "parent")


def waves(nodes: DataFrame, edges: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, wave): a node's wave comes after those of all its parents; a cycle is an error. Nodes of a wave don't wait for each other."""
    rows = nodes.select("node").distinct().withColumn("base", F.lit(0).cast("long"))
    known = rows.select(F.col("node").alias("parent"))
    up = edges.join(known, "parent", "left_semi").select(F.col("node").alias("src"), F.col("parent").alias("dst"), F.lit(1).cast("long").alias("w"))
    up = up.join(rows.select(F.col("node").alias("src")), "src", "left_semi")
    return paths.greatest(rows, up, save).select("node", F.col("value").cast("int").alias("wave"))


class Unanswered(RuntimeError):
    pass


def answered(rows: Sequence[Mapping], key: str, make: Callable[[], Answer], wait: float = 0.0) -> dict:
    """An interpretation for each record. Missing ones are asked for again; `STALLED` rounds without a new one are an error.

    An agent that fails is replaced, `RENEWED` times at most; what was answered before stays. Null and unknown answers don't count.
    """
    found: dict = {}
    keys = {r[key] for r in rows}

    def ask(agent: Answer, part: Sequence[Mapping]) -> None:
        found.update({k: v for k, v in agent(part).items() if k in keys and k not in found and v is not None})

    agent, renewed, stalled, first = make(), 0, 0, [rows[i : i + BATCH] for i in range(0, len(rows), BATCH)]
    while len(found) < len(keys):
        before = len(found)
        part = first[0] if first else [r for r in rows if r[key] not in found][:BATCH]
        try:
            ask(agent, part)
        except (OSError, TimeoutError):
            renewed += 1
            if renewed > RENEWED:
                raise
            time.sleep(wait)
            agent = make()
            continue
        if first:
            first.pop(0)
            continue
        stalled = 0 if len(found) > before else stalled + 1
        if stalled >= STALLED:
            raise Unanswered(f"{len(keys) - len(found)} of {len(keys)} records have no interpretation")
    return found


def interpret(rows: DataFrame, key: str, make: Callable[[], Answer], save: Callable[[DataFrame, str], DataFrame], done: DataFrame | None = None, size: int = 2048, wait: float = 0.0) -> DataFrame:
    """(key, interpretation) of all rows that `done` doesn't have, each key once. A task asks for `size` rows at a time, so none holds a partition.

    The answers are saved before they are given back, so that reading them twice doesn't ask twice. A task that is
    lost asks again for its own rows only.
    """
    todo = rows.dropDuplicates([key])
    todo = todo if done is None else todo.join(done.select(key), key, "left_anti")
    at = todo.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                found = answered(part.to_pylist(), key, make, wait)
                ids = part.column(part.schema.get_field_index(key))
                yield pa.RecordBatch.from_arrays([ids, pa.array([found[k] for k in ids.to_pylist()], pa.string())], [key, "interpretation"])

    return save(todo.mapInArrow(run, f"`{key}` {at}, interpretation string"), "answers")
