"""Greatest values over paths against plain walks: chains, cycles, branching graphs."""

import random

import pytest

from ferrule.operators import paths, workload
from ferrule.sources import shared
from ferrule.streaming import incremental


def closure_max(version, edges):
    """Greatest version over what each node reaches: components first (by two walks), then in their order."""
    out, order, seen = {v: [] for v in version}, [], set()
    back = {v: [] for v in version}
    for a, b in edges:
        if b in version:
            out[a].append(b)
            back[b].append(a)
    for root in version:
        stack = [(root, iter(out[root]))] if root not in seen else []
        seen.add(root)
        while stack:
            v, it = stack[-1]
            w = next((x for x in it if x not in seen), None)
            if w is None:
                order.append(stack.pop()[0])
            else:
                seen.add(w)
                stack.append((w, iter(out[w])))
    part = {}
    for root in reversed(order):
        todo = [root] if root not in part else []
        while todo:
            v = todo.pop()
            if v not in part:
                part[v] = root
                todo += back[v]
    best = {}
    for v in order:  # components are finished before those that reach them
        best[part[v]] = max(best.get(part[v], 0), version[v] or 0, *[best[part[w]] for w in out[v] if part[w] != part[v]], 0)
    return {v: best[part[v]] for v in version}


def graph(kind, n, rng):
    if kind == "chain":
        return [(i, i + 1) for i in range(n - 1)]
    if kind == "cycles":
        return [(i, i // 50 * 50 + (i + 1) % 50) for i in range(n)] + [(i, i + 51) for i in range(0, n - 60, 100)]
    if kind == "mixed":
        return [(i, i + 1) for i in range(n - 1) if i % 37] + [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 9)] + [(i, i) for i in range(0, n, 11)] + [(3, n + 5)]
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)]


@pytest.mark.parametrize("kind,n", [("chain", 100_000), ("cycles", 5000), ("mixed", 20_000), ("random", 3000)])
def test_versions_over_dependencies(spark, kind, n):
    rng = random.Random(7)
    edges = graph(kind, n, rng)
    version = {i: None if i % 13 == 0 else rng.randrange(1_000_000) for i in range(n)}
    nodes = spark.createDataFrame(list(version.items()), "node long, version long")
    jobs = []
    save = shared.tables(spark, f"paths-{kind}")
    got = incremental.effective_versions(nodes, spark.createDataFrame(edges, "src long, dst long"), lambda df, name: (jobs.append(name), save(df, name))[1])
    assert {r["node"]: r["eff"] for r in got.collect()} == closure_max(version, edges)
    assert len(jobs) < 40


def test_waves_of_a_long_order(spark):
    rng, n = random.Random(8), 4000
    edges = [(i, i - 1) for i in range(1, n) if i % 50] + [(i, rng.randrange(max(0, i - 400), i)) for i in range(1, n) if i % 50 == 0 or i % 41 == 0]
    level = {}
    for i in range(n):
        level[i] = max((level[b] + 1 for a, b in edges_of(edges).get(i, [])), default=0)
    nodes, up = spark.createDataFrame([(i,) for i in range(n)], "node long"), spark.createDataFrame(edges, "node long, parent long")
    got = workload.waves(nodes, up, shared.tables(spark, "order"))
    assert {r["node"]: r["wave"] for r in got.collect()} == level
    for bad in ([(0, n - 1)], [(5, 5)]):
        with pytest.raises(ValueError):
            workload.waves(nodes, up.union(spark.createDataFrame(bad, "node long, parent long")), shared.tables(spark, "bad"))


def edges_of(edges, kept={}):  # noqa: B006
    if id(edges) not in kept:
        kept[id(edges)] = {}
        for a, b in edges:
            kept[id(edges)].setdefault(a, []).append((a, b))
    return kept[id(edges)]


def test_no_nodes_and_no_edges(spark):
    save = shared.tables(spark, "none")
    none = spark.createDataFrame([], "src long, dst long, w long")
    assert paths.greatest(spark.createDataFrame([], "node long, base long"), none, save).count() == 0
    assert [tuple(r) for r in paths.greatest(spark.createDataFrame([(1, 5)], "node long, base long"), none, save).collect()] == [(1, 5)]
