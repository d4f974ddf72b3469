"""Order of work, the loop of answers and texts for models, against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.functions import prompts
from ferrule.operators import workload
from ferrule.sources import shared


@pytest.mark.parametrize("seed", range(2))
def test_cone_and_waves(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b) for a in range(18) for b in range(a) if rng.random() < 0.2]
    roots, excluded = set(rng.sample(range(18), 3)), set(rng.sample(range(18), 6))
    above = {n: {b for a, b in edges if a == n} for n in range(18)}
    reached, todo = set(roots), list(roots)
    while todo:
        for p in above[todo.pop()] - reached:
            reached.add(p)
            todo.append(p)

    def parents(n):
        return set().union(*({p} if p not in excluded else parents(p) for p in above[n]))

    pairs = {(n, p) for n in reached - excluded for p in parents(n)}
    table = lambda xs, shape: spark.createDataFrame(list(xs), shape)
    nodes, links = workload.cone(table(edges, "node long, parent long"), table([(x,) for x in roots], "node long"), table([(x,) for x in excluded], "node long"), shared.tables(spark, "cone"))
    assert {r[0] for r in nodes.collect()} == reached - excluded and {tuple(r) for r in links.select("node", "parent").collect()} == pairs
    wave = {r["node"]: r["wave"] for r in workload.waves(nodes, links, shared.tables(spark, "waves")).collect()}
    for n in sorted(reached - excluded):
        assert wave[n] == max((wave[p] + 1 for p in parents(n)), default=0)


def test_cycles_and_empty_graphs(spark):
    nodes, none = spark.createDataFrame([(1,), (2,)], "node long"), spark.createDataFrame([], "node long, parent long")
    loop = spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        workload.waves(nodes, loop, shared.tables(spark, "w1"))
    assert workload.waves(nodes.limit(0), none, shared.tables(spark, "w2")).count() == 0
    assert {r["wave"] for r in workload.waves(nodes, none, shared.tables(spark, "w3")).collect()} == {0}
    assert workload.workload([nodes, nodes.filter("node = 1")], "node") == 2


def test_policy():
    fail = lambda: pytest.fail("counted")
    assert workload.policy(fail, False) == "off" and workload.policy(lambda: 0, True) == "none" and workload.policy(lambda: 399, True) == "run"
    assert [workload.policy(lambda: 400, True, ask) for ask in (None, lambda n: None, lambda n: True, lambda n: False)] == ["warn", "warn", "run", "skip"]


class Agent:
    """Answers some of a batch; fails now and then."""

    def __init__(self, log, skip=0.0, fail=0.0, rng=None):
        self.log, self.skip, self.fail, self.rng = log, skip, fail, rng or random.Random(1)

    def __call__(self, part):
        self.log.append(len(part))
        if self.rng.random() < self.fail:
            raise OSError("gone")
        return {r["k"]: f"says {r['k']}" for r in part if self.rng.random() >= self.skip} | {"other": "x"}


def test_answers(spark):
    rows, log = [{"k": i} for i in range(50)], []
    rng = random.Random(3)
    assert workload.answered(rows, "k", lambda: Agent(log, 0.5, 0.1, rng)) == {i: f"says {i}" for i in range(50)} and max(log) == 20 and log[0] == 20
    assert workload.answered([], "k", lambda: Agent([])) == {}
    log.clear()
    with pytest.raises(workload.Unanswered, match="50 of 50"):
        workload.answered(rows, "k", lambda: Agent(log, 1.0))
    assert len(log) == 3 + workload.STALLED
    log.clear()
    with pytest.raises(OSError):
        workload.answered(rows, "k", lambda: Agent(log, 0, 1.0))
    assert len(log) == workload.RENEWED + 1
    df = spark.createDataFrame([(i, f"t{i}") for i in range(90)] + [(3, "again")], "k long, text string")
    done = spark.range(10).toDF("k")
    got = workload.interpret(df, "k", lambda: lambda part: {r["k"]: r["text"][:1] for r in part if r["k"] != 5}, shared.tables(spark, "answers"), done, 7)
    assert {r["k"] for r in got.collect()} == set(range(10, 90)) and got.filter("interpretation = 't'").count() == 80


def test_prompts(spark):
    context = "fact a b\n\n\ntheory T\n\n\nnotation n\n\n\nother\n\n\nclass c\n\n\nmuch too long for the limit\n\n\nx"
    rows = spark.createDataFrame([(["p one", "p two"], "c", ["x"], None), ([], "a b c d e f", [], None), ([], "c", [], context), (["p"], "c", None, None), (None, None, ["x"], "y"), (None, "c", [], "")], "p array<string>, c string, v array<string>, x string")
    goal = lambda limit: [r[0] for r in rows.select(prompts.goals(F.col("p"), F.col("c"), F.col("v"), F.col("x"), limit)).collect()]
    fact = lambda limit: [r[0] for r in rows.select(prompts.facts(F.col("c"), F.col("v"), F.col("x"), limit)).collect()]
    whole = "#Goal\n###Variables\n###Premises\n###Conclusion\nc"
    assert goal(100)[0] == "#Goal\n###Variables\nx\n\n###Premises\np one\n\np two\n\n###Conclusion\nc"
    assert goal(6)[0] == "#Goal\n###Variables\n\n###Premises\n\np two\n\n###Conclusion\nc"
    assert goal(4)[1] == "#Goal\n###Variables\n###Premises\n###Conclusion" and goal(2)[1] == "#Goal\n###Variables ###Premises"
    assert goal(13)[2] == "#Goal\ntheory T\n\nnotation n\n\nother\n\nfact a b\n\n###Variables\n###Premises\n###Conclusion\nc"
    assert goal(50)[3:] == ["#Goal\n###Variables\n###Premises\np\n\n###Conclusion\nc", None, whole]
    assert "theory" not in fact(13)[2] and fact(3)[2] == "#Fact\n###Variables\n###Statement\nc" and fact(3)[1] == "#Fact\n###Variables ###Statement a"
    assert spark.range(1).select(prompts.plain(F.lit("a::type b__ ‹c›"))).first()[0] == 'a b "c"'
