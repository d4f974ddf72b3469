"""Programs over stores on odd names and many equal digests."""

import random

from ferrule.operators import upkeep


def test_instances_take_the_longest_suffix(spark):
    rng = random.Random(5)
    name = lambda: rng.choice([".".join(rng.choice(["a", "b", "", "a+"]) for _ in range(rng.randint(1, 4))), None])
    rows = [(i, rng.choice(["x", "y", None]), name()) for i in range(150)]
    templates = [(i, rng.choice(["x", "y", None]), name()) for i in range(150)]
    a, b = spark.createDataFrame(rows, "k int, digest string, name string"), spark.createDataFrame(templates, "t int, digest string, suffix string")
    fits = lambda n, s: n is not None and s is not None and (n == s or n.endswith("." + s))
    expected = set()
    for k, d, n in rows:
        found = [(-len(s), t, s) for t, e, s in templates if d is not None and d == e and fits(n, s)]
        if found:
            expected.add((k, *min(found)[1:]))
    assert {tuple(r) for r in upkeep.instances(a, b, "digest", "name", "suffix", "k", "t").collect()} == expected


def test_instances_of_one_digest_make_no_pairs(spark):
    """All names have one digest: 1.6 thousand million pairs, of which none may be made."""
    a = spark.range(40_000).selectExpr("id AS k", "concat('x', id % 1) AS digest", "concat('a.', id % 7, '.b') AS name")
    b = spark.range(40_000).selectExpr("id AS t", "concat('x', id % 1) AS digest", "concat(id % 9, '.b') AS suffix")
    plan = upkeep.instances(a, b, "digest", "name", "suffix", "k", "t")
    joins = [line for line in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 1 and joins[0].count(" = ") == 2  # by digest and suffix, with no condition on pairs beside
    assert plan.count() == 40_000
