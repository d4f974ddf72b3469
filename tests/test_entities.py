"""Source scans against one pattern pass per file, helper rules on names made for them."""

import random
import re

from pyspark.sql import functions as F

from ferrule.operators import helpers
from ferrule.sources import theories


def by_hand(text, names):
    word, goal = {}, {}
    for m in re.finditer(r"\b\w+(?:\.\w+)*\b", text):
        word.setdefault(m.group(), m.start())
    for m in re.finditer(rf"(?:{'|'.join(theories.GOALS)})\s+(\w+(?:\.\w+)*)\b", text):
        goal.setdefault(m.group(1), m.start())
    base = {n: re.sub(r"\(\d+\)$", "", n.split(".")[-1]) for n in names}
    return {n: (word.get(b, -1), goal.get(b, -1)) for n, b in base.items()}


def test_offsets_against_patterns(spark, tmp_path):
    rng = random.Random(1)
    bits = ["foo", "foo.simps", "bar", "x'", "é", "lemma ", "theorem\n", "mylemma ", "lemma lemma ", "foo(2)", ".", ". ", " ", "\n", "corollary\t", "a_b", "simps", "12", "一二"]
    names = ["foo", "A.foo", "foo.simps(3)", "bar(12)", "a_b", "é", "lemma", "none", "12", "T.x'", "", "一二"]
    texts = {f"f{i}.thy": "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for i in range(60)}
    for n, text in texts.items():
        (tmp_path / n).write_bytes(text.encode())
    (tmp_path / "other.txt").write_text("lemma foo")
    sources = theories.files(spark, f"file://{tmp_path}").withColumn("path", F.substring_index("path", "/", -1))
    asked = spark.createDataFrame([(p, n) for p in [*texts, "gone.thy"] for n in names + names[:2]], "path string, name string")
    got = {(r["path"], r["name"]): (r["word"], r["goal"]) for r in theories.offsets(sources, asked).collect()}
    expected = {(p, n): x for p in [*texts, "gone.thy"] for n, x in by_hand(texts.get(p, ""), names).items()}
    assert got == expected and sum(g >= 0 for _, g in got.values()) > 20


def test_helper_theorems(spark):
    rows = [
        ("T.plain", False, False, "s1", 5, ["c"], []), ("T.hid", False, True, "s2", 5, [], []), ("??.x", False, False, "s3", 5, [], []), ("Tool.x", False, False, "s4", 5, [], []), ("T.list.y_def", False, False, "s5", 5, [], []),
        ("T.acc_def", False, False, "s6", 5, [], []), ("T.lists.cong", False, False, "s7", 5, [], []), ("C.ccpo_class.it_def", False, False, "s8", 5, [], []), ("T.uses", False, False, "s9", 5, ["c", "h"], []), ("T.of_class", False, False, "s10", 5, [], ["k"]),
        ("T.large", False, False, "s11", 1001, [], []), ("T.said", False, False, "same", 5, [], []), ("T.equal", None, None, "same", None, None, None), ("T.back", False, False, "s12", 5, [], []), ("T.other_def", False, False, None, 5, [], []),
    ]
    df = spark.createDataFrame(rows, "name string, concealed boolean, hidden boolean, statement string, size int, constants array<string>, classes array<string>")
    said = spark.createDataFrame([("theorem", "T.said", 1, False), ("theorem", "T.back", 1, False), ("theorem", "T.back", 2, True), ("constant", "T.plain", 3, False)], "what string, name string, place int, undo boolean")
    one = lambda column, *v: spark.createDataFrame([(x,) for x in v], f"{column} string")
    got = {r["name"] for r in helpers.theorems(df, said, one("prefix", "Tool."), one("name", "T.list"), one("name", "T.acc", "T.listsp", "C.ccpo.it"), one("name", "h"), one("name", "k")).filter("helper").collect()}
    assert got == {r[0] for r in rows} - {"T.plain", "T.back", "T.other_def"}
    kinds = helpers.others(df.select("name", "concealed", "hidden"), said.withColumn("what", F.lit("type")), one("prefix", "Tool.", "T.la"), "type").filter("helper").collect()
    assert {r["name"] for r in kinds} == {"T.hid", "??.x", "Tool.x", "T.large", "T.said", "T.plain"}
    assert [r[0] for r in helpers.others(df.filter("name = 'T.uses'"), said, one("prefix"), "type").select(helpers.live(F.col("name"), F.col("helper"))).collect()] == ["T.uses"]


def test_starts_of_names(spark):
    names = spark.createDataFrame([("abc",), ("ab",), ("a",), ("xbc",), (None,)], "name string")
    starts = spark.createDataFrame([("ab",), ("abc",), ("x",), (None,), ("",), ("abcd",)], "prefix string")
    assert sorted(r[0] for r in helpers.starting(names, starts).collect()) == ["ab", "abc", "xbc"]
    made = spark.createDataFrame([("eq_my_list_inst.x",), ("eq_list_inst.x",), ("eq_other_inst.x",), ("_inst.",), ("list_inst.x",)], "name string")
    assert sorted(r[0] for r in helpers.instances(made, spark.createDataFrame([("L.my_list",), ("L.list",)], "name string")).collect()) == ["eq_list_inst.x", "eq_my_list_inst.x"]
