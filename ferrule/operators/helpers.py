"""Helpers that nobody searches for: constants, theorems and other entities that tools make for their own use.

Lists of prefixes are joined by the starts of names: names are cut to each length that a prefix has, so one equal-join
answers for any number of prefixes. What a user declares goes before all rules, and its last declaration counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.records import qualifier
from ferrule.functions.text import base_name

LARGEST = 1000  # fixed value: theorems whose term is larger are never searched for


def starting(names: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(name) of those that begin with one of the prefixes. Lengths go to the driver, at most as many as a name is long."""
    known = prefixes.select(F.col("prefix")).filter("prefix is not null and prefix <> ''").distinct()
    lengths = sorted(r[0] for r in known.select(F.length("prefix")).distinct().collect())
    if not lengths:
        return names.select("name").limit(0)
    starts = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("name")), lambda n: F.substring(F.col("name"), F.lit(1), n))
    return names.select("name").distinct().withColumn("prefix", F.explode(starts)).join(known, "prefix").select("name").distinct()


def declared(rows: DataFrame) -> DataFrame:
    """(what, name) from declarations (what, name, place, undo): the last one of each counts."""
    last = rows.groupBy("what", "name").agg(F.max_by("undo", "place").alias("undo"))
    return last.filter(~F.coalesce("undo", F.lit(False))).select("what", "name")


def instances(names: DataFrame, types: DataFrame) -> DataFrame:
    """(name) of constants of a class instance: `_T_inst.` for the base name of a type."""
    before = F.split(F.substring_index("name", "_inst.", 1), "_")
    ends = F.transform(F.sequence(F.lit(2), F.size(before)), lambda i: F.array_join(F.slice(before, i, F.size(before)), "_"))
    made = names.filter(F.col("name").contains("_inst.")).select("name").distinct().filter(F.size(before) > 1)
    return made.withColumn("type", F.explode(ends)).join(types.select(base_name(F.col("name")).alias("type")).distinct(), "type", "left_semi").select("name").distinct()


def variants(names: DataFrame) -> DataFrame:
    """(name) of which there is one for the class: `a.b.c` beside `a.b_class.c`."""
    of = F.concat(F.expr("substring(q, 1, length(q) - 6)"), F.lit("."), base_name(F.col("name")))
    return names.select("name", qualifier(F.col("name")).alias("q")).filter(F.col("q").endswith("_class")).select(of.alias("name")).distinct()


def _marked(rows: DataFrame, found: DataFrame, mark: str) -> DataFrame:
    return rows.join(found.select("name", F.lit(True).alias(mark)).distinct(), "name", "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def constants(rows: DataFrame, declarations: DataFrame, prefixes: DataFrame, types: DataFrame, quotients: DataFrame, generated: DataFrame, origins: DataFrame) -> DataFrame:
    """(name, helper) of constants (name, concealed, hidden, preserved, origin, is_prop).

    prefixes (prefix) are of tools, internal theories and steps of datatypes; types (name); quotients (name) what quotients make;
    generated (prefix) of types with constructors, whose constants count where their origin is among origins (origin).
    """
    rows = _marked(rows, declared(declarations).filter("what = 'constant'"), "said")
    for found, mark in ((starting(rows, prefixes), "inner"), (instances(rows, types), "instance"), (variants(rows), "variant"), (quotients, "quotient"), (starting(rows, generated), "made")):
        rows = _marked(rows, found, mark)
    rows = rows.join(origins.select("origin", F.lit(True).alias("there")).distinct(), "origin", "left")
    base, name = base_name(F.col("name")), F.col("name")
    of_class = name.contains(".class.") | base.endswith("_class") & F.coalesce("is_prop", F.lit(False))
    plain = F.coalesce("concealed", F.lit(False)) | F.coalesce("hidden", F.lit(False)) | F.col("inner") | F.col("instance") | F.col("variant") | F.col("quotient")
    rule = plain | base.startswith("Abs_") | base.startswith("Rep_") | F.col("made") & F.coalesce("there", F.lit(False)) | of_class
    return rows.select("name", (F.col("said") | ~F.coalesce("preserved", F.lit(False)) & rule).alias("helper"))


def theorems(rows: DataFrame, declarations: DataFrame, prefixes: DataFrame, types: DataFrame, inductive: DataFrame, helpers: DataFrame, classes: DataFrame) -> DataFrame:
    """(name, helper) of theorems (name, concealed, hidden, statement, size, constants, classes).

    A declared theorem takes all with an equal statement along. helpers (name) are constants, classes (name) internal ones: a
    theorem that mentions one is a helper. inductive (name) are predicates, whose definitions and congruences are, too.
    """
    said = rows.join(declared(declarations).filter("what = 'theorem'").select("name"), "name", "left_semi").select("statement").filter("statement is not null").distinct()
    equal = rows.join(said, "statement", "left_semi").select("name")
    name, base = F.col("name"), base_name(F.col("name"))
    of_type = starting(rows.filter(name.endswith("_def")), types.select(F.concat("name", F.lit(".")).alias("prefix")))
    whole = F.when(base.endswith("_def"), F.expr("substring(name, 1, length(name) - 4)")).when(base == "cong", qualifier(name))
    unclassed = F.regexp_replace(whole, r"_class(?=\.|$)", "")
    tries = rows.select("name", F.explode(F.array_distinct(F.array(whole, F.concat(whole, F.lit("p")), unclassed, F.concat(unclassed, F.lit("p"))))).alias("predicate")).filter("predicate is not null")
    of_predicate = tries.join(inductive.select(F.col("name").alias("predicate")), "predicate", "left_semi").select("name")
    mentions = lambda column, what: rows.select("name", F.explode(column).alias("what")).join(what.select(F.col("name").alias("what")), "what", "left_semi").select("name")
    found = [(equal, "said"), (starting(rows, prefixes), "inner"), (of_type, "of_type"), (of_predicate, "of_predicate"), (mentions("constants", helpers), "of_constant"), (mentions("classes", classes), "of_class")]
    out = rows
    for what, mark in found:
        out = _marked(out, what, mark)
    rule = F.coalesce("concealed", F.lit(False)) | F.coalesce("hidden", F.lit(False)) | name.startswith("??.") | (F.coalesce("size", F.lit(0)) > LARGEST)
    for _, mark in found:
        rule = rule | F.col(mark)
    return out.select("name", rule.alias("helper"))


def others(rows: DataFrame, declarations: DataFrame, prefixes: DataFrame, what: str) -> DataFrame:
    """(name, helper) of types, classes, locales, methods or lists of facts (name, concealed, hidden)."""
    rows = _marked(_marked(rows, declared(declarations).filter(F.col("what") == what), "said"), starting(rows, prefixes), "inner")
    hidden = F.coalesce("concealed", F.lit(False)) | F.coalesce("hidden", F.lit(False)) | F.col("name").startswith("??.")
    return rows.select("name", (F.col("said") | F.col("inner") | hidden).alias("helper"))


def live(name: Column, helper: Column) -> Column:
    """The name, or null for a helper."""
    return F.when(~helper, name)
