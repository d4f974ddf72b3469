"""Names, token sequences and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\x01"


def contains_seq(hay: Column, needle: Column) -> Column:
    """Whether the needle's tokens stand next to each other, in order; an empty needle is nowhere."""
    joined = lambda c: F.concat(F.lit(SEP), F.array_join(c, SEP), F.lit(SEP))
    return (F.size(needle) > 0) & joined(hay).contains(joined(needle))


def may_contain(text: Column, needle: Column) -> Column:
    """A cheap test that every match passes: each token is a substring."""
    return F.forall(needle, lambda t: text.contains(t))


def base_name(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def truncated(expr: Column, limit: int = 500) -> Column:
    return F.when(F.length(expr) > limit, F.concat(F.substring(expr, 1, limit), F.lit("…"))).otherwise(expr)


def member_base(name: Column) -> Column:
    """The collection of `base(N)`, else null."""
    return F.when(name.rlike(r"^(.*)\((\d+)\)$"), F.regexp_extract(name, r"^(.*)\((\d+)\)$", 1))


def version_key(version: Column) -> Column:
    return F.transform(F.split(version, r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def hit_rate(found: Column, wanted: Column) -> Column:
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.array_intersect(found, wanted)) / F.size(wanted))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def find_sequences(rows: DataFrame, key: str, needles: DataFrame, size: int) -> DataFrame:
    """(key, h) against needles (w) of `size` tokens each: the keys whose tokens hold a needle, by an equal-join on runs."""
    runs = F.transform(F.sequence(F.lit(1), F.size("h") - size + 1), lambda i: F.array_join(F.slice("h", i, size), SEP))
    found = rows.filter(F.size("h") >= size).select(key, F.explode(F.array_distinct(runs)).alias("_run"))
    return found.join(needles.withColumn("_run", F.array_join("w", SEP)), "_run").drop("_run")


def boundaries(tokens: Column) -> Column:
    """Where tokens end, in characters of all of them in a row."""
    step = lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.array_append(acc["out"], acc["at"] + F.length(x)).alias("out"))
    ends = F.aggregate(tokens, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])
    return F.array_distinct(F.filter(ends, lambda x: x > 0))


def token_change(old: Column, new: Column) -> Column:
    """same, refinement, merge or mixed by where tokens end; content where the characters differ."""
    a, b = boundaries(old), boundaries(new)
    return F.when(F.array_join(old, "") != F.array_join(new, ""), "content").when(same_set(a, b), "same").when(subset(a, b), "refinement").when(subset(b, a), "merge").otherwise("mixed")
