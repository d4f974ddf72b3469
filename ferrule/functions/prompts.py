"""Texts for models with a limit of tokens: goals and facts with their context, as column expressions.

Tokens are counted by `count(text)` and cut by `cut(text, n)`, functions from columns to columns; the ones given here
take words. A text is held as an array of pieces with their counts; running sums over the counts say which pieces
stay, so one filter does the work and nothing is read row by row. Null statements give null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Count = Callable[[Column], Column]
Cut = Callable[[Column, int], Column]
# Headings, the mark between parts of a context, and the order of its parts; other parts are 2.
VARIABLES, PREMISES, CONCLUSION, STATEMENT, GOAL, FACT = "###Variables\n", "###Premises\n", "###Conclusion\n", "###Statement\n", "#Goal\n", "#Fact\n"
BETWEEN, END = "\n\n\n", "\n\n"
PLACES = {"theory ": -1, "notation ": 0, "class ": 1, "fact ": 3}
OTHER = 2


def _split(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def words(text: Column) -> Column:
    return F.size(_split(text))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(_split(text), 1, n), " ")


def measured(pieces: Column, weight: Callable[[Column], Column]) -> Column:
    """Each piece with its weight and the sum of the weights before it."""
    rows = F.transform(pieces, lambda p: F.struct(p.alias("text"), weight(p).cast("long").alias("n")))
    sums = F.transform(rows, lambda _, i: F.aggregate(F.slice(rows, 1, i), F.lit(0).cast("long"), lambda a, r: a + r["n"]))
    return F.zip_with(rows, sums, lambda r, s: F.struct(r["text"].alias("text"), r["n"].alias("n"), s.alias("before")))


def joined(pieces: Column, between: str) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), between)


def shortened(text: Column, limit: int, by_line: bool, count: Count, cut: Cut) -> Column:
    """Within the limit: by lines from the front, where headings and empty lines stay, or by the first tokens.

    A line goes if those before it don't free enough; where all lines together don't, the first tokens are kept.
    """
    over = count(text) - limit
    if not by_line:
        return F.when(over <= 0, text).otherwise(cut(text, limit))
    fixed = lambda line: (line == "") | line.startswith("###")
    lines = measured(F.split(text, "\n"), lambda x: F.when(fixed(x), 0).otherwise(count(x)))
    stays = joined(F.filter(lines, lambda x: fixed(x["text"]) | (x["before"] >= over)), "\n")
    all_lines = F.aggregate(lines, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return F.when(over <= 0, text).when(all_lines >= over, stays).otherwise(cut(text, limit))


def preceded(text: Column, context: Column, limit: int, by_line: bool, count: Count, cut: Cut) -> Column:
    """As many parts of the context as fit, taken in their order and shown by kind; without theories where `by_line` is off."""
    used = count(text)
    parts = F.filter(F.split(context, BETWEEN), lambda p: (p != "") if by_line else (p != "") & ~p.startswith("theory "))
    ended = measured(F.transform(parts, lambda p: F.concat(p, F.lit(END))), count)
    taken = F.filter(ended, lambda p: p["before"] + p["n"] + used <= limit)
    rank = lambda p: F.coalesce(*[F.when(p["text"].startswith(start), n) for start, n in PLACES.items()], F.lit(OTHER))
    of_rank = lambda n: joined(F.filter(taken, lambda p: rank(p) == n), "")
    shown = F.concat(*map(of_rank, sorted({*PLACES.values(), OTHER})))
    return F.when(used >= limit, shortened(text, limit, by_line, count, cut)).when(context.isNull(), shortened(text, limit, by_line, count, cut)).otherwise(F.concat(shown, text))


def listed(items: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(x, F.lit(END))), "")


def goals(premises: Column, conclusion: Column, variables: Column, context: Column, limit: int, count: Count = words, cut: Cut = first_words) -> Column:
    """Null premises and variables are none."""
    text = F.concat(F.lit(VARIABLES), listed(variables), F.lit(PREMISES), listed(premises), F.lit(CONCLUSION), conclusion)
    return F.concat(F.lit(GOAL), preceded(text, context, limit, True, count, cut))


def facts(statement: Column, variables: Column, context: Column, limit: int, count: Count = words, cut: Cut = first_words) -> Column:
    text = F.concat(F.lit(VARIABLES), listed(variables), F.lit(STATEMENT), statement)
    return F.concat(F.lit(FACT), preceded(text, context, limit, False, count, cut))


def plain(text: Column) -> Column:
    """Without the marks of a printed term that say nothing to a model."""
    text = F.regexp_replace(F.regexp_replace(text, r"::type\b", ""), r"__\b", "")
    return F.translate(text, "‹›", '""')
