"""Q1.15 fixed-point vectors as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 0.95  # fixed value: head room against overflow
ONE = 32768


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once: what stands in a lambda is computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def encode_q15(v: Column) -> Column:
    return once(norm(v) + F.lit(1e-12), lambda n: F.transform(v, lambda x: F.rint(F.lit(SCALE) * (x.cast("double") / n) * F.lit(float(ONE))).cast("int")))


def decode_q15(q: Column) -> Column:
    return F.transform(q, lambda x: x / F.lit(float(ONE)))


def dot_q15(a: Column, b: Column) -> Column:
    """Sum of rounded products, each halved to 15 bits."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.shiftright(x * y + 16384, 15).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def recover_cos(score: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score / F.lit(ONE * SCALE * SCALE)))


def normalize(v: Column) -> Column:
    return once(norm(v), lambda n: F.transform(v, lambda x: F.when(n != 0, x.cast("double") / n).otherwise(x.cast("double"))))


def decode_checked(q: Column, dimension: int) -> Column:
    """Dequantised; an error for vectors that were never migrated, or of another length."""
    n = F.size(q)
    wrong = F.when(n == 2 * dimension, F.raise_error(F.lit("a float32 vector that is not migrated")).cast("array<double>")).otherwise(F.raise_error(F.concat(F.lit("a vector of the wrong length: "), n.cast("string"))).cast("array<double>"))
    return F.when(q.isNull() | (n == dimension), decode_q15(q)).otherwise(wrong)
