"""Aggregates and table functions that users define.

An aggregate has states that merge: each task adds whole Arrow columns to the states of its groups and sends one state for
each, so a hot group costs a state a task; states are then merged by group. A table function derives its columns
from its constant arguments and is called in lateral joins.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf, udtf
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

GROUPS = 10_000


class Aggregate(Protocol):
    """States are plain values; `finish` gives the result of a group."""

    def add(self, state: Any, values: pa.Array) -> Any: ...

    def merge(self, left: Any, right: Any) -> Any: ...

    def finish(self, state: Any) -> Any: ...


class Moments:
    """(n, mean, variance, skewness) of the values that aren't null; a state is n, mean and sums of powers of deviations."""

    result = "n long, mean double, variance double, skewness double"

    def add(self, state: tuple | None, values: pa.Array) -> tuple | None:
        x = values.drop_null().to_numpy(zero_copy_only=False).astype(float)
        if not len(x):
            return state
        d = x - x.mean()
        return self.merge(state, (len(x), float(x.mean()), float((d**2).sum()), float((d**3).sum())))

    def merge(self, left: tuple | None, right: tuple | None) -> tuple | None:
        if left is None or right is None:
            return left or right
        (n, a, s, c), (m, b, t, e) = left, right
        total, d = n + m, b - a
        second = s + t + d * d * n * m / total
        third = c + e + d**3 * n * m * (n - m) / total**2 + 3 * d * (n * t - m * s) / total
        return total, a + d * m / total, second, third

    def finish(self, state: tuple | None) -> tuple:
        if state is None:
            return 0, None, None, None
        n, mean, second, third = state
        return n, mean, second / n, math.sqrt(n) * third / second**1.5 if second > 0 else None


class SharedPrefix:
    """The longest text with which all texts of a group begin; null without a text."""

    result = "string"

    def add(self, state: str | None, values: pa.Array) -> str | None:
        texts = values.drop_null().to_pylist()
        return self.merge(state, self.merge(min(texts), max(texts))) if texts else state

    def merge(self, left: str | None, right: str | None) -> str | None:
        if left is None or right is None:
            return right if left is None else left
        n = next((i for i, (a, b) in enumerate(zip(left, right, strict=False)) if a != b), min(len(left), len(right)))
        return left[:n]

    def finish(self, state: str | None) -> str | None:
        return state


def aggregated(df: DataFrame, by: Sequence[str], value: str, function: Aggregate, name: str) -> DataFrame:
    """(by..., name): the function over each group of rows. At most `GROUPS` states are held in a task before they are sent."""
    keys = [f"_k{i}" for i in range(len(by))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict = {}

        def sent() -> pa.RecordBatch:
            columns = [pa.array([k[i] for k in states], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], [*keys, "_state"])

        types: list[pa.DataType] = []
        for batch in batches:
            types = types or [batch.column(i).type for i in range(len(keys))]
            table = pa.table(batch.columns, [*keys, "_v"]).group_by(keys, use_threads=False).aggregate([("_v", "list")])
            for *key, values in zip(*(table.column(k).to_pylist() for k in keys), table.column("_v_list").combine_chunks(), strict=True):
                states[tuple(key)] = function.add(states.get(tuple(key)), values.values)
            if len(states) >= GROUPS:
                yield sent()
                states = {}
        if states:
            yield sent()

    def whole(states: pa.Array) -> Any:
        out = None
        for s in states.to_pylist():
            out = function.merge(out, pickle.loads(s))
        got = function.finish(out)
        return dict(zip(names, got, strict=True)) if len(names) > 1 else got

    names = [c.strip().split(" ")[0] for c in function.result.split(",")]
    slim = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=True)], F.col(f"`{value}`").alias("_v"))
    shape = StructType([*slim.schema.fields[:-1], StructField("_state", BinaryType())])
    merged = arrow_udf(whole, function.result, ArrowUDFType.GROUPED_AGG)
    out = slim.mapInArrow(partial, shape).groupBy(*keys).agg(merged("_state").alias(name))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=True)], name)


@udtf
class Grams:
    """grams(text, n): (place, w1, ..., wn), the runs of n words; n is a constant. Null and shorter texts have none."""

    @staticmethod
    def analyze(text: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not n.isConstantExpression or not isinstance(n.value, int) or n.value < 1:
            raise ValueError("grams asks for a constant number of words, one or more")
        return AnalyzeResult(StructType([StructField("place", IntegerType()), *(StructField(f"w{i}", StringType()) for i in range(1, n.value + 1))]))

    def eval(self, text: str | None, n: int) -> Iterator[tuple]:
        words = text.split(" ") if text is not None else []
        for i in range(len(words) - n + 1):
            yield (i, *words[i : i + n])


def register(spark: SparkSession) -> None:
    """Names for SQL."""
    spark.udtf.register("grams", Grams)
