"""Semi-joins and anti-joins with a filter that is made while they run.

The keys of the smaller side are counted first. Where a Bloom filter for that many stays within `MOST` bits, its words
are made by aggregation and go to all tasks, and rows that no key can match are gone before they are shuffled; what is
left is joined exactly. More keys, or none, are joined without it, so results never depend on the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Save = Callable[[DataFrame, str], DataFrame]
MOST = 1 << 24
BITS, PROBES = 12, 5


def _places(key: Sequence[Column], size: int) -> Column:
    """Bits of a key; its null counts as a value of its own."""
    a, b = F.xxhash64(*key), F.xxhash64(F.lit(1), *key)
    return F.array(*[F.pmod(F.shiftright(a, 8) + i * F.shiftright(b, 8), F.lit(size)) for i in range(PROBES)])


def bloom(keys: DataFrame, on: Sequence[str], most: int = MOST) -> tuple[np.ndarray, int] | None:
    """The filter's words and size in bits, or null where the keys are too many or none."""
    n = keys.select(*on).count()
    if not 0 < n * BITS <= most:
        return None
    size = 1 << max(6, (n * BITS - 1).bit_length())
    bit = keys.select(F.explode(_places([F.col(c) for c in on], size)).alias("b"))
    words = bit.groupBy((F.col("b") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("m")).collect()  # at most `most` / 64
    table = np.zeros(size // 64, np.uint64)
    for r in words:
        table[r["w"]] = np.uint64(r["m"] & (1 << 64) - 1)
    return table, size


def may_match(on: Sequence[str], table: np.ndarray, size: int) -> Column:
    def run(places: pa.Array) -> pa.Array:
        at = places.flatten().to_numpy(zero_copy_only=False)
        hit = (table[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
        return pa.array(hit.reshape(-1, PROBES).all(axis=1))

    return F.arrow_udf(run, "boolean")(_places([F.col(c) for c in on], size))


def semi(rows: DataFrame, keys: DataFrame, on: Sequence[str], most: int = MOST) -> DataFrame:
    """Rows that have a key; null matches nothing."""
    made = bloom(keys, on, most)
    near = rows if made is None else rows.filter(may_match(on, *made))
    return near.join(keys.select(*on).distinct(), list(on), "left_semi").select(rows.columns)


def anti(rows: DataFrame, lists: Sequence[DataFrame], on: Sequence[str], save: Save, most: int = MOST) -> DataFrame:
    """Rows whose key is in none of the lists; those that no list can hold are not joined."""
    keys = lists[0].select(*on)
    for x in lists[1:]:
        keys = keys.union(x.select(*on))
    keys = save(keys.distinct(), "keys")
    made = bloom(keys, on, most)
    if made is None:
        return rows.join(keys, list(on), "left_anti").select(rows.columns)
    marked = save(rows.withColumn("_near", may_match(on, *made)), "marked")
    clear = marked.filter(~F.col("_near")).select(rows.columns)
    return clear.unionByName(marked.filter("_near").join(keys, list(on), "left_anti").select(rows.columns))


def available(asked: DataFrame, records: DataFrame, on: Sequence[str], texts: DataFrame) -> DataFrame:
    """Asked-for keys with whether a record is visible, and its kept text if there is one."""
    keys = asked.select(*on).distinct()
    have = semi(records.select(*on).distinct(), keys, on).withColumn("visible", F.lit(True))
    said = semi(texts, keys, on)
    return keys.join(have, list(on), "left").join(said, list(on), "left").withColumn("visible", F.coalesce("visible", F.lit(False)))
