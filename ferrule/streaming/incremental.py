"""Incremental maintenance: dependency versions, staleness, and a streamed upsert log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ferrule.operators import paths
from ferrule.sources import layers


def effective_versions(nodes: DataFrame, edges: DataFrame, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, eff): the greatest version over all that a node depends on, itself included; cycles are fine.

    A dependency that is no node counts 0 and leads nowhere. `save` writes a table to cut lineage.
    """
    real = edges.select("src", "dst").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").withColumn("w", F.lit(0).cast("long"))
    rows = nodes.select("node", F.coalesce("version", F.lit(0)).cast("long").alias("base"))
    return paths.greatest(rows, real, save, cyclic=True).withColumnRenamed("value", "eff")


def stale(records: DataFrame) -> DataFrame:
    """Tracked records whose digest or dependencies changed or that are older than what they depend on."""
    tracked = F.col("digest").isNotNull() | F.col("deps").isNotNull()
    changed = F.col("stored_digest").isNull() | (F.col("stored_digest") != F.col("digest"))
    moved = F.coalesce(F.array_sort(F.array_distinct("deps")) != F.array_sort(F.array_distinct("stored_deps")), F.lit(True))
    return records.filter(tracked & (changed | moved | (F.coalesce("eff", F.lit(0)) > F.coalesce("interpreted_at", F.lit(0)))))


def upserts(stream: DataFrame, path: str, checkpoint: str, key: str, seq: str) -> StreamingQuery:
    """Appends each batch's last write of every key to the log at `path`; replays add nothing new to the view."""

    def write(batch: DataFrame, batch_id: int) -> None:
        layers.compact(batch, key, seq).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
