"""Work on records as a stream, done once: answers are kept first and marked second, and one bad record spoils nothing else.

Every batch has folders of its own, which a repeated batch writes anew: `answers`, `failed` (a row for each record without
an answer, with the reason) and last `marks`. Readers see only batches that have a mark, so a batch that was cut short is
not there until it is done again. The version from which a batch's records count as interpreted is read before its work
begins: what changes meanwhile is older than it should be and comes up again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ferrule.sources import snapshot

Answer = Callable[[Sequence[Mapping]], Mapping]
BATCH = 20
MARK = "batch long, asked long, answered long, failed long, interpreted_at long"


def answers(rows: DataFrame, key: str, make: Callable[[], Answer], size: int = BATCH) -> DataFrame:
    """(key, answer, failure): every row once. What a group of rows fails on is asked for again one by one."""

    def one_by_one(agent: Answer, part: list[dict]) -> Iterator[tuple[object, str | None, str | None]]:
        try:
            found = agent(part)
        except Exception as e:
            if len(part) > 1:
                for row in part:
                    yield from one_by_one(agent, [row])
                return
            found, reason = {}, f"{type(e).__name__}: {e}"
        else:
            reason = "no answer"
        for row in part:
            said = found.get(row[key])
            yield row[key], said, None if said is not None else reason

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agent = make()
        for batch in batches:
            at = batch.schema.get_field_index(key)
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                got = list(one_by_one(agent, part.to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], part.column(at).type), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], [key, "answer", "failure"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, answer string, failure string")


def kept(batch: DataFrame, number: int, path: str, key: str, make: Callable[[], Answer], version: Callable[[], int]) -> None:
    """One batch: answers, failures, the mark."""
    spark, now = batch.sparkSession, version()
    rows = batch.dropDuplicates([key])
    at = lambda name: f"{path}/{name}/batch={number}"
    answers(rows, key, make).write.mode("overwrite").parquet(at("answers"))
    got = spark.read.parquet(at("answers"))
    got.filter("failure is not null").select(key, "failure").write.mode("overwrite").parquet(at("failed"))
    count = got.agg(F.count("*").alias("asked"), F.count("answer").alias("answered"), F.count("failure").alias("failed"))
    count.select(F.lit(number).cast("long").alias("batch"), "asked", "answered", "failed", F.lit(now).cast("long").alias("interpreted_at")).coalesce(1).write.mode("overwrite").parquet(f"{path}/marks/{number}")


def interpret(stream: DataFrame, path: str, checkpoint: str, key: str, make: Callable[[], Answer], version: Callable[[], int]) -> StreamingQuery:
    """Answers for all rows of a stream; a batch that is repeated adds nothing."""
    step = lambda batch, number: kept(batch, number, path, key, make, version)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def marks(spark: SparkSession, path: str) -> DataFrame:
    if not snapshot.exists(spark, f"{path}/marks"):
        return spark.createDataFrame([], MARK)
    return spark.read.option("recursiveFileLookup", "true").schema(MARK).parquet(f"{path}/marks")


def read(spark: SparkSession, path: str, key: str, name: str = "answers") -> DataFrame:
    """Rows of the batches that are done, with their version; of a key in several batches the last one's."""
    done = marks(spark, path).select("batch", "interpreted_at")
    rows = spark.read.parquet(f"{path}/{name}").join(F.broadcast(done), "batch")  # a row a batch
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(key, "_r.*")


def embedded(records: DataFrame, vectors: DataFrame, theory: str = "theory", key: str = "uk", text: str = "text", version: str = "version") -> DataFrame:
    """(theory, embeddable, missing, version, done): a theory is done where each record with a text has a vector."""
    have = vectors.select(key, F.lit(True).alias("_v")).distinct()
    rows = records.filter(F.col(text).isNotNull()).select(theory, key, version).distinct().join(have, key, "left")
    counts = rows.groupBy(theory).agg(F.count("*").alias("embeddable"), F.count_if(F.col("_v").isNull()).alias("missing"), F.max(version).alias("version"))
    return counts.withColumn("done", F.col("missing") == 0)


def still_embedded(now: DataFrame, marked: DataFrame, theory: str = "theory") -> DataFrame:
    """(theory) of marks that still hold: nothing is missing and no record is newer than the mark."""
    held = marked.select(F.col(theory).alias("_t"), F.col("version").alias("_at"))
    return now.join(held, F.col(theory).eqNullSafe(F.col("_t"))).filter(F.col("done") & (F.coalesce("version", F.lit(0)) <= F.coalesce("_at", F.lit(0)))).select(theory)
