"""Tables that cut lineage, written below the folder that all machines share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ferrule-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def tables(spark: SparkSession, name: str) -> Callable[[DataFrame, str], DataFrame]:
    """save(df, name): writes a table and reads it; all of them go when the program ends."""
    root = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"

    def gone() -> None:
        try:
            delete(spark, root)
        except Exception:  # the session has ended already
            pass

    atexit.register(gone)

    def save(df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{table}")
        return spark.read.schema(df.schema).parquet(f"{root}/{table}")

    return save
