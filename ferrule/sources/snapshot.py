"""Snapshots of a store: a folder of Parquet tables and a manifest, on any file system that Spark reads.

Exported to a folder of their own, gated, installed by two renames, found by precedence. A folder
without a valid manifest is no snapshot.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"
SCHEMA_VERSION = 1
VECTOR_FORMAT = "q15"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return bool(fs.exists(at))


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a folder, null where it has none or one that can't be read."""
    if not exists(spark, f"{path}/{MANIFEST}"):
        return None
    try:
        rows = spark.read.text(f"{path}/{MANIFEST}", wholetext=True).collect()  # one small file
        found = json.loads(rows[0][0])
    except (ValueError, IndexError):
        return None
    return found if isinstance(found, dict) else None


def is_valid(manifest: dict | None) -> bool:
    return bool(manifest) and manifest.get("schema_version") == SCHEMA_VERSION and manifest.get("vector_format") == VECTOR_FORMAT


def find(spark: SparkSession, folders: Sequence[str]) -> str | None:
    """The first folder with a valid manifest; others count as absent."""
    return next((x for x in folders if is_valid(read_manifest(spark, x))), None)


def row_hash(df: DataFrame) -> tuple:
    """Two independent numbers of 60 bits for a row, by its columns in order of name; text and null differ."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))
    both = F.sha2(text, 256)
    return tuple(F.conv(F.substring(both, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16))


def digest(df: DataFrame) -> str:
    """Of a table's rows in any order, each as often as it stands: two sums of hashes and the number of rows."""
    a, b = row_hash(df)
    got = df.agg(F.coalesce(F.sum(a), F.lit(0)).alias("a"), F.coalesce(F.sum(b), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    return f"{int(got['a']):x}-{int(got['b']):x}-{got['n']}"


def export(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, gates: Mapping[str, DataFrame] | None = None) -> dict:
    """Writes the tables, then the manifest as the last file. A gate with rows stops it before anything is written."""
    for what, rows in (gates or {}).items():
        if rows.limit(1).count():
            raise ValueError(f"not exported: {what}")
    stats = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        fs, at = _fs(spark, f"{path}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        stats[name] = {"entries": back.count(), "bytes": fs.getContentSummary(at).getLength(), "digest": digest(back)}
    manifest = {"schema_version": SCHEMA_VERSION, "vector_format": VECTOR_FORMAT, "tables": stats}
    write_text(spark, f"{path}/{MANIFEST}", json.dumps(manifest, sort_keys=True))
    return manifest


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """One small file, whole."""
    return spark.read.text(path, wholetext=True).first()[0]


def check(spark: SparkSession, path: str) -> dict:
    """The manifest, if every table has the rows that it states."""
    manifest = read_manifest(spark, path)
    if not is_valid(manifest):
        raise ValueError("no valid manifest")
    for name, stat in manifest["tables"].items():
        df = spark.read.parquet(f"{path}/{name}")
        if df.count() != stat["entries"] or digest(df) != stat["digest"]:
            raise ValueError(f"{name} differs from its manifest")
    return manifest


def install(spark: SparkSession, payload: str, target: str, force: bool = False) -> bool:
    """Puts a checked payload in the target's place by two renames; false where the same is there already.

    What an install that was cut short has left - the old snapshot beside an absent target - is put back first.
    """
    heal(spark, target)
    manifest = check(spark, payload)
    if not force and read_manifest(spark, target) == manifest:
        return False
    fs, at = _fs(spark, target)
    _, new = _fs(spark, f"{target}.new-{uuid.uuid4().hex}")
    _, old = _fs(spark, f"{target}.old")
    _, source = _fs(spark, payload)
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, fs, new, False, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError("the payload couldn't be copied")
    if fs.exists(at):
        fs.delete(old, True)
        if not fs.rename(at, old):
            raise OSError("the old snapshot couldn't be moved")
    if not fs.rename(new, at):
        fs.rename(old, at)
        raise OSError("the new snapshot couldn't be moved")
    fs.delete(old, True)
    return True


def heal(spark: SparkSession, target: str) -> None:
    fs, at = _fs(spark, target)
    _, old = _fs(spark, f"{target}.old")
    if fs.exists(old):
        if fs.exists(at):
            fs.delete(old, True)
        else:
            fs.rename(old, at)


# What Spark and Parquet say of a file that isn't readable as such.
DAMAGED = ("is not a Parquet file", "Could not read footer", "CANNOT_READ_FILE_FOOTER", "CANNOT_READ_FOOTER", "ParquetDecodingException", "Corrupted file", "corrupt")


def set_aside(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table with a damaged file is moved aside and an empty one stands in its place; else the table.

    Any other failure, such as a lost executor, is raised and leaves the table where it is.
    """
    try:
        df = spark.read.schema(schema).parquet(path)
        df.agg(F.count("*")).first()
        return df
    except Exception as e:
        if not any(x in str(e) for x in DAMAGED):
            raise
    fs, at = _fs(spark, path)
    _, aside = _fs(spark, f"{path}.corrupt-{uuid.uuid4().hex}")
    fs.rename(at, aside)
    spark.createDataFrame([], schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def backup(spark: SparkSession, path: str, to: str, spare: float = 1.1) -> None:
    """A copy, where the file system has room for it."""
    fs, at = _fs(spark, path)
    target_fs, target = _fs(spark, to)
    if target_fs.getStatus(target.getParent()).getRemaining() < spare * fs.getContentSummary(at).getLength():
        raise OSError("not enough room for a backup")
    if not spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, target_fs, target, False, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError("the backup couldn't be written")


def newest_build(packages: DataFrame) -> DataFrame:
    """(file, version, build_number): the newest by dotted numbers, then the build."""
    from ferrule.functions.text import version_key

    return packages.agg(F.max_by(F.struct(*packages.columns), F.struct(version_key(F.col("version")), "build_number")).alias("p")).select("p.*")


def namespace(asset: bytes) -> str:
    """The folder of what was built from an asset."""
    return f"site-{hashlib.sha256(asset).hexdigest()[:16]}"
