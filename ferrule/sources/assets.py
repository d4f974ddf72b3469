"""The tokenizer's asset: built from symbol files and a scan of all code points, written, loaded, and held to golden vectors.

Symbol files are texts with a line for each symbol, `\\<name>  code: 0x0003b1  group: ...`; of files that define one name
the last wins. An asset is one JSON text, known by its digest. Golden vectors are texts with the tokens and subtokens that
the asset gives, under a meta file with their number, a digest and the asset's digest, and a history of digests.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions import lexer
from ferrule.operators.relational import islands
from ferrule.sources import snapshot

LINE = r"^(\\<\^?[A-Za-z][A-Za-z0-9_']*>).*?\bcode:\s*0x([0-9a-fA-F]+)"
POINTS = 0x110000


def symbols(spark: SparkSession, paths: Sequence[str]) -> dict[str, str]:
    """Names to characters from symbol files in order: a table of some hundreds of rows."""
    rows = None
    for n, path in enumerate(paths):
        lines = spark.read.text(path).select(F.regexp_extract("value", LINE, 1).alias("name"), F.regexp_extract("value", LINE, 2).alias("code"), F.lit(n).alias("n")).filter("name <> ''")
        rows = lines if rows is None else rows.unionByName(lines)
    if rows is None:
        return {}
    last = rows.groupBy("name").agg(F.max_by("code", F.struct("n", "code")).alias("code"))
    return {r["name"]: chr(int(r["code"], 16)) for r in last.collect()}


def code_ranges(spark: SparkSession, holds: Callable[[str], bool]) -> list[tuple[int, int]]:
    """Code points for which `holds`, as inclusive ranges, by a scan of all of them in tasks."""

    def run(points: pa.Array) -> pa.Array:
        return pa.array([holds(chr(p)) for p in points.to_pylist()], pa.bool_())

    found = spark.range(POINTS).filter(F.arrow_udf(run, "boolean")("id")).withColumnRenamed("id", "cp")
    return sorted((r["low"], r["high"]) for r in islands(found, "cp").collect())


def build(spark: SparkSession, paths: Sequence[str]) -> dict:
    """The asset for the symbols of those files; the marks are always known."""
    controls = {rf"\<{k}>": v for k, v in lexer.CONTROLS.items()}
    return lexer.asset_of(controls | symbols(spark, paths), *(code_ranges(spark, f) for f in (str.isalpha, lexer.is_digit, str.isspace)))


def as_text(asset: dict) -> str:
    return json.dumps(asset, ensure_ascii=False, sort_keys=True, indent=1) + "\n"


def digest(asset: dict) -> str:
    return hashlib.sha256(as_text(asset).encode()).hexdigest()


def write(spark: SparkSession, asset: dict, path: str) -> str:
    """Writes the asset; its digest. What is built from it belongs under `snapshot.namespace` of the same text."""
    snapshot.write_text(spark, path, as_text(asset))
    return digest(asset)


def load(spark: SparkSession, path: str) -> lexer.Lexer:
    """Refuses what follows another rule."""
    return lexer.Lexer(json.loads(snapshot.read_text(spark, path)))


def vectors(texts: DataFrame, asset: dict) -> DataFrame:
    """(id, input, tokens, subtokens)."""
    own = lexer.Lexer(asset)
    return texts.select("id", "input", lexer.tokens_of(F.col("input"), own).alias("tokens"), lexer.subtokens_of(F.col("input"), own).alias("subtokens"))


def sampled(texts: DataFrame, share: int) -> DataFrame:
    """About one text in `share`, the same ones on every run: those whose hash is below a threshold."""
    head = F.conv(F.substring(F.sha2("input", 256), 1, 12), 16, 10).cast("long")
    return texts.filter(head < (1 << 48) // share)


def write_vectors(texts: DataFrame, asset: dict, path: str) -> dict:
    """Writes vectors as JSON lines, then the meta file, then the history with one more line."""
    spark = texts.sparkSession
    vectors(texts, asset).write.mode("overwrite").json(f"{path}/vectors")
    meta = {**_stated(_read(spark, path)), "asset": digest(asset)}
    snapshot.write_text(spark, f"{path}/meta.json", json.dumps(meta, sort_keys=True))
    known = snapshot.read_text(spark, f"{path}/history.txt") if snapshot.exists(spark, f"{path}/history.txt") else ""
    snapshot.write_text(spark, f"{path}/history.txt", f"{known}{meta['digest']}\n")
    return meta


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, input string, tokens array<string>, subtokens array<string>").json(f"{path}/vectors")


def _stated(rows: DataFrame) -> dict:
    return {"count": rows.count(), "digest": snapshot.digest(rows)}


def check_vectors(spark: SparkSession, path: str, asset: dict) -> list[str]:
    """What is wrong: changed files, another asset, a history that doesn't end here, and at most five texts that differ."""
    rows, meta = _read(spark, path), json.loads(snapshot.read_text(spark, f"{path}/meta.json"))
    out = [f"{k} is {v}, stated {meta[k]}" for k, v in (_stated(rows) | {"asset": digest(asset)}).items() if v != meta[k]]
    history = snapshot.read_text(spark, f"{path}/history.txt").split()
    if not history or history[-1] != meta["digest"]:
        out.append("the history doesn't end with this digest")
    now = vectors(rows.select("id", "input"), asset).select(F.col("id").alias("_id"), F.col("tokens").alias("_t"), F.col("subtokens").alias("_s"))
    wrong = rows.join(now, F.col("id") == F.col("_id")).filter(~(F.col("tokens") == F.col("_t")) | ~(F.col("subtokens") == F.col("_s")))
    return [*out, *(f"{r['id']}: {r['_t']} / {r['_s']}" for r in wrong.orderBy("id").limit(5).collect())]
