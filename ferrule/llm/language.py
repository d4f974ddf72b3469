"""Language identification by bit-sliced Bloom filters over n-grams.

One Bloom filter for each language, stored bit-sliced: a slot is a mask with a bit for each
language, so one probe (the AND of `PROBES` slots) returns all languages that contain an n-gram.
N-grams are four bytes of the lower-cased letters of a text, words being set off by spaces, and
whole words. A text's n-grams are counted per language (popcount of each bit), the counts are
corrected for the filters' false-positive rates, and the highest decides.

Learning: a bounded sample (`SAMPLE` rows of each language, in the order of a hash) of labelled rows
outside the held-out fold. A language's n-grams are those in at least `MIN_SHARE` of its sampled
texts, and at no less than `MIN_RATIO` of the share that they have in any other language, which
keeps quotations in other languages out; the `CAPACITY` most frequent go into its filter.

Defined cases: null text, or one without a letter: `und` with score 0; a text whose n-grams no
filter holds takes the language with most sampled rows, score 0; ties go to the language with more
sampled rows, then to the first by name; no labelled row: `und`; repeated rows count as rows; long
texts are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._work import Workspace, fresh, read, tidy
from ._words import U64, chunks, hash_words, mix

SAMPLE = 1500
MIN_SHARE = 0.004
MIN_RATIO = 0.15
CAPACITY = 30_000
SLOT_BITS = 20
PART_BYTES = 4 << 20  # of text held as Python strings at once
PROBES = 3
LEAST = 0.2
OTHER = re.compile(r"[\W\d_]+")
LETTER = regex.compile(r"\p{L}")


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """By chunks of rows: low, high, feature hashes, n+1 offsets of the texts, whether a text has a letter."""
    for begin, end, _, _ in chunks(column, PART_BYTES):
        texts = column.slice(begin, end - begin).to_pylist()
        plain = [f" {OTHER.sub(' ', t.lower())} ".replace("  ", " ") if t and LETTER.search(t) else "" for t in texts]
        has = np.array([bool(p) for p in plain], bool)
        for low, high, raw, offsets in chunks(pa.array(plain, pa.string())):
            yield begin + low, begin + high, *_hashes(raw, offsets), has[low:high]


def _hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams and words, and n+1 offsets of the texts."""
    words, at = hash_words(raw, offsets)
    if len(raw) < 4:
        return words, at
    b = raw.astype(U64)
    gram = b[:-3] | b[1:-2] << U64(8) | b[2:-1] << U64(16) | b[3:] << U64(24)
    own = (raw[1:-2] != 32) & (raw[2:-1] != 32)
    edge = offsets[1:-1]
    for back in (1, 2, 3):  # no gram goes over the end of its text
        cut = edge - back
        own[cut[(cut >= 0) & (cut < len(own))]] = False
    where = np.flatnonzero(own)
    n = len(offsets) - 1
    owner = np.concatenate((np.searchsorted(offsets, where, "right") - 1, np.repeat(np.arange(n), np.diff(at))))
    every = np.concatenate((mix(gram[where] + U64(0xA24BAED4963EE407)), words))
    order = np.argsort(owner, kind="stable")
    return every[order], np.searchsorted(owner[order], np.arange(n + 1))


@dataclass(frozen=True)
class Filters:
    names: tuple[str, ...]  # most sampled rows first, then by name
    slots: np.ndarray  # uint64, (planes, 2**SLOT_BITS): bit i of plane p is language 64 p + i
    false_rate: np.ndarray

    @staticmethod
    def probes(hashes: np.ndarray) -> list[np.ndarray]:
        other = hashes >> U64(32) | U64(1)
        return [((hashes + U64(i) * other) >> U64(7) & U64((1 << SLOT_BITS) - 1)).astype(np.int64) for i in range(PROBES)]

    @classmethod
    def build(cls, names: list[str], grams: dict[str, np.ndarray]) -> Filters:
        slots = np.zeros((max(1, (len(names) + 63) // 64), 1 << SLOT_BITS), U64)
        rate = np.zeros(len(names))
        for i, name in enumerate(names):
            for at in cls.probes(grams.get(name, np.zeros(0, U64))):
                np.bitwise_or.at(slots[i // 64], at, U64(1) << U64(i % 64))
            rate[i] = np.mean(slots[i // 64] >> U64(i % 64) & U64(1)) ** PROBES
        return cls(tuple(names), slots, rate)

    def languages(self, hashes: np.ndarray) -> np.ndarray:
        """Masks (planes, n): all languages that contain each n-gram."""
        found = None
        for at in self.probes(hashes):
            found = self.slots[:, at] if found is None else found & self.slots[:, at]
        return found

    def shares(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(texts, languages): corrected shares of a text's n-grams."""
        masks, n = self.languages(hashes), np.diff(at)
        out = np.zeros((len(n), len(self.names)))
        for i in range(len(self.names)):
            total = np.concatenate(([0], np.cumsum(masks[i // 64] >> U64(i % 64) & U64(1), dtype=np.int64)))
            hits = total[at[1:]] - total[at[:-1]]
            out[:, i] = (hits / np.maximum(n, 1) - self.false_rate[i]) / (1 - self.false_rate[i])
        return np.clip(out, 0, 1)


def fold(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang = batch.column(1).to_pylist()
        for low, high, hashes, at, _ in features(batch.column(0)):
            own = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(high - low)]
            if sum(map(len, own)):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array(lang[low:high], object), [len(x) for x in own]), pa.string()), pa.array(np.concatenate(own).view(np.int64)),
                ], ["lang", "gram"])


def _first(rows: DataFrame, sample: int, work: Workspace) -> DataFrame:
    """The first `sample` rows (text, lang) of each language in the order of a hash of doc_id, doc_id, text.

    No task orders a language: counts of 4096 parts of the hash's range, and once more of the part in
    which the sample ends, leave 2**-24 of the rows to be put in order, equal ones as one with a count.
    """
    at = F.col("doc_id").cast("string")
    rows = rows.withColumn("_u", F.shiftrightunsigned(F.xxhash64("doc_id").bitwiseXOR(F.lit(-(1 << 63))), 40))
    slim = work.save(rows.select("lang", "_u"), "slim")
    cuts: dict[str, tuple[int, int]] = {}  # a row for each language, as in the model: the part in which its sample ends, and what is left then
    for shift in (12, 0):
        near = slim
        if cuts:
            near = slim.join(F.broadcast(_cut_rows(slim.sparkSession, cuts)), "lang").filter(F.shiftrightunsigned("_u", 12) == F.col("_cut"))
        elif shift == 0:  # every language fits whole
            break
        sums = near.groupBy("lang", F.shiftrightunsigned("_u", shift).alias("b")).agg(F.count("*").alias("n"))
        sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("lang").orderBy("b")))
        left = F.element_at(F.create_map(*[F.lit(x) for k, v in cuts.items() for x in (k, v[1])]), F.col("lang")) if cuts else F.lit(sample)
        hit = sums.withColumn("left", left).filter((F.col("upto") - F.col("n") < F.col("left")) & (F.col("upto") >= F.col("left")))
        cuts = {r["lang"]: (r["b"], r["left"] - r["upto"] + r["n"]) for r in hit.collect()}
    if not cuts:
        return rows.select("text", "lang")
    rows = rows.join(F.broadcast(_cut_rows(slim.sparkSession, cuts)), "lang", "left")
    clear = rows.filter(F.col("_cut").isNull() | (F.col("_u") < F.col("_cut"))).select("text", "lang")
    edge = rows.filter(F.col("_u") == F.col("_cut")).groupBy("lang", "doc_id", "text", "_left").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), at, "text").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = edge.withColumn("_take", F.least(F.col("n"), F.col("_left") - before).cast("int")).filter("_take > 0")
    return clear.unionByName(edge.select("text", "lang", F.explode(F.sequence(F.lit(1), "_take"))).select("text", "lang"))


def _cut_rows(spark: SparkSession, cuts: dict[str, tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in cuts.items()], "lang string, _cut long, _left long")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Filters:
    """Learns from `docs` (text, lang, and doc_id for the order of the sample)."""
    work = Workspace(docs.sparkSession, "lang")
    chosen = work.save(_first(docs.filter("lang is not null and text is not null").select("lang", "doc_id", "text"), sample, work), "sample")
    sizes = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not sizes:
        return Filters.build([], {})
    names = sorted(sizes, key=lambda x: (-sizes[x], x))
    total = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("lang"))
    share = chosen.mapInArrow(tidy(_distinct), "lang string, gram long").groupBy("lang", "gram").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / total)
    share = share.filter((F.col("n") >= 2) & (F.col("share") >= MIN_SHARE))
    share = share.withColumn("top", F.max("share").over(Window.partitionBy("gram"))).filter(F.col("share") >= MIN_RATIO * F.col("top"))
    share = share.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("_r") <= CAPACITY)
    got: pd.DataFrame = share.select("lang", "gram").toPandas()  # at most CAPACITY rows for each language
    return Filters.build(names, {k: v["gram"].to_numpy(np.int64).view(U64) for k, v in got.groupby("lang")})


def identify(docs: DataFrame, filters: Filters, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of `docs`, and the prediction and its score, from the text alone."""
    place = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")
    held = docs.sparkSession.sparkContext.broadcast(filters)  # 2**SLOT_BITS masks: a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        labels = np.array([*model.names, "und"], object)
        for batch in batches:
            pred, score = np.full(batch.num_rows, len(model.names)), np.zeros(batch.num_rows)
            for low, high, hashes, at, has in features(batch.column(place)):
                if model.names:
                    share = model.shares(hashes, at)
                    pred[low:high] = np.where(has, share.argmax(1), len(model.names))
                    score[low:high] = np.where(has, share.max(1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels[pred], pa.string()), pa.array(score)], [*batch.schema.names, *names])

    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])
    return docs.mapInArrow(tidy(run), schema)


def train_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.coalesce(fold(), F.lit(0)) != 1)


def keep_identified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents in a learned language: those without letters go, and those of whose n-grams no language has `least`."""
    pred, score = fresh(docs, "_lang_pred"), fresh(docs, "_lang_score")
    out = identify(docs, fit(docs), (pred, score))
    return out.filter((F.col(pred) != "und") & (F.col(score) >= least)).select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    filters = fit(train_rows(docs))
    slim = docs.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "text")
    return identify(slim, filters).select("doc_id", "held_out", "lang_pred", "score")
