"""MinHash near-duplicates with tensored banding.

Two collections of `m` hashes, each made of `R` minhashes, are computed for a document's set of word
shingles; a table's key joins one hash of either collection, so 2 m R minhashes serve m * m tables.
`m` follows from the threshold and from the chance that a pair at the threshold shares no key
(`MISS`); it is 7 at 0.85 and 9 at 0.8.

1. One Python pass over the texts: size, 128-bit digest and table keys of each set, written out.
2. Equal sets become one class (grouping with partial sums): copies cost no pairs.
3. Tables: each key's classes are compared with the key's hub, never all with all. The hub is the class
   that stands in the largest keys, so of a group of edited copies one close to what they come from.
   Pairs are made distinct and confirmed on full sets of those documents alone.
4. Connected components over confirmed links, by neighbours' labels and pointer jumping.
5. Keys whose other classes are still in two or more components are taken up again, exactly: each class
   is written as its difference from the hub's set, d shingles that only one of the two has. Two
   classes with n and n' shingles are alike where their differences have at least
   (d + d' - (n + n') (1 - s) / (1 + s)) / 2 in common, which is above zero unless both are linked to the hub.
   A prefix filter over the differences finds the pairs that can: rarest first, as many as a class may
   have beyond what it must share, and only where as many can still follow in both. Copies edited in many
   places differ from the hub in shingles of their own and drop out without a pair. Links inside a
   component are needless for its members; no link between components of classes that share a key is
   left out.

Defined cases: null or empty text: empty set, linked with nothing; fewer words than a shingle: the
whole sequence is the one shingle; equal rows are one class; rows without doc_id are linked but give
no component name, unless alone (null); rows that share a doc_id are texts of their own, each with its
links; a long text is one set, whole; other columns are kept by `keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import Workspace, read, tidy
from ._words import GRAM, U64, chunks, grams, hash_words, mix

R = 2
MISS = 5e-4
SEEDS = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
ODD = mix(np.arange(1001, 1257, dtype=U64)) | U64(1)


def collection_size(threshold: float, miss: float = MISS) -> int:
    """Least m so that a pair at the threshold shares a key but for a chance of `miss`."""
    return math.ceil(math.log(1 - math.sqrt(1 - miss)) / math.log(1 - threshold**R))


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By chunks of rows: low, high, the sorted distinct shingles of all texts, n+1 offsets."""
    for low, high, raw, offsets in chunks(column):
        words, at = hash_words(raw, offsets)
        g = grams(words, k)
        sets = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                sets.append(np.unique(g[a : b - k + 1]))
            elif b > a:  # the whole sequence
                x = np.array([b - a], U64)
                for w in range(a, b):
                    x = mix(x * GRAM[7] + words[w : w + 1])
                sets.append(x)
            else:
                sets.append(np.zeros(0, U64))
        yield low, high, np.concatenate(sets) if sets else np.zeros(0, U64), np.concatenate(([0], np.cumsum([len(s) for s in sets])))


def table_keys(values: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """(sets, m * m) keys; sets must not be empty."""
    sides = []
    for side in range(2):
        hashes = []
        for i in range(m):
            joined = np.full(len(at) - 1, U64(0))
            for j in range(R):
                n = (side * m + i) * R + j
                x = (values ^ SEEDS[n]) * ODD[n]
                x ^= x >> U64(29)
                joined = mix(joined * GRAM[3] + np.minimum.reduceat(x, at[:-1]))
            hashes.append(joined)
        sides.append(hashes)
    return np.stack([mix(a * GRAM[0] + b * GRAM[1] + U64(i * m + j + 1)) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[1])], axis=1)


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    return tuple(int(np.add.reduce(mix(x)).view(np.int64)) for x in (values ^ GRAM[4], values + GRAM[5]))


def _signed(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, values, at in shingle_sets(batch.column(1), k):
            size = np.diff(at)
            full = np.flatnonzero(size)
            h1, h2 = np.zeros(high - low, U64), np.zeros(high - low, U64)
            keys = np.zeros(0, U64)
            if len(full):
                begin = at[:-1][full]
                h1[full] = np.add.reduceat(mix(values ^ GRAM[4]), begin)
                h2[full] = np.add.reduceat(mix(values + GRAM[5]), begin)
                keys = table_keys(values, np.concatenate((begin, [len(values)])), m).ravel()
            bounds = np.concatenate(([0], np.cumsum(np.where(size > 0, m * m, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(low, high - low), pa.array(size, pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.view(np.int64))),
            ], ["doc_id", "n", "h1", "h2", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, values, at in shingle_sets(batch.column(1), k):
            part = batch.slice(low, high - low)
            nodes, rows = [], []
            for node, n, h1, h2, a, b in zip(*(part.column(i).to_pylist() for i in (0, 2, 3, 4)), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own = values[a:b]
                if (b - a, *digest(own)) == (n, h1, h2):  # rows with one doc_id can hold several sets
                    nodes.append(node), rows.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(rows, pa.binary())], ["node", "shingles"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, hub, own set, the hub's) to a row for each shingle that only one of them has, marked by which."""
    for batch in batches:
        for node, hub, own, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            own, other = np.frombuffer(own.as_py(), U64), np.frombuffer(other.as_py(), U64)
            more, less = np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True)
            both = np.concatenate((more, mix(less ^ GRAM[6])))
            n = len(both)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, x, np.int64)) for x in (node, hub, n)), pa.array(both.view(np.int64))], ["node", "hub", "d", "shingle"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        last, left = None, None
        n = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            raw = b.as_py()
            if raw != last:
                last, left = raw, np.frombuffer(raw, U64)
            n.append(len(np.intersect1d(np.frombuffer(a.as_py(), U64), left, assume_unique=True)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["a", "b", "common"])


class Links:
    """The steps over one table of documents (doc_id, text); thresholds in hundredths."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.k, self.percent, self.m = k, percent, collection_size(percent / 100)
        self.spark = docs.sparkSession
        self.work = Workspace(self.spark, "neardup")

    def near_size(self, a: str, b: str):
        return (F.col(a) * 100 >= F.col(b) * self.percent) & (F.col(b) * 100 >= F.col(a) * self.percent)

    def signatures(self) -> DataFrame:
        k, m = self.k, self.m
        return self.work.save(self.docs.mapInArrow(tidy(lambda it: _signed(it, k, m)), "doc_id long, n long, h1 long, h2 long, keys array<long>"), "signed")  # the one pass over all texts

    def sets(self, nodes: DataFrame) -> DataFrame:
        """Full sets of those classes, each from a row of its doc_id that holds this set."""
        k = self.k
        texts = self.docs.join(nodes, self.docs["doc_id"].eqNullSafe(nodes["least"])).select("node", "text", "n", "h1", "h2")
        rows = texts.mapInArrow(tidy(lambda it: _sets(it, k)), "node long, shingles binary")
        return rows.dropDuplicates(["node"])

    def confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """Of distinct (a, b, na, nb), those whose sets are alike enough."""
        pairs = self.work.save(pairs, f"pairs-{name}")
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        known = self.classes.select("node", "least", "n", "h1", "h2").join(nodes, "node", "left_semi")
        sets = self.work.save(self.sets(known), f"sets-{name}")
        wide = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        size = pairs.select("a", "b", "na", "nb")
        found = wide.select("a", "b", "sa", "sb").mapInArrow(tidy(_common), "a long, b long, common long")
        found = found.join(size, ["a", "b"]).filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * self.percent)
        out = self.work.save(found.select("a", "b"), f"links-{name}")
        self.work.drop(f"sets-{name}")
        return out

    def across(self, rows: DataFrame) -> DataFrame:
        """From (hub, hub_n, node, n, label): pairs (a, b, na, nb) of different labels that may be alike, by differences from the hub."""
        p, q = 100 + self.percent, 100 - self.percent
        nodes = rows.select("node").union(rows.select("hub")).distinct()
        known = self.classes.select("node", "least", "n", "h1", "h2").join(nodes, "node", "left_semi")
        sets = self.work.save(self.sets(known), "sets-open")
        wide = rows.select("node", "hub").join(sets.withColumnRenamed("shingles", "own"), "node").join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("other")), "hub")
        parts = self.work.save(wide.select("node", "hub", "own", "other").mapInArrow(tidy(_differences), "node long, hub long, d long, shingle long"), "differences")
        shared = parts.groupBy("hub", "shingle").agg(F.count("*").alias("df")).filter("df > 1")
        own = Window.partitionBy("node", "hub")
        # shingles of one class alone come first in the order and are not needed further
        ranked = parts.join(shared, ["hub", "shingle"]).withColumn("place", F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "shingle")))
        ranked = ranked.join(rows, ["node", "hub"]).withColumn("far", F.col("d") * p > q * (F.col("n") + F.col("hub_n")))
        most = F.when(F.col("far"), F.ceil((F.col("d") * p - q * (F.col("n") + F.col("hub_n"))) / 200))  # shared with a class that the hub is linked to
        half = F.greatest(F.ceil(F.col("d") * self.percent / p), F.lit(1))  # shared with one that it isn't
        ranked = ranked.withColumns({"in_far": F.col("place") <= F.col("d") - half + 1, "in_near": F.col("far") & (F.col("place") <= F.col("d") - F.greatest(most, F.lit(1)) + 1)})
        ranked = self.work.save(ranked.filter("in_far or in_near").select("hub", "shingle", "node", "n", "label", "d", "place", "far", "in_far", "in_near"), "prefixes")
        mixed = ranked.groupBy("hub", "shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("far").alias("any")).filter("low < high and any").select("hub", "shingle")
        ranked = ranked.join(mixed, ["hub", "shingle"])
        right = ranked.filter("in_far").select("hub", "shingle", *(F.col(c).alias(f"{c}_") for c in ("node", "n", "label", "d", "place", "far")))
        follow = 1 + F.least(F.col("d") - F.col("place"), F.col("d_") - F.col("place_"))  # shared ones from here on, in the common order
        enough = 2 * p * follow >= p * (F.col("d") + F.col("d_")) - q * (F.col("n") + F.col("n_"))
        once = F.when(F.col("far_"), F.col("in_far") & (F.col("node") > F.col("node_"))).otherwise(F.col("in_near"))
        found = ranked.filter("far").join(right, ["hub", "shingle"]).filter(once & enough & (F.col("label") != F.col("label_")) & self.near_size("n", "n_"))
        low = F.col("node") < F.col("node_")
        return found.select(F.greatest("node", "node_").alias("a"), F.least("node", "node_").alias("b"), F.when(low, F.col("n_")).otherwise(F.col("n")).alias("na"), F.when(low, F.col("n")).otherwise(F.col("n_")).alias("nb")).distinct()

    def components(self, links: DataFrame, name: str) -> DataFrame:
        """(node, label): the least node that can be reached; only nodes with links."""
        edges = self.work.save(links.union(links.select("b", "a")).toDF("u", "v").distinct(), f"edges-{name}")
        labels = edges.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
        turn = 0
        while True:
            near = edges.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
            step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
            jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
            step = step.join(jump, "label").select("node", "old", F.least("label", "far").alias("label"))
            step = self.work.save(step, f"labels-{name}-{turn}")
            moved = step.filter("label <> old").limit(1).count()
            labels = step.select("node", "label")
            if turn:
                self.work.drop(f"labels-{name}-{turn - 1}")
            turn += 1
            if not moved:
                return labels

    def run(self) -> DataFrame:
        """Rows of the documents: doc_id, n, h1, h2, component_id and label (null for empty sets)."""
        signed = self.signatures()
        same = signed.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("least"), F.first("keys").alias("keys"))
        self.classes = self.work.save(same.withColumn("node", F.xxhash64("n", "h1", "h2")), "classes")  # a number of its own, as sets may share a doc_id
        tables = self.classes.select("node", "n", F.explode("keys").alias("key"))
        many = tables.groupBy("key").agg(F.count("*").alias("classes")).filter("classes > 1")
        shared = self.work.save(tables.join(many, "key"), "keys")
        weight = shared.groupBy("node").agg(F.sum("classes").alias("weight"))
        hub = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("hub")).select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
        shared = self.work.save(shared.join(hub, "key").filter("node <> hub"), "shared")
        low = F.col("node") < F.col("hub")
        pairs = shared.filter(self.near_size("n", "hub_n")).select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b"), F.when(low, F.col("hub_n")).otherwise(F.col("n")).alias("na"), F.when(low, F.col("n")).otherwise(F.col("hub_n")).alias("nb")).distinct()
        links = self.confirm(pairs, "0")
        labels = self.components(links, "0")
        named = shared.filter("classes > 2").select("key", "hub", "hub_n", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        open_keys = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
        open_keys = self.work.save(open_keys, "open-keys")  # of known size: the join is broadcast or may be split
        rows = self.work.save(named.join(open_keys, "key", "left_semi").select("hub", "hub_n", "node", "n", "label").distinct(), "open")
        if rows.limit(1).count():
            found = self.confirm(self.across(rows), "1")
            if found.limit(1).count():
                labels = self.components(links.union(found), "1")
        least = self.classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        names = least.groupBy("label").agg(F.min("least").alias("component_id"))
        named = least.select("n", "h1", "h2", "label").join(names, "label")
        out = signed.select("doc_id", "n", "h1", "h2").join(named, ["n", "h1", "h2"], "left")
        return out.select("doc_id", "n", "h1", "h2", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "label")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: whether the document names its component."""
    out = Links(docs, k, percent).run().select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Of each component the row with the least doc_id (null first); all rows without a word."""
    slim = docs.select("text", slim_key(docs).alias("doc_id"))
    first = docs.select(F.col("doc_id").alias("_id"), slim_key(docs).alias("_key")).distinct()
    found = Links(slim, k, percent).run().filter("n > 0").select(F.col("doc_id").alias("_key"), "label").distinct()
    kept = found.join(first, "_key").groupBy("label").agg(F.min(F.struct("_id", "_key"))["_key"].alias("_key")).select("_key")
    wordy = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    whole = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_row")  # so no other column can have a name in use here
    rows = docs.filter(wordy).select(slim_key(docs).alias("_key"), whole).join(kept, "_key", "left_semi").dropDuplicates(["_key"]).select("_row.*")
    return rows.unionByName(docs.filter(~wordy))


def slim_key(docs: DataFrame):
    """A number for each (doc_id, text), as rows may share a doc_id."""
    return F.xxhash64(F.coalesce(docs["doc_id"].cast("string"), F.lit("null")), docs["text"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), 3, 85)
