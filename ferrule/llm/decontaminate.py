"""Benchmark decontamination by greedy string tiling.

Seeds are runs of `RUN` words, hashed by the polynomial of Karp and Rabin over word hashes, which one
pass gives for all places. The
benchmark is taken in blocks of at most `BLOCK_WORDS` words; a block's seeds go to all tasks, and
each task passes once over whole documents. A document that shares seeds with an item is tiled
against it: maximal matches are taken longest first, their words marked in both, what is left of
overlapping matches goes back, until no match of `RUN` unmarked words remains. Reordered passages
are found, since a tile may lie anywhere. A pair counts where tiles cover at least `COVER` of the
item's words.

Words are lower-cased runs of letters and digits; tiles are compared word by word after hashing.

Defined cases: null and empty texts share nothing; an item with fewer than `RUN` words counts where
all its words stand in the document in a row; equal items and repeated rows each give their own
pairs; rows without an id keep a null; an empty table on either side gives no pairs; long
texts are compared whole; other columns
are kept by `clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import read, tidy
from ._words import GRAM, U64, chunks, hash_words, mix, powers

RUN = 5
COVER = 0.8
BLOCK_WORDS = 1_000_000
WORD = re.compile(r"[^\W_]+")
FILTER_BITS = 22
PAIRS = "doc_id long, item_id long, tiles int, matched long, item_words long, coverage double"


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolled(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of the n words from each place on: a polynomial, from one pass of prefix sums."""
    if len(words) < n:
        return np.zeros(0, U64)
    power, inverse = powers(1 << max(12, len(words).bit_length()))
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * power[: len(words)], out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[: len(words) - n + 1])


def free_runs(marked: np.ndarray) -> np.ndarray:
    """How many words from each place on are unmarked."""
    at = np.arange(len(marked))
    stop = np.minimum.accumulate(np.where(marked, at, len(marked))[::-1])[::-1] if len(marked) else at
    return stop - at


def tile(item: list, doc: list, run: int = RUN) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, length), longest first, then by place.

    The longest match of unmarked words is found by halving lengths, each with one pass of hashes over both
    sides. All matches of that length are marked before shorter ones are looked for, so there are at most as
    many turns as tiles have different lengths: the root of the item's words, twice over.
    """
    if not item or not doc:
        return []
    run = min(run, len(item))
    code: dict = {}
    a = np.array([code.setdefault(w, len(code)) for w in item], np.int64)
    b = np.array([code.get(w, -1) for w in doc], np.int64)
    hashed = [mix(x.view(U64) * GRAM[0] + GRAM[1]) for x in (a, b)]
    marks = [np.zeros(len(item), bool), b < 0]  # a word that the item lacks matches nothing
    tiles, high = [], len(item)

    def places(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(free_runs(marks[side]) >= n)
        return at, rolled(hashed[side], n)[at]

    while high >= run:
        low, top = run - 1, high  # the longest match is longer than low - 1 and no longer than top
        while low < top:
            n = (low + top + 1) // 2
            if len(np.intersect1d(places(0, n)[1], places(1, n)[1])):
                low = n
            else:
                top = n - 1
        if low < run:
            break
        (mine, own), (theirs, other) = places(0, low), places(1, low)
        spots: dict[int, list[int]] = {}
        keep = np.isin(other, own)
        for j, h in zip(theirs[keep][::-1].tolist(), other[keep][::-1].tolist(), strict=True):
            spots.setdefault(h, []).append(j)  # the first place is last
        for i, h in zip(mine.tolist(), own.tolist(), strict=True):
            left = spots.get(h)
            if not left or marks[0][i : i + low].any():
                continue
            while left and marks[1][left[-1] : left[-1] + low].any():
                left.pop()
            if left and (a[i : i + low] == b[left[-1] : left[-1] + low]).all():
                tiles.append((i, left[-1], low))
                marks[0][i : i + low] = marks[1][left[-1] : left[-1] + low] = True
        high = low - 1
    return tiles


class Seeds:
    """A block of the benchmark: its items and the hashes of their runs."""

    def __init__(self, items: list[tuple[int | None, list[str]]], run: int):
        self.items, self.run = items, run
        self.short = sorted({len(w) for _, w in items if 0 < len(w) < run})
        self.by_hash: dict[int, dict[int, list[int]]] = {n: {} for n in (*self.short, run)}
        for k, (_, words) in enumerate(items):
            n = min(len(words), run)
            if n:
                for h in set(rolled(plain_hashes(words), n).tolist()):
                    self.by_hash[n].setdefault(h, []).append(k)
        self.keys = {n: np.sort(np.fromiter(found, U64, len(found))) for n, found in self.by_hash.items()}
        self.mask = {}
        for n, keys in self.keys.items():
            self.mask[n] = np.zeros(1 << FILTER_BITS, bool)
            self.mask[n][(keys >> U64(64 - FILTER_BITS)).astype(np.int64)] = True

    def candidates(self, words: np.ndarray, n: int) -> np.ndarray:
        """Places whose run of n words is one of an item's."""
        g = rolled(words, n)
        at = np.flatnonzero(self.mask[n][(g >> U64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at):
            return at
        keys = self.keys[n]
        place = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
        return at[keys[place] == g[at]]


def plain_hashes(words: list[str]) -> np.ndarray:
    """The hashes that a document with these words has."""
    texts = pa.array([" ".join(words)])
    return np.concatenate([hash_words(raw, at)[0] for _, _, raw, at in chunks(texts)])


def pairs_of(text: str, seeds: Seeds, cover: float) -> Iterator[tuple[int | None, int, int, int, float]]:
    words = words_of(text)
    hashes = plain_hashes(words)
    items: dict[int, None] = {}
    for n in (*seeds.short, seeds.run):
        at = seeds.candidates(hashes, n)
        for h in np.unique(rolled(hashes, n)[at]).tolist() if len(at) else ():
            items.update(dict.fromkeys(seeds.by_hash[n][h]))
    for k in sorted(items):
        ident, own = seeds.items[k]
        tiles = tile(own, words, seeds.run)
        matched = sum(t[2] for t in tiles)
        if tiles and matched >= cover * len(own):
            yield ident, len(tiles), matched, len(own), matched / len(own)


def _tiled(batches: Iterator[pa.RecordBatch], seeds: Seeds, cover: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        plain = pa.array([" ".join(words_of(t)) for t in texts.to_pylist()], pa.string())
        rows = []
        for low, high, raw, offsets in chunks(plain):
            words, at = hash_words(raw, offsets)
            hit = [seeds.candidates(words, n) for n in (*seeds.short, seeds.run)]
            places = np.unique(np.concatenate(hit))
            for r in np.unique(np.searchsorted(at, places, "right") - 1).tolist() if len(places) else ():
                rows += [(ids[low + r].as_py(), *x) for x in pairs_of(plain[low + r].as_py(), seeds, cover)]
        if rows:
            kinds = [ids.type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in PAIRS.split(", ")])


def blocks(benchmark: DataFrame, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[int | None, list[str]]]]:
    """Items in blocks of bounded size, one block at a time in the driver."""
    block, n = [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words = words_of(row[1])
        if block and n + len(words) > limit:
            yield block
            block, n = [], 0
        block.append((row[0], words))
        n += len(words)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, run: int = RUN) -> DataFrame:
    """Pairs (doc_id, item_id) with tiles, matched words and coverage."""
    return _pairs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, cover, run, PAIRS)


def _pairs(slim: DataFrame, benchmark: DataFrame, cover: float, run: int, schema: str) -> DataFrame:
    out = slim.sparkSession.createDataFrame([], schema)
    for block in blocks(benchmark):
        seeds = slim.sparkSession.sparkContext.broadcast(Seeds(block, run))  # at most BLOCK_WORDS words
        out = out.union(slim.mapInArrow(tidy(lambda it, s=seeds: _tiled(it, s.value, cover)), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, cover: float = COVER) -> DataFrame:
    """The documents that hold no item; rows are told apart by their texts, so equal or missing ids take no clean row along."""
    key = F.md5("text")
    bad = _pairs(docs.select(key.alias("doc_id"), "text"), benchmark, cover, RUN, PAIRS.replace("doc_id long", "doc_id string")).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, key == bad["_bad"], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
