"""Class-based n-gram scoring after Brown: class transitions times word emissions.

P(word | history) = P(class | h) * P(word | class), h being the class of the token directly before.

1. All training words are counted. Words with at least 1 / `HEAD` of all tokens that are seen more
   than once are the head: at most `HEAD` words at any size. The core are the most frequent of them: `CORE`, or four times the
   root of the head's size where that is more.
2. Exchange clustering moves each core word to the class that most raises the likelihood of the
   core's bigrams (a table of counts over all training documents), until nothing moves.
3. Every other word is put by one more exchange step into the class that fits the contexts in which
   it stands: for the head from a table of contexts, for all rarer words from their rows, shuffled by
   word. Rare words have `CLASSES` classes of their own, reached through one rare event.
4. Transitions are counted between the classes of all neighbouring training tokens, core, head and
   rare; a rare word's class meets its neighbours by the text's key. Unknown words are one more
   history, with nothing counted. Where `core` is given, only so many words are histories, and other
   words leave the history as it is.
5. Transitions are smoothed by the class frequencies. A rare class gives `DISCOUNT` of each of its
   words to unknown words, so that probabilities over all known words and one unknown word add to 1.

Counts cover all training documents. What is sent to the driver is bounded by CLASSES and HEAD;
rare words only meet in shuffles, by word (below 1 / HEAD of all tokens each) and by document.

Defined cases: null and empty texts are the end token alone; without training documents the score is
the base score; equal rows score alike; rows without doc_id are held out of training (their fold is
null); words tied in count are ordered by their hash; texts of any length are read whole; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import Workspace, read, tidy
from ._words import GRAM, U64, chunks, hash_words, mix

HEAD = 1_000_000
CORE = 1024
CLASSES = 40
DISCOUNT = 0.75
UNSEEN = 0.5
END = U64(0x5851F42D4C957F2D)
BLOCK = 1 << 15
FLUSH = 1_000_000


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(True))


class Table:
    """Word hashes to places 0..n-1, -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys.astype(U64)
        self.bits = max(16, int(len(keys) * 16).bit_length())
        slot = (self.keys >> U64(64 - self.bits)).astype(np.int64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        self.at[slot[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
        lost = np.flatnonzero(self.at[slot] != np.arange(len(keys)))
        order = np.argsort(self.keys[lost])
        self.lost, self.lost_keys = lost[order], self.keys[lost][order]
        self.padded = np.concatenate((self.keys, [U64(0)]))

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out = self.at[(hashes >> U64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        wrong = self.padded[out] != hashes
        wrong |= out < 0
        if len(self.lost):
            miss = np.flatnonzero(wrong & (out >= 0))
            place = np.minimum(np.searchsorted(self.lost_keys, hashes[miss]), len(self.lost) - 1)
            hit = self.lost_keys[place] == hashes[miss]
            out[miss[hit]] = self.lost[place[hit]]
            wrong[miss[hit]] = False
        out[wrong] = -1
        return out


def token_rows(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """By chunks: low, high, hashes with an end token after each text, n+1 offsets."""
    for low, high, raw, offsets in chunks(column):
        words, at = hash_words(raw, offsets)
        ends = at[1:] + np.arange(high - low)
        out = np.empty(len(words) + high - low, U64)
        solid = np.ones(len(out), bool)
        solid[ends] = False
        out[solid], out[ends] = words, END
        yield low, high, out, np.concatenate(([0], ends + 1))


def contexts(core: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of the last token with core >= 0 before each token of the same text, else -1."""
    place = np.where(core >= 0, np.arange(len(core)), -1)
    last = np.concatenate(([-1], np.maximum.accumulate(place)[:-1])) if len(core) else place
    begin = np.repeat(at[:-1], np.diff(at))
    return np.where(last >= begin, last, -1)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(where, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    parts, n = [], 0
    for batch in batches:
        for _, _, hashes, _ in token_rows(batch.column(0)):
            parts.append(np.unique(hashes, return_counts=True))
            n += len(parts[-1][0])
            if n > FLUSH:
                parts = [merged(parts)]
                n = len(parts[0][0])
                if n > FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(parts[0][0].view(np.int64)), pa.array(parts[0][1])], ["h", "n"])
                    parts, n = [], 0
    if parts:
        keys, sums = merged(parts)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums)], ["h", "n"])


def matrix(docs: DataFrame, cells: int, add: Callable[[np.ndarray, pa.Array], None]) -> np.ndarray:
    """Sums over all tasks of an array of fixed size, in blocks, to the driver."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int32)
        for batch in batches:
            add(total, batch.column(0))
        for b in range(0, cells, BLOCK):
            part = total[b : b + BLOCK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["b", "data"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(data.as_py()), np.int32).astype(np.int64)
                total[b] = total[b] + part if b in total else part
        for b, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["b", "data"])

    out = np.zeros(cells, np.int64)
    for r in docs.mapInArrow(tidy(own), "b int, data binary").repartition("b").mapInArrow(tidy(summed), "b int, data binary").collect():
        part = np.frombuffer(zlib.decompress(r["data"]), np.int64)
        out[r["b"] * BLOCK : r["b"] * BLOCK + len(part)] += part
    return out


def exchange(counts: np.ndarray, classes: int) -> np.ndarray:
    """Classes of words by exchange. counts: (n + 1, n + 1); the last row is the start, the last column the end."""
    n = len(counts) - 1
    of = np.arange(n) % classes
    g = lambda x: x * np.log(np.maximum(x, 1.0))
    counts = counts.astype(float)
    one = np.zeros((n + 1, classes + 1))
    one[np.arange(n), of] = 1
    one[n, classes] = 1
    table = one.T @ counts @ one
    k = np.arange(classes)
    least = 1e-6 + 1e-12 * float(g(counts.sum()))  # above what rounding makes of a gain, so that the turns end
    moved = 1
    while moved:
        moved = 0
        for w in range(n):
            out, into, self_ = counts[w] @ one, counts[:, w] @ one, counts[w, w]
            old = of[w]
            out[old] -= self_
            into[old] -= self_
            table[old] -= out
            table[:, old] -= into
            table[old, old] -= self_
            rows, cols = table.sum(1)[:classes] + into[:classes], table.sum(0)[:classes] + out[:classes]  # those of w beside other classes count wherever w goes
            a = table[:classes] + out[None, :]
            b = table[:, :classes].T + into[None, :]
            gain = (g(a) - g(table[:classes])).sum(1) + (g(b) - g(table[:, :classes].T)).sum(1)
            mid = table[k, k]
            gain += g(mid + out[k] + into[k] + self_) - g(mid + out[k]) - g(mid + into[k]) + g(mid)
            gain -= g(rows + out.sum() + self_) - g(rows) + g(cols + into.sum() + self_) - g(cols)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + least:
                new = old
            one[w, old], one[w, new] = 0, 1
            table[new] += out
            table[:, new] += into
            table[new, new] += self_
            of[w] = new
            moved += new != old
    return of


@dataclass
class Model:
    """What scoring needs: fixed in size by HEAD and CLASSES."""

    tokens: int = 0
    distinct: int = 0
    table: Table | None = None  # head words, most frequent first
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # of head words; k: the end token
    core: int = 0
    direct: bool = True  # every token is a history, not only core words
    k: int = CLASSES
    next_class: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # log10, (contexts, classes + end + rare)
    emit: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10, of head words

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))

    def context_of(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Classes of the last core words; k at the start."""
        core = np.where((ids >= 0) & (ids < self.core), ids, -1)
        place = contexts(core, at)
        return np.where(place >= 0, self.classes[core[place]], self.k)

    def columns(self, ids: np.ndarray) -> np.ndarray:
        """Classes of tokens, k for the end, k + 1 for rarer words."""
        return np.where(ids >= 0, self.classes[ids], self.k + 1)

    def history_of(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Classes of the tokens before, k at the start, -1 after a rarer word."""
        if not self.direct:
            return self.context_of(ids, at)
        own = np.where(ids >= 0, self.classes[ids], -1)
        return np.concatenate(([self.k], own))[: len(ids)]  # the end token's class is that of the start


def smoothed(counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    prior = prior / prior.sum()
    return (counts + prior[None, :]) / (counts.sum(1, keepdims=True) + 1.0)


class Scorer:
    """Trains on the documents outside the held-out fold; `rows` has doc_id, held and text."""

    def __init__(self, docs: DataFrame, head: int = HEAD, core: int | None = None, classes: int = CLASSES):
        self.head, self.core, self.k = head, core, classes
        self.spark = docs.sparkSession
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"), "text")
        self.work = Workspace(self.spark, "lm")

    def train(self) -> Model:
        train = self.rows.filter("not held").select("text")
        vocabulary = self.work.save(train.mapInArrow(tidy(counted), "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "vocabulary")
        size = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
        k = self.k
        model = Model(size[0], size[1], k=k)
        if not model.tokens:
            return model
        frequent = vocabulary.filter((F.col("c") * self.head >= model.tokens) & (F.col("c") > 1) | (F.col("h") == int(END))).toPandas()  # at most `head` rows and the end
        keys, n = frequent["h"].to_numpy(np.int64).view(U64), frequent["c"].to_numpy(np.int64)
        order = np.lexsort((keys, -n))
        heads = order[keys[order] != END]
        model.direct = self.core is None
        model.core = core = min(max(CORE, 4 * math.isqrt(len(heads))) if model.direct else self.core, len(heads))
        end = keys == END
        keys, n = np.concatenate((keys[heads], [END])), np.concatenate((n[heads], n[end] if end.any() else [0]))
        model.table, model.counts = Table(keys), n
        small = self.spark.sparkContext.broadcast(Table(np.concatenate((keys[:core], [END]))))
        side = core + 1

        def bigrams(total: np.ndarray, column: pa.Array) -> None:
            for _, _, hashes, at in token_rows(column):
                ids = small.value.find(hashes)
                place = contexts(np.where(ids < core, ids, -1), at)
                row = np.where(place >= 0, ids[place], core)
                own = ids >= 0
                np.add.at(total, row[own] * side + ids[own], 1)

        of = exchange(matrix(train, side * side, bigrams).reshape(side, side), k)
        width = len(keys) + 1  # the last column: all rarer words
        model.classes = np.full(len(keys), k)
        model.classes[:core] = of
        held = self.spark.sparkContext.broadcast(model)

        def heads_in_context(total: np.ndarray, column: pa.Array) -> None:
            m = held.value
            for _, _, hashes, at in token_rows(column):
                ids = m.table.find(hashes)
                np.add.at(total, m.context_of(ids, at) * width + np.where(ids >= 0, ids, width - 1), 1)

        seen = matrix(train, (k + 1) * width, heads_in_context).reshape(k + 1, width)
        by_core = np.zeros((k + 1, k))
        np.add.at(by_core.T, of, seen[:, :core].T.astype(float))
        self.lift = np.log(smoothed(by_core, by_core.sum(0) + UNSEEN) / (by_core.sum(0) + UNSEEN)[None, :])
        rest = slice(core, len(keys) - 1)
        model.classes[rest] = (seen[:, rest].T.astype(float) @ self.lift).argmax(1)
        mass = np.bincount(model.classes, model.counts, k + 1)
        self.prior = np.concatenate((mass, [model.tokens - mass.sum()]))
        self.prior[k:] += UNSEEN
        classed = self.spark.sparkContext.broadcast(model)

        def transitions(total: np.ndarray, column: pa.Array) -> None:
            m = classed.value
            for _, _, hashes, at in token_rows(column):
                ids = m.table.find(hashes)
                history = m.history_of(ids, at)
                own = history >= 0
                np.add.at(total, history[own] * (k + 2) + m.columns(ids)[own], 1)

        table = matrix(train, (k + 1) * (k + 2), transitions).reshape(k + 1, k + 2)
        model.next_class = np.log10(np.maximum(smoothed(table, self.prior), 1e-300))
        with np.errstate(divide="ignore"):
            model.emit = np.log10(model.counts / np.maximum(mass[model.classes], 1))
        return model

    def split(self, model: Model) -> tuple[DataFrame, DataFrame]:
        """Documents with their sums over head words, and rows of rarer words with the classes beside them.

        What follows a rarer word is scored with that word: its class is not yet known here.
        """
        held = self.spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = held.value
            base = m.base(m.counts)
            for batch in batches:
                ids_of = np.array([x if x is not None else -1 for x in batch.column(0).to_pylist()], np.int64)
                out_of = np.array(batch.column(1).to_pylist(), bool)
                for low, high, hashes, at in token_rows(batch.column(2)):
                    ids = m.table.find(hashes)
                    own, context = ids >= 0, m.context_of(ids, at)
                    history, column = m.history_of(ids, at), m.columns(ids)
                    known = np.where(own, ids, 0)
                    score = np.where(history >= 0, m.next_class[history, column], 0.0) + np.where(own, m.emit[known], 0.0)
                    text_key = np.add.reduceat(mix(hashes + np.arange(len(hashes), dtype=U64) - np.repeat(at[:-1], np.diff(at)).astype(U64)), at[:-1])
                    key = mix(ids_of[low:high].view(U64) * GRAM[2] + text_key).view(np.int64)
                    rare = np.flatnonzero(~own)
                    doc = np.repeat(np.arange(high - low), np.diff(at))[rare]
                    n = high - low
                    sums = [np.add.reduceat(x, at[:-1]) for x in (own.astype(np.int64), np.where(own, base[known], 0.0), score)]
                    none = lambda kind, k: pa.nulls(k, kind)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(key), pa.array(ids_of[low:high], mask=np.array([x is None for x in batch.column(0).slice(low, n).to_pylist()], bool)), pa.array(out_of[low:high]), pa.array(np.diff(at)), *map(pa.array, sums), none(pa.int64(), n), none(pa.int32(), n), none(pa.int64(), n), none(pa.int32(), n), none(pa.int32(), n),
                    ], NAMES)
                    if len(rare):
                        r = len(rare)
                        follows = pa.array(column[rare + 1], pa.int32()) if m.direct else none(pa.int32(), r)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(key[doc]), none(pa.int64(), r), pa.array(out_of[low:high][doc]), none(pa.int64(), r), none(pa.int64(), r), none(pa.float64(), r), none(pa.float64(), r), pa.array(hashes[rare].view(np.int64)), pa.array(context[rare], pa.int32()), pa.array(rare - at[doc]), pa.array(history[rare], pa.int32()), follows,
                        ], NAMES)

        rows = self.work.save(self.rows.mapInArrow(tidy(run), SPLIT), "rows")
        return rows.filter("h is null"), rows.filter("h is not null").select("key", "held", "h", "context", "place", "history", "follows")

    def rare_classes(self, rare: DataFrame) -> DataFrame:
        """(h, class, c) of rarer words by one exchange step each."""
        lift, k = self.lift, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, vector = np.zeros(0, U64), np.zeros((0, k + 1))

            def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
                of = (counts @ lift).argmax(1)
                return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(of, pa.int32()), pa.array(counts.sum(1).astype(np.int64))], WORD_NAMES)

            for batch in batches:  # sorted by h; the last word of a batch may go on
                for low in range(0, batch.num_rows, 50_000):
                    h = batch.column(0).slice(low, 50_000).to_numpy().view(U64)
                    context = batch.column(1).slice(low, 50_000).to_numpy()
                    first = np.concatenate(([True], h[1:] != h[:-1]))
                    group = np.cumsum(first) - 1
                    keys = h[first]
                    counts = np.bincount(group * (k + 1) + context, minlength=len(keys) * (k + 1)).reshape(-1, k + 1).astype(float)
                    if len(last):
                        if last[0] == keys[0]:
                            counts[0] += vector[0]
                        else:
                            yield out(last, vector)
                    if len(keys) > 1:
                        yield out(keys[:-1], counts[:-1])
                    last, vector = keys[-1:], counts[-1:]
            if len(last):
                yield out(last, vector)

        by_word = rare.filter("not held").select("h", "context").repartition("h").sortWithinPartitions("h")
        return self.work.save(by_word.mapInArrow(tidy(run), "h long, class int, c long"), "words")

    def beside(self, rare: DataFrame, words: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray]:
        """Rows of rarer words with both classes; counts of rare classes by history and of what follows them; types.

        Histories: head classes, k the start, k + 1 .. 2k rare classes, 2k + 1 unknown words.
        """
        k = self.k
        own = F.coalesce(F.col("class"), F.lit(k)) + k + 1
        rows = rare.join(words, "h", "left").withColumn("own", own)
        if self.core is None:
            before = Window.partitionBy("key").orderBy("place").rangeBetween(-1, -1)  # equal rows share their key
            rows = rows.withColumn("history", F.when(F.col("history") >= 0, F.col("history")).otherwise(F.max("own").over(before)))
        rows = self.work.save(rows.select("key", "held", "class", "c", "own", "history", "follows"), "beside")
        train = rows.filter("not held")
        into, out, types = np.zeros((2 * k + 2, k)), np.zeros((2 * k + 2, k + 2)), np.zeros(k)
        for r in train.groupBy("history", "class").count().collect():  # a fixed number of cells, as below
            into[r["history"], r["class"]] = r["count"]
        for r in train.filter("follows is not null").groupBy("own", "follows").count().collect():
            out[r["own"], r["follows"]] = r["count"]
        for r in words.groupBy("class").count().collect():
            types[r["class"]] = r["count"]
        return rows, into, out, types

    def score(self) -> DataFrame:
        model = self.train()
        if not model.tokens:
            return untrained(self.rows)
        k = self.k
        docs, rare = self.split(model)
        rows, table, out, types = self.beside(rare, self.rare_classes(rare))
        mass = table.sum(0)
        after = np.log10(np.maximum(smoothed(out, self.prior), 1e-300))
        chance = smoothed(table, mass + UNSEEN)
        unknown = np.log10((chance * ((DISCOUNT * types + UNSEEN) / (mass + UNSEEN))[None, :]).sum(1))
        known = np.log10(chance) - np.log10(mass + UNSEEN)[None, :]
        literal = lambda x: F.split(F.lit(",".join(f"{v:.12g}" for v in x.ravel())), ",").cast("array<double>")
        at = F.col("history") * k + F.col("class") + 1
        word = F.when(F.col("c").isNull(), F.element_at(literal(unknown), F.col("history") + 1)).otherwise(F.element_at(literal(known), at) + F.log10(F.col("c") - DISCOUNT))
        word += F.coalesce(F.element_at(literal(after), F.col("own") * (k + 2) + F.col("follows") + 1), F.lit(0.0))
        base = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(model.tokens + 0.1 * (model.distinct + 1)))
        sums = rows.groupBy("key").agg(F.sum(word).alias("rare_score"), F.sum(base).alias("rare_base"), F.count("c").alias("rare_known"))
        twins = docs.groupBy("key").agg(F.count("*").alias("twins"))  # equal rows share their key
        sums = sums.join(twins, "key").select("key", (F.col("rare_score") / F.col("twins")).alias("rare_score"), (F.col("rare_base") / F.col("twins")).alias("rare_base"), (F.col("rare_known") / F.col("twins")).cast("long").alias("rare_known"))
        out = docs.select("key", "doc_id", "held", "n_tokens", "n_head", "head_base", "head_score").join(sums, "key", "left")
        zero = F.lit(0)
        return out.select(
            "doc_id", F.col("held").alias("held_out"), "n_tokens", (F.col("n_head") + F.coalesce("rare_known", zero)).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("head_base") + F.coalesce("rare_base", zero)).alias("base_score"), (F.col("head_score") + F.coalesce("rare_score", zero)).alias("score"),
        )


SPLIT = "key long, doc_id long, held boolean, n_tokens long, n_head long, head_base double, head_score double, h long, context int, place long, history int, follows int"
NAMES = [x.split()[0] for x in SPLIT.split(", ")]
WORD_NAMES = ["h", "class", "c"]


def untrained(rows: DataFrame) -> DataFrame:
    """No training token: one unknown word has all the probability."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, _, at in token_rows(batch.column(2)):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(low, high - low) for i in (0, 1)), pa.array(np.diff(at))], ["doc_id", "held_out", "n_tokens"])

    zero = F.lit(0)
    out = rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, n_tokens long")
    return out.select("doc_id", "held_out", "n_tokens", zero.cast("long").alias("n_known"), zero.cast("long").alias("train_tokens"), zero.cast("double").alias("base_score"), zero.cast("double").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scorer(read(spark, sf_dir, "documents")).score()
