"""Toxic passages: maximal segments of token log-odds, and scores from how extreme they are.

Learning. A word's log-odds compare its documents under either label with a Dirichlet prior of `PRIOR` times the pooled
counts; a word scores what is left of them after `SURE` standard errors, if anything. A word that has not been learned
goes by its longest learned beginning of 4 to 6 bytes, whose log-odds count different words instead of documents, so
that one frequent word says nothing about others that begin alike. Near copies (equal least hash of five
words) of one label count once.

Scanning. Every token costs `DRIFT`; the algorithm of all maximal scoring subsequences (Ruzzo and Tompa) runs once over a
text's scoring tokens, with what the gaps between them cost, and finds every toxic passage in linear time.

Calibration. Under clean text the scores of such passages have an extreme-value distribution: in n tokens
K * n * exp(-lambda * s) passages reach score s by chance; this holds in the tail, so passages below `TAIL` do not
count. lambda solves sum(p * exp(lambda * s)) = 1 over the tokens of clean texts, and K follows from the passages found
in them. A passage is significant where the number expected is less than `EXPECTED`. A document's passages are taken
together by the sum statistic of the best r of them, and a logistic curve over its -log10 gives the score. The curve is fitted on a quarter of the learning rows with words
learned from the others; the words then used are learned from all of them.

Bounds: a label is learned from at most `SAMPLE` rows, those of the least hash of doc_id, weighed by what they stand
for; the model holds at most `WORDS` words and as many beginnings. Everything else covers all documents.

Defined cases: null and empty texts have no passage and the lowest score; a null doc_id or label is not learned from; a
doc_id labelled twice counts as toxic if once marked so; equal texts score alike, and documents that share a doc_id are
scored one by one; long texts are read whole; without rows of both labels every score is the share of toxic ones; other columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._words import LOWER, U64, chunks, grams, mix, powers, word_spans
from ._work import Workspace, read, tidy

PRIOR = 0.1
SURE = 2.0
DRIFT = 0.25
TAIL = 0.5
EXPECTED = 0.05
SAMPLE = 20_000
WORDS = 20_000
BEGINNINGS = (4, 5, 6)
TOP = 60.0
TABLE = LOWER.copy()
TABLE[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens (runs of letters, digits and bytes past ASCII), hashes (word, then its beginnings), and offsets."""
    low = TABLE[raw]
    starts, ends = word_spans(low, offsets)
    hashed = np.zeros((1 + len(BEGINNINGS), len(starts)), U64)
    if len(starts):
        power, inverse = powers(1 << max(19, int(len(raw)).bit_length()))
        total = np.zeros(len(raw) + 1, U64)
        np.cumsum((low.astype(U64) + U64(1)) * power[: len(raw)], out=total[1:])
        hashed[0] = mix((total[ends] - total[starts]) * inverse[starts])
        for k, size in enumerate(BEGINNINGS, 1):
            stop = np.minimum(starts + size, ends)
            part = mix(((total[stop] - total[starts]) * inverse[starts]) ^ U64(size * 0x9E3779B97F4A7C15 % (1 << 64)))
            hashed[k] = np.where(ends - starts > size, part, U64(0))
    return starts, ends, hashed, np.searchsorted(starts, offsets)


@dataclass(frozen=True)
class Model:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    decay: float = 1.0  # lambda
    density: float = 1.0  # K
    curve: tuple[float, float] = (0.0, 0.0)

    def scores(self, hashed: np.ndarray) -> np.ndarray:
        """Of each token: what it adds to a passage, without the drift."""
        out = np.zeros(hashed.shape[1])
        todo = np.ones(hashed.shape[1], bool)
        for row in (hashed[0], *hashed[:0:-1]):  # the word, then its longest beginning
            if not len(self.keys):
                break
            at = np.minimum(np.searchsorted(self.keys, row), len(self.keys) - 1)
            hit = todo & (self.keys[at] == row)
            out[hit] = self.values[at[hit]]
            todo &= ~hit
        return out

    def strength(self, sums: list[float], n: int) -> float:
        """-log10 of the chance that passages like these stand in n tokens of clean text."""
        best, total = 0.0, 0.0
        for r, s in enumerate(sorted(sums, reverse=True), 1):
            total += self.decay * s - math.log(self.density * n)
            if total > 0:
                rest = (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
                best = max(best, (total - rest - r * math.log(2)) / math.log(10))
        return min(best, TOP)


def maximal(at: np.ndarray, value: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring stretches; `at` are the places of the scoring tokens, the others cost the drift."""
    out: list[tuple[float, float, int, int, int]] = []  # (sum before, sum up to its end, first, last, the last one with a lower sum before)
    gained = 0.0
    for place, v in zip(at.tolist(), value.tolist(), strict=True):
        left = gained - drift * place
        gained += v
        right = gained - drift * (place + 1)
        if right <= left:
            continue
        first, k = place, len(out) - 1
        while k >= 0:
            if out[k][0] >= left:
                k = out[k][4]
            elif out[k][1] >= right:
                break
            else:
                left, _, first, _, before = out[k]
                del out[k:]
                k = before
        out.append((left, right, first, place, k))
    return [(first, last, right - left) for left, right, first, last, _ in out]


def labelled(docs: DataFrame, labels: DataFrame, learned: str, sample: int, work: Workspace) -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, toxic, last, sketch) of the learning rows, and how many rows each of them stands for."""
    rows = labels.filter("doc_id is not null and toxic is not null").filter(learned).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = work.save(rows.withColumn("_h", F.xxhash64("doc_id")), "labels")
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [rows.filter(F.col("toxic") == y).orderBy("_h", "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), "toxic") for y in (0, 1)]
    few = F.broadcast(picked[0].union(picked[1]))  # at most `sample` rows of each label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = []
            for _, _, raw, offsets in chunks(batch.column("text")):
                _, _, hashed, edge = tokens(raw, offsets)
                for low, high in zip(edge[:-1], edge[1:], strict=True):
                    five = grams(hashed[0, low:high], 5) if high - low >= 5 else grams(hashed[0, low:high], max(1, int(high - low)))
                    least.append(int(five.min().view(np.int64)) if len(five) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "sketch"])

    found = docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic", (F.crc32(F.col("doc_id").cast("string")) % 5 == 4).alias("last"))
    found = work.save(found.mapInArrow(tidy(run), "doc_id long, text string, toxic int, last boolean, sketch long"), "rows")
    return found, {y: n / min(n, sample) for y, n in counts.items()}


COUNTS = ("n0", "n1", "m0", "m1")  # clean, toxic; the same without the last part


def counted(rows: DataFrame, work: Workspace) -> DataFrame:
    """(word, its beginnings, documents of either label, with and without the last part)."""
    once = rows.groupBy("sketch", "toxic").agg(F.min(F.struct("doc_id", "text", "last")).alias("r")).select("toxic", "r.text", "r.last")
    names = ["h0", *[f"h{k}" for k in range(1, 1 + len(BEGINNINGS))], *COUNTS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, last = batch.column("toxic").to_numpy(zero_copy_only=False), batch.column("last").to_numpy(zero_copy_only=False)
            for low, high, raw, offsets in chunks(batch.column("text")):
                _, _, hashed, edge = tokens(raw, offsets)
                if not hashed.shape[1]:
                    continue
                text = np.repeat(np.arange(low, high), np.diff(edge))
                order = np.lexsort((text, hashed[0]))
                h, t = hashed[:, order], text[order]
                new = np.concatenate([[True], (h[0, 1:] != h[0, :-1]) | (t[1:] != t[:-1])])
                h, t = h[:, new], t[new]
                cut = np.flatnonzero(np.concatenate([[True], h[0, 1:] != h[0, :-1]]))
                y, z = toxic[t] > 0, last[t].astype(bool)
                sums = [np.add.reduceat(x.astype(np.int64), cut) for x in (~y, y, ~y & ~z, y & ~z)]
                yield pa.RecordBatch.from_arrays([*[pa.array(x[cut].view(np.int64)) for x in h], *[pa.array(x) for x in sums]], names=names)

    parts = once.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in names))
    return work.save(parts.groupBy(*names[:-4]).agg(*[F.sum(c).alias(c) for c in COUNTS]), "counts")


def odds(df: DataFrame, clean: str, toxic: str, totals: tuple[int, int]) -> DataFrame:
    """Adds `sure`: log-odds less SURE standard errors, with the prior; nothing below zero."""
    n0, n1 = totals
    prior = PRIOR * (n0 + n1)
    own = prior * (F.col(clean) + F.col(toxic)) / float(max(n0 + n1, 1))
    y0, y1 = F.col(clean) + own, F.col(toxic) + own
    delta = F.log(y1 / (n1 + prior - y1)) - F.log(y0 / (n0 + prior - y0))
    return df.withColumn("share", y0 / (n0 + prior)).withColumn("sure", F.greatest(delta - SURE * F.sqrt(1 / y0 + 1 / y1), F.lit(0.0)))


def learn_words(counts: DataFrame, clean: str, toxic: str) -> Model:
    """Words and beginnings with their scores, and lambda."""
    seen = counts.filter(F.col(clean) + F.col(toxic) > 0)
    n0, n1, v0, v1 = (int(x or 0) for x in seen.agg(F.sum(clean), F.sum(toxic), F.sum((F.col(clean) > 0).cast("long")), F.sum((F.col(toxic) > 0).cast("long"))).first())
    if not n0 or not n1:
        return Model()
    words = odds(seen, clean, toxic, (n0, n1)).filter("sure > 0").orderBy(F.desc("sure"), "h0").limit(WORDS)
    words = words.select("h0", "sure", "share").collect()
    parts = []
    for k in range(1, 1 + len(BEGINNINGS)):
        kinds = seen.filter(F.col(f"h{k}") != 0).groupBy(F.col(f"h{k}").alias("b")).agg(F.sum((F.col(clean) > 0).cast("long")).alias("c"), F.sum((F.col(toxic) > 0).cast("long")).alias("t"))
        parts.append(odds(kinds, "c", "t", (v0, v1)).filter("sure > 0"))
    begun = parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(F.desc("sure"), "b").limit(WORDS).select("b", "sure", "share").collect()
    score = {r["b"]: r["sure"] for r in begun}
    if score:  # words that begin alike, but were learned to be clean
        like = F.broadcast(seen.sparkSession.createDataFrame([(b,) for b in score], "b long"))
        known = [seen.filter(F.col(clean) > 0).join(like, F.col(f"h{k}") == F.col("b"), "left_semi").select("h0", (F.col(clean) + F.col(toxic)).alias("n")) for k in range(1, 1 + len(BEGINNINGS))]
        alike = known[0].union(known[1]).union(known[2]).distinct().orderBy(F.desc("n"), "h0").limit(WORDS).collect()
        score |= {r["h0"]: 0.0 for r in alike}
    score |= {r["h0"]: r["sure"] for r in words}
    if not score:
        return Model()
    keys = np.array(list(score), np.int64).view(U64)
    order = np.argsort(keys)
    gain, share = np.array([r["sure"] for r in words]), np.array([r["share"] for r in words])
    return Model(keys[order], np.array(list(score.values()))[order], decay(gain - DRIFT, share))


def decay(score: np.ndarray, share: np.ndarray) -> float:
    """The root of sum(share * exp(x * score)) = 1, all other tokens scoring -DRIFT."""
    rest = max(0.0, 1.0 - float(share.sum()))
    total = lambda x: float((share * np.exp(x * score)).sum()) + rest * math.exp(-DRIFT * x)
    if not len(score) or score.max() <= 0:
        return 1.0
    low, high = 1e-3, 1e-3
    while total(high) < 1 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if total(middle) < 1 else (low, middle)
    return max(low, 1e-3)


def found_in(model: Model, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
    """Of each text: its number, how many tokens, passages by token, and where tokens start and end."""
    starts, ends, hashed, edge = tokens(raw, offsets)
    value = model.scores(hashed)
    place = np.flatnonzero(value > 0)
    cut = np.searchsorted(place, edge)
    for k in range(len(edge) - 1):
        a, b = edge[k], edge[k + 1]
        at = place[cut[k] : cut[k + 1]]
        found = [x for x in maximal(at - a, value[at]) if x[2] >= TAIL] if len(at) else []
        yield k, int(b - a), found, starts[a:b], ends[a:b]


def passage_sums(rows: DataFrame, model: Model) -> DataFrame:
    """(toxic, n, k, sums): tokens and passages of the learning rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tox, n, sums = batch.column("toxic").to_pylist(), [], []
            for _, _, raw, offsets in chunks(batch.column("text")):
                for _, count, found, _, _ in found_in(model, raw, offsets):
                    n.append(count)
                    sums.append([s for _, _, s in found])
            yield pa.RecordBatch.from_arrays([pa.array(tox, pa.int32()), pa.array(n, pa.int64()), pa.array(sums, pa.list_(pa.float64()))], names=["toxic", "n", "sums"])

    return rows.select("toxic", "text").mapInArrow(tidy(run), "toxic int, n long, sums array<double>")


def density(rows: DataFrame, model: Model) -> float:
    """K from the passages that stand in clean texts; half a passage more, so that it is never zero."""
    n, k = passage_sums(rows.filter("toxic = 0"), model).agg(F.sum("n"), F.sum(F.size("sums"))).first()
    return ((k or 0) + 0.5) * math.exp(model.decay * TAIL) / max(n or 0, 1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope by Newton's method, held near zero by one unit of weight."""
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = np.array([(weight * (y - p)).sum() - 1e-3 * a, (weight * (y - p) * x).sum() - b])
        w = weight * p * (1 - p)
        h = np.array([[w.sum() + 1e-3, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1.0]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fitted(rows: DataFrame, model: Model, stands_for: dict[int, float]) -> tuple[float, float]:
    """The curve from -log10 chances to the share of toxic rows; rows are gathered by hundredths of x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [round(100 * model.strength(s, n)) if s else 0 for s, n in zip(batch.column("sums").to_pylist(), batch.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, pa.int64())], names=["toxic", "x"])

    bins = passage_sums(rows, model).mapInArrow(run, "toxic int, x long").groupBy("toxic", "x").count().collect()  # at most 2 * 6001
    y = np.array([r["toxic"] for r in bins], float)
    weight = np.array([r["count"] * stands_for.get(r["toxic"], 1.0) for r in bins])
    total, bad = sum(stands_for.values()), weight[y > 0].sum()
    if not total or not 0 < bad < weight.sum():
        share = (bad + 0.5) / (weight.sum() + 1)
        return math.log(share / (1 - share)), 0.0
    a, b = logistic(np.array([r["x"] / 100 for r in bins]), y, weight)
    return a, max(b, 0.0)


def learn(docs: DataFrame, labels: DataFrame, learned: str = "true", sample: int = SAMPLE) -> Model:
    """From documents and (doc_id, toxic), of which the SQL condition `learned` over doc_id says what may be learned from."""
    work = Workspace(docs.sparkSession, "toxicity")
    rows, stands_for = labelled(docs, labels, learned, sample, work)
    counts = counted(rows, work)
    first = learn_words(counts, "m0", "m1")
    model = learn_words(counts, "n0", "n1")
    with_k = lambda m, part: Model(m.keys, m.values, m.decay, density(part, m))
    a, b = fitted(rows.filter("last"), with_k(first, rows.filter("not last")), stands_for)
    if not len(first.keys) or b == 0.0:  # too few rows for a part of their own
        a, b = fitted(rows, with_k(model, rows), stands_for)
    return Model(model.keys, model.values, model.decay, density(rows, model), (a, b))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, n_passages) of all documents; passages are counted if significant."""
    a, b = model.curve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, many = [], []
            for _, _, raw, offsets in chunks(batch.column("text")):
                for _, n, found, _, _ in found_in(model, raw, offsets):
                    sums = [s for _, _, s in found]
                    out.append(1 / (1 + math.exp(-min(30.0, max(-30.0, a + b * (model.strength(sums, n) if sums else 0.0))))))
                    many.append(sum(model.density * n * math.exp(-model.decay * s) < EXPECTED for s in sums))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64()), pa.array(many, pa.int64())], names=["doc_id", "score", "n_passages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, score double, n_passages long")


def passages(docs: DataFrame, model: Model, expected: float = EXPECTED) -> DataFrame:
    """(doc_id, start, end, text, sum, expected): every significant passage, by bytes of the UTF-8 text."""
    names = ["doc_id", "start", "end", "text", "sum", "expected"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, _, raw, offsets in chunks(batch.column("text")):
                rows = []
                for k, n, found, starts, ends in found_in(model, raw, offsets):
                    for first, last, s in found:
                        chance = model.density * n * math.exp(-model.decay * s)
                        if chance < expected:
                            a, b = int(starts[first]), int(ends[last])
                            rows.append((ids[low + k], a - int(offsets[k]), b - int(offsets[k]), bytes(raw[a:b]).decode(), s, chance))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), "doc_id long, start long, end long, text string, sum double, expected double")


HELD = "crc32(cast(doc_id as string)) % 5 = 0"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs, read(spark, sf_dir, "labels"), f"not ({HELD})")
    out = score(docs, model).withColumn("held_out", F.coalesce(F.expr(HELD), F.lit(False)))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_passages")
