"""Runs of repeated words, found through longest previous factors.

A run is a stretch of words with smallest period q, at least max(`SHORTEST`, `TIMES` * q) words long, that no
neighbouring word extends. The words of many documents form one sequence, with a word of its own after each text, so
that no run leaves its text. Then

* prefix doubling gives the suffix array, and the longest common prefixes of neighbours in it,
* the nearest suffixes that begin further left, on either side, give the longest previous factor of every position,
* steps of that length cut the sequence into blocks, each a new word or a copy of earlier words,
* a run with a block boundary in it, or at its end, is found by extending equal words to both sides of the boundary. If
  s is the last boundary inside, fewer than q words plus the block before s stand left of it, as the block before would
  else reach further; so, with three periods, q is less than half of the two blocks, and all pairs of a boundary
  and such a q number no more than the words,
* any other run lies inside a block and is copied from where the block's words stood first, in order of starts.

A text shorter than a chunk shares its arrays; a longer one, of any length, stands alone, whole, in memory of about 200 times its words.
Words are compared by 64-bit hashes, and each found run is compared again word for word by them.

Defined cases: null and empty texts have no words and no run; rows that share a doc_id are texts of their own, as
are equal texts; ties for the greatest exponent go to the smallest start, then period; other columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._words import U64, chunks, mix, powers, word_spans
from ._work import read, tidy

SHORTEST = 24
TIMES = 3


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words as they stand, letters of either case apart."""
    if not len(starts):
        return np.zeros(0, U64)
    power, inverse = powers(1 << max(19, int(len(raw)).bit_length()))
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def suffix_array(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse of ranks from 0 on, by doubling; only suffixes that are not yet apart are sorted."""
    n = len(ranks)
    order = np.argsort(ranks, kind="stable")
    r = ranks[order]
    new = np.concatenate([[True], r[1:] != r[:-1]])
    place = np.empty(n, np.int64)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    place[order] = first
    ahead = 1
    alone = new & np.concatenate([new[1:], [True]])
    open_at = np.flatnonzero(~alone)
    while len(open_at):
        suffix = order[open_at]
        further = suffix + ahead
        key = np.where(further < n, place[np.minimum(further, n - 1)] + 1, 0)
        group = place[suffix]
        by = np.lexsort((key, group))
        suffix, key, group = suffix[by], key[by], group[by]
        order[open_at] = suffix
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        first = open_at[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        place[suffix] = first
        alone = new & np.concatenate([new[1:], [True]])
        open_at = open_at[~alone]
        ahead *= 2
    return order, place


class Text:
    """Words as integers, and the length of what is equal from, or up to, two positions on."""

    def __init__(self, words: np.ndarray):
        self.words, self.n = words, len(words)
        size = 1 << max(19, int(self.n + 1).bit_length())
        self.power, _ = powers(size)
        self.total = np.zeros(self.n + 1, U64)
        np.cumsum(mix(words.astype(U64) + U64(1)) * self.power[: self.n], out=self.total[1:])

    def same(self, left: np.ndarray, right: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Whether `length` words from left (the smaller) and from right on are equal."""
        a, b = self.total[left + length] - self.total[left], self.total[right + length] - self.total[right]
        return a * self.power[right - left] == b

    def extension(self, left: np.ndarray, right: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words are equal after (before, if `back`) positions left < right: galloping, then halving."""
        found = np.zeros(len(left), np.int64)
        room = left.astype(np.int64) if back else self.n - right
        live, step = np.arange(len(left)), 1
        while len(live):  # steps double as long as all of a step is equal
            live = live[found[live] + step <= room[live]]
            live = live[self._step(left[live], right[live], found[live], step, back)]
            found[live] += step
            step *= 2
        reach = found.copy()  # what is left to find is no longer than this
        while step >= 1:
            able = np.flatnonzero(reach >= step)
            able = able[found[able] + step <= room[able]]
            able = able[self._step(left[able], right[able], found[able], step, back)]
            found[able] += step
            step //= 2
        return found

    def _step(self, left: np.ndarray, right: np.ndarray, done: np.ndarray, step: int, back: bool) -> np.ndarray:
        if back:
            return self.same(left - done - step, right - done - step, step)
        return self.same(left + done, right + done, step)


def nearest_left(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in the suffix array the last place before it with a suffix further left in the text, or -1, and
    the words in common: pointers jump over those that are known to be further right."""
    n = len(order)
    to = np.arange(-1, n - 1)
    least = common.copy()  # words in common with the place before
    open_at = np.arange(1, n)
    open_at = open_at[order[to[open_at]] > order[open_at]]
    while len(open_at):
        over = to[open_at]
        least[open_at] = np.minimum(least[open_at], least[over])
        to[open_at] = to[over]
        open_at = open_at[to[open_at] >= 0]
        open_at = open_at[order[to[open_at]] > order[open_at]]
    least[to < 0] = 0
    return to, least


def previous_factors(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factor of every position, and where it stood."""
    order, place = suffix_array(text.words)
    n = text.n
    common = np.zeros(n, np.int64)
    low, high = np.minimum(order[1:], order[:-1]), np.maximum(order[1:], order[:-1])
    common[1:] = text.extension(low, high)
    before, shared = nearest_left(order, common)
    turned = np.concatenate([[0], common[1:][::-1]])
    after, shared_after = nearest_left(order[::-1], turned)
    after, shared_after = np.where(after[::-1] >= 0, n - 1 - after[::-1], -1), shared_after[::-1]
    right = shared_after > shared
    length = np.where(right, shared_after, shared)
    source = order[np.where(right, after, before)]
    factor, stood = np.empty(n, np.int64), np.empty(n, np.int64)
    factor[order], stood[order] = length, source
    return factor, stood


def blocks(factor: np.ndarray) -> np.ndarray:
    """Where the blocks begin, and the end of the last."""
    step, at, out = np.maximum(factor, 1).tolist(), 0, []
    n = len(step)
    while at < n:
        out.append(at)
        at += step[at]
    return np.array([*out, n], np.int64)


def at_boundaries(text: Text, cut: np.ndarray, shortest: int, times: int) -> list[tuple[int, int, int]]:
    """(start, end, period) of the runs with a boundary inside or at the end."""
    wide = np.diff(cut)
    both = np.concatenate([[0], wide[:-1]]) + wide
    most = np.minimum((both - 1) // 2, text.n)
    where = np.flatnonzero(most > 0)
    most, s = most[where], cut[:-1][where]
    out: set[tuple[int, int, int]] = set()
    stop = np.cumsum(most)
    low = 0
    while low < len(most):  # parts of a bounded number of pairs; one boundary's stay together
        high = max(low + 1, int(np.searchsorted(stop, (stop[low - 1] if low else 0) + (1 << 21), "right")))
        m = most[low:high]
        at = np.repeat(s[low:high], m)
        q = np.arange(1, len(at) + 1) - np.repeat(np.cumsum(m) - m, m)
        low = high
        hits = []
        for back in (False, True):  # a run has half of its words, so at least four pairs of equal ones, on one side
            x, y = at, q
            for i in range(max(1, min(4, shortest // 6))):
                a = x - 1 - i - y if back else x + i
                inside = (a >= 0) & (a + y < text.n)
                a, x, y = a[inside], x[inside], y[inside]
                equal = text.words[a] == text.words[a + y]
                x, y = x[equal], y[equal]
            hits.append(np.stack([x, y]))
        x, y = np.unique(np.concatenate(hits, axis=1), axis=1)
        if not len(x):
            continue
        for shift in (0, 1):  # the pair right of the boundary, and the pair left of it
            inside = (x - shift * y >= 0) & (x + (1 - shift) * y <= text.n)
            a, p = x[inside] - shift * y[inside], y[inside]
            b = a + p
            start, end = a - text.extension(a, b, back=True), b + text.extension(a, b)
            long = end - start >= np.maximum(shortest, times * p)
            out.update(zip(start[long].tolist(), end[long].tolist(), p[long].tolist(), strict=True))
    return primitive(out)


def primitive(found: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """One row per stretch: its smallest period."""
    least: dict[tuple[int, int], int] = {}
    for start, end, period in found:
        least[start, end] = min(period, least.get((start, end), period))
    return sorted((start, end, period) for (start, end), period in least.items())


def runs_of(words: np.ndarray, shortest: int = SHORTEST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of a sequence of integers from 0 on, in order."""
    if len(words) < shortest:
        return []
    if times < 3:
        raise ValueError("the bound on periods asks for three of them")
    words = np.append(words, words.max() + 1)  # so that a boundary stands after the last word
    text = Text(words)
    factor, stood = previous_factors(text)
    cut = blocks(factor)
    runs = at_boundaries(text, cut, shortest, times)
    known = set(runs)
    wide = np.diff(cut)
    for k in np.flatnonzero(wide > shortest).tolist():
        s, width = int(cut[k]), int(wide[k])
        source = int(stood[s])
        shift, stop, i = s - source, source + width, bisect_right(runs, (source, 1 << 62, 0))
        while i < len(runs) and runs[i][0] < stop:
            start, end, period = runs[i]
            if end < stop and (copy := (start + shift, end + shift, period)) not in known:
                known.add(copy)
                insort(runs, copy)
            i += 1
    return [r for r in runs if np.array_equal(words[r[0] : r[1] - r[2]], words[r[0] + r[2] : r[1]])]


def altered(n: int, doc_id: int | None) -> np.ndarray | None:
    """Which original word stands at each place of a text of n words, if that is not its own."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at >= a, a + (at - a) % p, at)


def joined(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the words, a space after each, and where each word begins."""
    size = ends - starts + 1
    at = np.cumsum(size) - size
    take = np.repeat(starts - at, size) + np.arange(int(size.sum()))
    last = at + size - 1
    take[last] = 0
    out = raw[take] if len(raw) else np.zeros(0, np.uint8)
    out[last] = 0x20
    return out, np.append(at, len(out))


def rows_of(ids: list[int | None], raw: np.ndarray, offsets: np.ndarray, alter: bool = True) -> list[list]:
    """The contract's columns, as lists, for the texts of a chunk."""
    starts, ends = word_spans(raw, offsets)
    hashed = word_hashes(raw, starts, ends)
    edge = np.searchsorted(starts, offsets)
    source = np.arange(len(starts))
    for k, doc_id in enumerate(ids):
        other = altered(int(edge[k + 1] - edge[k]), doc_id) if alter else None
        if other is not None:
            source[edge[k] : edge[k + 1]] = edge[k] + other
    _, number = np.unique(hashed, return_inverse=True)
    number = number.reshape(-1)[source]
    texts = len(ids)
    sequence = np.empty(len(number) + texts, np.int64)
    stop = edge[1:] + np.arange(texts)  # the word after each text, met nowhere else
    own = np.ones(len(sequence), bool)
    own[stop] = False
    sequence[own] = number
    sequence[stop] = (int(number.max()) + 1 if len(number) else 0) + np.arange(texts)
    found: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    drop = np.zeros(len(number) + 1, np.int64)
    for start, end, period in runs_of(sequence):
        k = int(np.searchsorted(stop, start))
        found[k].append((start - k - int(edge[k]), end - start, period))
        drop[start - k + period] += 1
        drop[end - k] -= 1
    keep = np.cumsum(drop)[:-1] == 0
    kept = source[keep]
    data, at = joined(raw, starts[kept], ends[kept])
    upto = np.concatenate([[0], np.cumsum(keep)])[edge]
    view, out = memoryview(data), []
    for k, doc_id in enumerate(ids):
        runs = sorted(found[k], key=lambda r: (r[0], r[2]))
        low, high = int(at[upto[k]]), int(at[upto[k + 1]])
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None, None, None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
        milli = 1000 * best[1] // best[2] if runs else None
        out.append([doc_id, len(runs), *best, milli, hashlib.sha256(listed).hexdigest(), hashlib.sha256(view[low : max(low, high - 1)]).hexdigest()])
    return out


RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
RESULT_DDL = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def scan(docs: DataFrame, alter: bool = True) -> DataFrame:
    """Per document its runs' number, the best one, and digests; `alter` repeats the ends of some texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for low, high, raw, offsets in chunks(batch.column("text")):
                rows = rows_of(ids[low:high], raw, offsets, alter)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RESULT, strict=True)], schema=RESULT)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), RESULT_DDL)


def passages(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period, first): every run, and the words of its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("first", pa.string())])
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                starts, ends = word_spans(raw, np.array([0, len(raw)])) if len(raw) else (np.zeros(0, np.int64),) * 2
                _, number = np.unique(word_hashes(raw, starts, ends), return_inverse=True)
                rows = [(doc_id, a, b - a, q, bytes(raw[starts[a] : ends[a + q - 1]]).decode()) for a, b, q in runs_of(number.reshape(-1).astype(np.int64))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, start long, length long, period long, first string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
