"""Words of formulas by the tables of an asset: escapes to characters, marks folded, tokens, subtokens.

The asset (see `ferrule.sources.assets`) holds all tables: symbols, pairs to fold, classes of code points as ranges. A
`Lexer` reads nothing else. It works on whole Arrow batches: all texts' code points stand in one array, classes come
from one look-up table made of the ranges, and tokens are found by where classes change, never text by text.

Null texts have no tokens and stay null where they are normalised.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, StringType

RULE = 1
# Characters with a part of their own in formulas.
SYMBOLIC = "!#$%&*+-/:<=>@\\^|~"
DROPPED = "?"
JOINING = "_'"
SPLITTING = "_."
MARKS = {"sub": "⇩", "super": "⇧", "bold": "❙"}
CONTROLS = {"^sub": "⇩", "^sup": "⇧", "^bold": "❙", "^bsub": "⇘", "^esub": "⇙", "^bsup": "⇗", "^esup": "⇖"}
# Names of symbols that are known without a symbol file.
SYMBOLS = {
    "Longrightarrow": "⟹", "Rightarrow": "⇒", "rightarrow": "→", "longrightarrow": "⟶", "Leftarrow": "⇐", "leftarrow": "←", "longleftrightarrow": "⟷", "Longleftrightarrow": "⟺", "equiv": "≡", "noteq": "≠", "le": "≤", "ge": "≥",
    "lbrakk": "⟦", "rbrakk": "⟧", "And": "⋀", "Or": "⋁", "and": "∧", "or": "∨", "not": "¬", "forall": "∀", "exists": "∃", "in": "∈", "notin": "∉", "subseteq": "⊆", "subset": "⊂", "union": "∪", "inter": "∩", "times": "×", "circ": "∘", "infinity": "∞",
    "Sum": "∑", "Prod": "∏", "integral": "∫", "partial": "∂", "lambda": "λ", "open": "‹", "close": "›", "nat": "ℕ", "real": "ℝ", "int": "ℤ",
}
LETTER, DIGIT, BLANK, JOINER, SYMBOL, RENDERED, SEPARATOR, RENDERED_DIGIT = (1 << i for i in range(8))
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of texts that are worked on at once: arrays take some hundred bytes for each.
PIECE = 1 << 18


def is_digit(ch: str) -> bool:
    return ch.isdigit() or ch.isnumeric()


def ranges(holds: Callable[[str], bool], top: int = sys.maxunicode) -> list[tuple[int, int]]:
    """Code points up to `top` for which `holds`, as inclusive ranges."""
    out: list[tuple[int, int]] = []
    for cp in range(top + 1):
        if holds(chr(cp)):
            out[-1:] = [(out[-1][0], cp)] if out and out[-1][1] == cp - 1 else [*out[-1:], (cp, cp)]
    return out


def folded_pairs() -> tuple[dict[str, str], str]:
    """A mark with a character to one character, by Unicode's decompositions; and all raised and lowered characters."""
    fold, raised = {}, []
    for cp in range(sys.maxunicode + 1):
        kind, _, rest = unicodedata.decomposition(ch := chr(cp)).partition(" ")
        if kind in ("<sub>", "<super>") and " " not in rest:
            raised.append(ch)
            fold.setdefault(MARKS[kind[1:-1]] + chr(int(rest, 16)), ch)
        elif kind == "<font>" and unicodedata.name(ch, "").startswith(("MATHEMATICAL BOLD SMALL", "MATHEMATICAL BOLD CAPITAL", "MATHEMATICAL BOLD DIGIT")):
            fold.setdefault(MARKS["bold"] + chr(int(rest, 16)), ch)
    return fold, "".join(raised)


def known_symbols() -> dict[str, str]:
    """The symbols above, the marks, and Greek letters by their names."""
    out = {rf"\<{k}>": v for k, v in (SYMBOLS | CONTROLS).items()}
    for cp in range(0x391, 0x3CA):
        word = unicodedata.name(chr(cp), "").split(" ")
        if len(word) == 4:  # a Greek letter without an accent
            out.setdefault(rf"\<{word[3].lower() if word[1] == 'SMALL' else word[3].capitalize()}>", chr(cp))
    return out


def asset_of(symbols: Mapping[str, str], letters: list, digits: list, spaces: list) -> dict:
    """The asset from a symbol table and classes of code points; private characters are left as they are written."""
    private = sorted(k for k, v in symbols.items() if unicodedata.category(v[0]) == "Co")
    fold, raised = folded_pairs()
    # Names of the asset's fields.
    return {
        "tokenizer_rule": RULE, "unicode_version": unicodedata.unidata_version, "symbols": {k: v for k, v in symbols.items() if k not in private}, "symbols_private_use": private, "fold": fold,
        "letters": [list(x) for x in letters], "digits": [list(x) for x in digits], "spaces": [list(x) for x in spaces], "quasi_letters": JOINING, "discarded": DROPPED, "ascii_symbolic": SYMBOLIC,
        "separators": SPLITTING + "".join(CONTROLS.values()) + raised, "rendered_subsup": raised, "rendered_digits": "".join(filter(is_digit, raised)),
    }


@lru_cache(maxsize=1)
def default_asset() -> dict:
    return asset_of(known_symbols(), ranges(str.isalpha), ranges(is_digit), ranges(str.isspace))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


@dataclass
class Chars:
    """Code points of several texts, and where each begins."""

    points: np.ndarray
    edge: np.ndarray

    def first(self) -> np.ndarray:
        out = np.zeros(len(self.points) + 1, bool)
        out[self.edge] = True
        return out[:-1]

    def kept(self, keep: np.ndarray) -> Chars:
        return Chars(self.points[keep], np.concatenate([[0], np.cumsum(keep)])[self.edge])

    def strings(self, cut: np.ndarray | None = None) -> pa.Array:
        """The texts, or what stands between the places in `cut`."""
        cut = self.edge if cut is None else cut
        p = self.points
        size = 1 + (p >= 0x80).astype(np.int64) + (p >= 0x800) + (p >= 0x10000)
        at = np.concatenate([[0], np.cumsum(size)])[cut].astype(np.int64)
        data = p.astype("<u4").tobytes().decode("utf-32-le").encode()
        return pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(at), pa.py_buffer(data)).cast(pa.string())


class Lexer:
    def __init__(self, asset: Mapping):
        if asset.get("tokenizer_rule") != RULE:
            raise ValueError(f"the asset follows rule {asset.get('tokenizer_rule')!r}, not {RULE}")
        flags = np.zeros(sys.maxunicode + 2, np.uint8)
        for name, flag in (("letters", LETTER), ("digits", DIGIT), ("spaces", BLANK)):
            for low, high in asset[name]:
                flags[low : high + 1] |= flag
        for name, flag in (("discarded", BLANK), ("quasi_letters", JOINER), ("ascii_symbolic", SYMBOL), ("rendered_subsup", RENDERED), ("separators", SEPARATOR), ("rendered_digits", RENDERED_DIGIT)):
            flags[_points(asset[name])] |= flag
        self.flags = flags
        one = {k: v for k, v in asset["symbols"].items() if len(v) == 1}
        self.names, self.signs = self._table([int(self._hash(_points(k))[-1]) for k in one], [ord(v) for v in one.values()])
        pairs = {k: v for k, v in asset["fold"].items() if len(k) == 2}
        self.pairs, self.merged = self._table([ord(k[0]) << 21 | ord(k[1]) for k in pairs], [ord(v) for v in pairs.values()])
        self.markers = np.array(sorted({ord(k[0]) for k in pairs}), np.int64)

    @staticmethod
    def _table(keys: list[int], values: list[int]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.array(keys, np.uint64)
        order = np.argsort(keys)
        return keys[order], np.array(values, np.int64)[order]

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted), np.int64)
        at = np.minimum(np.searchsorted(keys, wanted.astype(np.uint64)), len(keys) - 1)
        return keys[at] == wanted.astype(np.uint64), values[at]

    @staticmethod
    def _hash(points: np.ndarray) -> np.ndarray:
        """Prefix sums of a polynomial in an odd base."""
        power = np.full(len(points), BASE, np.uint64)
        power[:1] = 1
        return np.cumsum((points.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(power))

    def chars(self, texts: pa.Array) -> Chars:
        """Composed forms; null as empty."""
        rows = [unicodedata.normalize("NFC", t or "") for t in texts.to_pylist()]
        points = _points("".join(rows))
        points[points == 0x7F] = 0x20
        return Chars(points, np.concatenate([[0], np.cumsum([len(t) for t in rows], dtype=np.int64)]))

    def normalized(self, texts: pa.Array) -> Chars:
        return self._folded(self._unescaped(self.chars(texts)))

    def _unescaped(self, c: Chars) -> Chars:
        p, n = c.points, len(c.points)
        begin = np.flatnonzero((p[:-1] == 0x5C) & (p[1:] == 0x3C))
        begin = begin[begin + 3 < n]
        if not len(begin):
            return c
        letter = (p >= 0x41) & (p <= 0x5A) | (p >= 0x61) & (p <= 0x7A)
        inside = letter | (p >= 0x30) & (p <= 0x39) | (p == 0x5F) | (p == 0x27)
        name = begin + 2 + (p[begin + 2] == 0x5E)
        stops = np.append(np.flatnonzero(~inside), n)
        end = stops[np.searchsorted(stops, name)]
        text_end = c.edge[np.searchsorted(c.edge, begin, "right")]
        good = (end < text_end) & letter[np.minimum(name, n - 1)]
        good[good] &= p[end[good]] == 0x3E
        begin, end = begin[good], end[good]
        total = np.concatenate([np.zeros(1, np.uint64), self._hash(p)])
        inverse = np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        inverse[:1] = 1
        inverse = np.multiply.accumulate(inverse)
        known, sign = self._find(self.names, self.signs, (total[end + 1] - total[begin]) * inverse[begin])
        begin, end = begin[known], end[known]
        p = p.copy()
        p[begin] = sign[known]
        gone = np.zeros(n + 1, np.int64)
        gone[begin + 1] += 1
        gone[end + 1] -= 1
        return Chars(p, c.edge).kept(np.cumsum(gone)[:-1] == 0)

    def _folded(self, c: Chars) -> Chars:
        """A mark takes the next character, another mark too; pairs don't overlap."""
        p, n = c.points, len(c.points)
        mark, first = np.isin(p, self.markers), c.first()
        if not mark.any():
            return c
        at = np.arange(n)
        begins = mark & (first | ~np.concatenate([[False], mark[:-1]]))
        since = at - np.maximum.accumulate(np.where(begins, at, 0))
        pair = np.flatnonzero(mark & (since % 2 == 0) & ~np.append(first[1:], True))
        known, value = self._find(self.pairs, self.merged, p[pair] << 21 | p[pair + 1])
        p, keep = p.copy(), np.ones(n, bool)
        p[pair[known]] = value[known]
        keep[pair[known] + 1] = False
        return Chars(p, c.edge).kept(keep)

    def _modes(self, c: Chars) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each character its flags, mode (0 none, 1 name, 2 number, 3 symbols, 4 alone), and whether a token begins."""
        f, first = self.flags[c.points], c.first()
        at = np.arange(len(f))
        blank = (f & BLANK) > 0
        joins = ((f & (LETTER | DIGIT | JOINER)) > 0) & ~blank
        begins = joins & (first | ~np.concatenate([[False], joins[:-1]]))
        stretch = np.maximum.accumulate(np.where(begins, at, -1)) if len(at) else at
        letter = np.maximum.accumulate(np.where((f & LETTER > 0) & joins, at, -1)) if len(at) else at
        name = joins & (letter >= stretch)
        number = ~name & ((f & DIGIT) > 0) & ((f & RENDERED_DIGIT) == 0)
        mode = np.select([blank, name, number, (f & SYMBOL) > 0], [0, 1, 2, 3], 4)
        starts = (mode > 0) & (first | (mode == 4) | (mode != np.concatenate([[0], mode[:-1]])))
        return f, mode, starts

    @staticmethod
    def _lists(c: Chars, inside: np.ndarray, starts: np.ndarray) -> pa.Array:
        places = np.flatnonzero(starts)
        kept = np.concatenate([[0], np.cumsum(inside)])
        values = Chars(c.points[inside], c.edge).strings(np.append(kept[places], kept[-1]))
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(places, c.edge), pa.int32()), values)

    def tokens(self, texts: pa.Array) -> pa.Array:
        c = self.normalized(texts)
        _, mode, starts = self._modes(c)
        return self._lists(c, mode > 0, starts)

    def subtokens(self, texts: pa.Array) -> pa.Array:
        """Tokens cut at separators; a token of raised and lowered characters alone is content and stays."""
        c = self.normalized(texts)
        f, mode, starts = self._modes(c)
        inside = (mode > 0) & ((f & SEPARATOR) == 0)
        token = np.cumsum(starts)
        size = int(token[-1]) + 1 if len(token) else 1
        some = np.bincount(token[inside], minlength=size) > 0
        other = np.bincount(token[(mode > 0) & ((f & RENDERED) == 0)], minlength=size) > 0
        whole = (mode > 0) & ~some[token] & ~other[token]
        cut = inside & (starts | np.concatenate([[True], (f & SEPARATOR)[:-1] > 0])) if len(f) else inside
        return self._lists(c, inside | whole, cut | whole & starts)


@lru_cache(maxsize=1)
def default_lexer() -> Lexer:
    return Lexer(default_asset())


def pieces(texts: pa.Array, most: int = PIECE) -> Iterator[pa.Array]:
    """A batch in slices of about `most` bytes, so that memory follows the longest text and not the batch."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size + 1) - size - 1) // most
    edge = [*np.flatnonzero(np.diff(group, prepend=-1)), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(edge, edge[1:], strict=False))


def by_pieces(run: Callable[[pa.Array], pa.Array], texts: pa.Array, kind: pa.DataType) -> pa.Array:
    out = [run(p) for p in pieces(texts)]
    return pa.concat_arrays(out) if out else pa.array([], kind)


def normalize(text: str) -> str:
    return default_lexer().normalized(pa.array([text])).strings()[0].as_py()


def tokenize(text: str) -> list[str]:
    return default_lexer().tokens(pa.array([text]))[0].as_py()


def subtokens(text: str | None) -> list[str]:
    return default_lexer().subtokens(pa.array([text], pa.string()))[0].as_py()


def subtokens_of(text: Column, lexer: Lexer | None = None) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return by_pieces((lexer or default_lexer()).subtokens, texts, pa.list_(pa.string()))

    return arrow_udf(run, ArrayType(StringType()))(text)


def tokens_of(text: Column, lexer: Lexer | None = None) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return by_pieces((lexer or default_lexer()).tokens, texts, pa.list_(pa.string()))

    return arrow_udf(run, ArrayType(StringType()))(text)


def normalized(text: Column, lexer: Lexer | None = None) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        one = lambda p: pc.if_else(pc.is_valid(p), (lexer or default_lexer()).normalized(p).strings(), pa.scalar(None, pa.string()))
        return by_pieces(one, texts, pa.string())

    return arrow_udf(run, StringType())(text)


def sequence_in(hay: Column, needle: Column, lexer: Lexer | None = None) -> Column:
    """Whether a text has the subtokens of another next to each other, in order."""
    from .text import contains_seq

    return contains_seq(subtokens_of(hay, lexer), subtokens_of(needle, lexer))
