"""Main text of pages by the maximum-scoring subsequence of words and tags.

A page becomes a row of tokens: words score above zero, tags and words of links below, by
log-odds from labelled pages (`_labelled_pages`). One scan finds the contiguous region with the
highest sum; the blocks in it are the text. What names itself as something else - menus, headers,
footers, sidebars, notices, adverts, forms, comments, scripts, styles - is left out before the
scan, wherever it stands: by its element, or by names whose parts, weighed by log-odds from the
labelled pages, speak for it. `article` and `main` elements bound the regions where a page has any, one region for each.
A page is read in one pass, so a text of any length takes time in proportion.

Defined cases: an empty table gives an empty result; null or empty html, or none but boilerplate, gives the empty string and 0; unclosed
and stray tags are followed as far as they go; of regions with equal sums the first wins; repeated
rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _labelled_pages
from ._work import read

TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>")
PLAIN_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*)>")
ANCHOR = re.compile(r"<(/?)a[\s>/]", re.I)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|aria-hidden|href|name)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# Names of elements.
LEFT_OUT = set("nav footer aside form button menu dialog input label fieldset audio video".split())
RAW = set("script style template noscript iframe svg textarea select object canvas title".split())
TO_THE_END = set("script style textarea title".split())  # where these are not closed, they go on to the end of the page
HEAD = set("html head meta title style script link base noscript template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr math mrow mi mn mo ms mspace mtext mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics".split())
CONTAINERS = set("html body div section article main header footer nav aside form ul ol dl table tbody thead tfoot tr td th figure figcaption blockquote menu dialog details button label fieldset audio video center p li".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote figcaption dd".split())
MAIN = set("article main".split())
CLAMP = 0.05
TEXTS = ("word", "link")
UNKNOWN = -4.0


@dataclass
class Element:
    name: str
    begin: int  # tokens
    names: list[list[str]]  # parts of each class, id, role and label
    hidden: bool
    inside: bool  # an article or main element
    end: int = 0


def attributes(text: str) -> tuple[list[list[str]], bool, bool]:
    """Names in class, id, role and label, by parts; whether the element is hidden; whether it is only an anchor's name."""
    names, hidden, link, named = [], False, False, False
    for m in ATTRIBUTE.finditer(text):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key in ("hidden", "aria-hidden"):
            hidden |= value.lower() != "false"
        elif key == "href":
            link = True
        else:
            named |= key in ("name", "id")
            names += [[x.lower() for x in PART.findall(w)] for w in (value.split() if key in ("class", "id") else [value]) if key != "name"]
    return names, hidden, named and not link


def pieces(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(kind, name, value, end): texts, start and end tags and comments, in one pass; raw elements are left out whole."""
    at, strict, unclosed = 0, True, set()
    while at < len(page):
        low = page.find("<", at)
        while low >= 0 and not (low + 1 < len(page) and (page[low + 1] in "!?" or page[low + 1].isalpha() or page[low + 1] == "/" and page[low + 2 : low + 3].isalpha())):
            low = page.find("<", low + 1)
        if low < 0:
            yield "text", "", page[at:], len(page)
            return
        if low > at:
            yield "text", "", page[at:low], low
        if page[low + 1] in "!?":
            comment = page.startswith("<!--", low)
            high = page.find("-->" if comment else ">", low + (4 if comment else 2))
            if comment and high >= 0:
                yield "comment", "", page[low + 4 : high], high
            at = len(page) if high < 0 else high + (3 if comment else 1)
            continue
        m = (TAG if strict else PLAIN_TAG).match(page, low)
        if not m and strict:
            strict, m = False, PLAIN_TAG.match(page, low)
        if not m:  # a tag that isn't closed up to the end of the page
            return
        name, at = m[1].lower(), m.end()
        if page[low + 1] == "/":
            yield "end", name, "", at
            continue
        if name in RAW and name not in unclosed and not m[2].endswith("/"):
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
                yield "raw", name, "", at
                continue
            unclosed.add(name)
            if name in TO_THE_END:
                return
        yield "start", name, m[2], at


def parse(page: str) -> tuple[list[tuple[str, str]], list[Element]]:
    """Tokens (kind, value) - tag names, `word` and `link` runs (a link in running text is words), `mark`s - and the page's elements."""
    row: list[tuple[str, str]] = []
    elements, stack, opened = [], [], Counter()
    anchors = [(m.start(), bool(m[1])) for m in ANCHOR.finditer(page)]
    link, head, inside, seen, block = False, False, 0, 0, ""

    def close(k: int) -> None:
        nonlocal inside
        while len(stack) > k:
            e = stack.pop()
            e.end = len(row)
            opened[e.name] -= 1
            inside -= e.name in MAIN

    for kind, name, value, end in pieces(page):
        if kind == "start" and name == "head":
            head = True
        elif kind == "start" and name not in HEAD or kind == "end" and name == "head":
            head = False
        if kind == "comment" and value in ("main", "/main"):
            row.append(("mark", value))
        elif kind == "text" and not head:
            row.append(("link" if link and block not in PROSE else "word", value))
        if kind not in ("start", "end"):
            continue
        if name not in INLINE:
            block = name if kind == "start" else ""
            while seen < len(anchors) and anchors[seen][0] < end:
                seen += 1
            if link and not (seen < len(anchors) and anchors[seen][1]):
                link = False  # a link that is not closed ends with its block
            if stack and stack[-1].name == "p" and (kind == "start" or name != "p"):
                close(len(stack) - 1)
        if kind == "start":
            names, hidden, named = attributes(value)
            if name == "a":
                link = not named
            if name == "li" and stack and stack[-1].name == "li":
                close(len(stack) - 1)
            row.append((name, ""))
            if name in CONTAINERS or names and name not in VOID and name not in INLINE or name in LEFT_OUT:
                e = Element(name, len(row) - 1, names, hidden, bool(inside), len(row))
                elements.append(e)
                if name not in VOID:
                    stack.append(e)
                    opened[name] += 1
                    inside += name in MAIN
            elif hidden and name not in VOID:
                elements.append(e := Element(name, len(row) - 1, names, True, bool(inside)))
                stack.append(e)
                opened[name] += 1
        else:
            if name == "a":
                link = False
            if opened[name]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name))
            row.append((f"/{name}", ""))
    close(0)
    return row, elements


def odds(yes: Counter, no: Counter) -> dict[str, float]:
    kinds = {*yes, *no}
    return {k: math.log((yes[k] + 0.5) / (sum(yes.values()) + 0.5 * len(kinds)) * (sum(no.values()) + 0.5 * len(kinds)) / (no[k] + 0.5)) for k in kinds}


@lru_cache(maxsize=1)
def purposes() -> dict[str, float]:
    """Log-odds of the parts of names outside the main text against inside, from the labelled pages."""
    inside, rest = Counter(), Counter()
    for page in _labelled_pages.pages():
        row, elements = parse(page)
        marks = [i for i, (k, _) in enumerate(row) if k == "mark"]
        for e in elements:
            (inside if e.begin <= marks[0] < e.end or marks[0] < e.begin < marks[1] else rest).update(p for n in e.names for p in n)
    return odds(rest, inside)


def left_out(row: list[tuple[str, str]], elements: list[Element]) -> list[bool]:
    """Which elements are something else than main text.

    A name counts where all its parts together speak for it; parts that no labelled page has speak against.
    An element that holds all of a page's articles, or a form with most of its words, is not left out.
    """
    table = purposes()
    named = lambda e: any(n and sum(table.get(p, UNKNOWN) for p in n) > 0 for n in e.names)
    out = []
    for e in elements:
        x = e.name in LEFT_OUT or e.hidden or e.name == "header" and not e.inside
        out.append(x or e.name not in ("html", "body", *MAIN) and not (e.inside and ["header"] in e.names) and not (e.name in ("h1", "h2", "h3") and ["header"] in e.names) and named(e))
    mains = [e for e in elements if e.name in MAIN and not named(e)]
    if mains:
        first, last = min(e.begin for e in mains), max(e.begin for e in mains)
        out = [x and not (e.begin < first and last < e.end) for x, e in zip(out, elements, strict=True)]
    words = [0]
    for kind, value in row:
        words.append(words[-1] + (len(value.split()) if kind == "word" else 0))
    return [x and not (e.name == "form" and not e.hidden and 2 * (words[e.end] - words[e.begin]) > words[-1] and not named(e)) for x, e in zip(out, elements, strict=True)]


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """(kind, value): the tokens of a page, `out` in place of elements that are left out."""
    row, elements = parse(page)
    until = 0
    ends = {}
    for e, x in zip(elements, left_out(row, elements), strict=True):
        if x:
            ends[e.begin] = max(e.end, ends.get(e.begin, 0))
    for i, token in enumerate(row):
        if i < until:
            continue
        if i in ends:
            until = max(until, ends[i])
            yield "out", ""
            continue
        yield token


@lru_cache(maxsize=1)
def weights() -> dict[str, float]:
    """Log-odds of each kind of token in the main text against the rest, from the labelled pages."""
    inside, rest = Counter(), Counter()
    for page in _labelled_pages.pages():
        main = False
        for kind, value in tokens(page):
            if kind == "mark":
                main = value == "main"
            else:
                (inside if main else rest)[kind] += max(1, len(value.split())) if kind in TEXTS else 1
    return {k: max(CLAMP, v) if k == "word" else min(-CLAMP, v) for k, v in odds(inside, rest).items()}


def region(scores: list[float]) -> tuple[int, int]:
    """Bounds of the first contiguous run with the highest sum above zero; (0, 0) if there is none."""
    best, low, high, total, begin = 0.0, 0, 0, 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best + 1e-9:
            best, low, high = total, begin, i + 1
    return low, high


def extract(page: str | None) -> str:
    """Blocks of the main text in page order, joined by two line ends."""
    if not page:
        return ""
    row = [(k, v) for k, v in tokens(page) if k != "mark"]
    table = weights()
    other = -0.5
    bounds = {"article", "/article", "main", "/main"}
    scores = []
    for kind, value in row:
        if kind in bounds:
            scores.append(-1e9)
        elif kind in TEXTS:
            scores.append(table.get(kind, CLAMP) * len(entities.unescape(value).split()))
        else:
            scores.append(table.get(kind, -CLAMP if kind.lstrip("/") in INLINE else other))
    regions = [region(scores)]
    named = [i for i, (k, _) in enumerate(row) if k in MAIN]
    if named:  # the best region of each article that has one
        spans, depth, begin = [], 0, 0
        for i, (k, _) in enumerate(row):
            if k in MAIN:
                begin = begin if depth else i + 1
                depth += 1
            elif k.startswith("/") and k[1:] in MAIN and depth:
                depth -= 1
                if not depth:
                    spans.append((begin, i))
        if depth:
            spans.append((begin, len(row)))
        flat = [x if k in TEXTS else -CLAMP for (k, _), x in zip(row, scores, strict=True)]  # inside an article a tag tells little
        best = []
        for a, b in spans:
            x, y = region(flat[a:b])
            if y > x:
                best.append((a + x, a + y))
        regions = best or regions
    # whole blocks: no block is cut
    breaks = lambda k: k not in TEXTS and k.lstrip("/") not in INLINE
    blocks, block = [], []
    for low, high in regions:
        while high > low and low and not breaks(row[low - 1][0]):
            low -= 1
        while high > low and high < len(row) and not breaks(row[high][0]):
            high += 1
        for kind, value in [*row[low:high], ("/div", "")]:
            if kind in TEXTS:
                block.append(value)
            elif kind in ("br", "/br"):
                block.append(" ")
            elif breaks(kind):
                if text := " ".join(entities.unescape("".join(block)).split()):
                    blocks.append(text)
                block = []
    return "\n\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, html) to (page_id, url, text, n_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
