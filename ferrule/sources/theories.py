"""Scan of source files for names: where each first stands as a whole word, and where it is first stated.

Files come from Spark's `binaryFile` source, whole, one row each; a file's names are looked for all at once by one
automaton. Words may be dotted, and a name is only found as a whole one. A name is stated where it follows a keyword. Offsets
count characters from 0; -1 stands for nowhere. Files that aren't there give -1, names without a file are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keywords that state a goal.
GOALS = ("lemma", "theorem", "proposition", "corollary", "schematic_goal")
WORD = re.compile(r"\w")


def files(spark: SparkSession, path: str, pattern: str = "*.thy") -> DataFrame:
    """(path, content) of all files below a folder."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return read.load(path).select("path", "content")


def looked_for(name: Column) -> Column:
    """The last part of a dotted name, without the number of a member."""
    return F.regexp_replace(F.substring_index(name, ".", -1), r"\(\d+\)$", "")


def first_words(text: str, names: Sequence[str]) -> dict[str, int]:
    """Where each name first stands as a whole word: no word character beside it, nor a dot with one behind."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for n in names:
        machine.add_word(n)
    found: dict[str, int] = {}
    if not len(machine):
        return found
    machine.make_automaton()
    word = lambda i: 0 <= i < len(text) and WORD.match(text[i]) is not None
    for last, size in machine.iter(text):
        begin, end = last - size + 1, last + 1
        name = text[begin:end]
        beside = word(begin - 1) or word(end) or text[begin - 1 : begin] == "." and word(begin - 2) or text[end : end + 1] == "." and word(end + 1)
        if name not in found and not beside:
            found[name] = begin
    return found


def first_stated(text: str, goals: re.Pattern) -> dict[str, int]:
    found: dict[str, int] = {}
    for m in goals.finditer(text):
        found.setdefault(m[1], m.start())
    return found


def offsets(sources: DataFrame, names: DataFrame, goals: Sequence[str] = GOALS) -> DataFrame:
    """(path, name, word, goal) for every (path, name), from (path, content); equal pairs stand once."""
    stated = re.compile(rf"(?:{'|'.join(map(re.escape, goals))})\s+(\w+(?:\.\w+)*)\b")
    asked = names.select("path", "name").distinct().withColumn("base", looked_for(F.col("name")))
    lists = asked.groupBy("path").agg(F.collect_list(F.struct("name", "base")).alias("names"))
    both = lists.join(sources.select("path", "content"), "path", "left").select("path", "names", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, wanted, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = content.as_py()
                text = raw.decode(errors="replace") if isinstance(raw, bytes) else raw or ""
                bases = [w["base"] for w in wanted]
                at, goal = first_words(text, [b for b in {*bases} if b and all(map(WORD.match, b))]), first_stated(text, stated)
                columns = [[path] * len(wanted), [w["name"] for w in wanted], [at.get(b, -1) for b in bases], [goal.get(b, -1) for b in bases]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "name", "word", "goal"])

    return both.mapInArrow(run, "path string, name string, word long, goal long")
