"""Search over records by words and vectors, with filters that hold before anything is ranked.

Filters: conditions on fields (one phrase each, asked for or excluded) and kinds become one predicate on columns, and the
documents for which it holds are the mask of both legs.

Words: an index with impacts. A posting's impact is its BM25 part without the word's weight, so it doesn't depend on the
query. Whole texts are shuffled once, by document, and written as postings with a level of impact; a word's postings of one
level are a block, which knows its highest impact. A search

1. adds up the postings of each word's highest levels, and scores the best k by these sums by all their words: the k-th best
   score is what a document must reach,
2. leaves out words that together can't reach it, and blocks whose best document can't,
3. drops documents whose seen parts, with the most that unseen parts could add, can't reach it,
4. scores what is left by all their words, and ranks. Where 2 leaves out little, as it does for long queries, documents are
   scored by all their words at once instead of 3, and those that reach it are ranked.

The result is the exact best k, as every step leaves out only what is below that score. What is asked for goes to all tasks,
so the index is read where it lies: of its postings only those that are asked for are shuffled, by document, and pairs of a
query and a document arise there and stay there until they are known to reach what they must.

Phrases: an index of places, each with the word that follows. Two words side by side are rare where each alone is not, so a
phrase starts from few places, and nothing is shuffled to make the index.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions import text as tx
from ferrule.operators import relational, search

Save = Callable[[DataFrame, str], DataFrame]
LEVELS = 16  # for each unit of impact
SLACK = 1e-6
ASKED = 500_000  # words of queries that go to all tasks
SENT = 1_000_000  # pairs of a query and a document that go to all tasks
PAIRS = 2_000_000  # such pairs that a task may hold
SHARES = 1 << 20
ALL = "all"
MOST = 512


@dataclass(frozen=True)
class Condition:
    """A phrase that a field holds or, if `excludes`, doesn't; the field `all` stands for every one."""

    field: str
    tokens: tuple[str, ...]
    excludes: bool = False


def condition(field: str, text: str, tokenize: Callable[[str], Sequence[str]], excludes: bool = False) -> Condition:
    """From what was typed; what has no token would hold for everything and is an error."""
    tokens = tuple(tokenize(text))
    if len(text) > MOST or not tokens:
        raise ValueError("a condition needs a token and has a limit of length")
    return Condition(field, tokens, excludes)


def theories_of(theorem_alike: Column, constituents: Column, declaring: Column) -> Column:
    """What a theory filter looks at: constituents of what is like a theorem, of others the theory that declares them."""
    return F.when(theorem_alike, F.coalesce(constituents, F.array().cast("array<string>"))).otherwise(F.array(declaring))


def predicate(conditions: Sequence[Condition], fields: Mapping[str, Column], kind: Column | None = None, kinds: Sequence[object] = (), texts: Mapping[str, Column] | None = None) -> Column:
    """Conditions are and-ed, kinds or-ed; no kinds are all of them. An exclusion from all fields negates the whole or.

    `fields` are arrays of tokens, or arrays of such arrays for a field with several values. Where a field's text is
    given, tokens are looked for in it first, which is cheap and passes every match.
    """
    out = kind.isin(*kinds) if kinds and kind is not None else F.lit(True)
    texts = texts or {}

    def holds(field: str, tokens: Sequence[str]) -> Column:
        needle = F.array(*map(F.lit, tokens))
        found = F.coalesce(tx.contains_seq(fields[field], needle), F.lit(False))
        return F.coalesce(tx.may_contain(texts[field], needle), F.lit(False)) & found if field in texts else found

    for c in conditions:
        if not c.tokens:
            raise ValueError("a condition without a token holds for everything")
        found = F.lit(False)
        for field in fields if c.field == ALL else [c.field]:
            found = found | holds(field, c.tokens)
        out = out & (~found if c.excludes else found)
    return out


@dataclass(frozen=True)
class Index:
    """blocks (word, level, doc, tf, size), places (word, next, doc, row, at), and numbers of the whole; `None` is what was not built."""

    blocks: DataFrame | None
    places: DataFrame | None
    docs: int
    mean: float
    save: Save


def build(docs: DataFrame, save: Save, impacts: bool = True, positions: bool = True) -> Index:
    """From (doc, words), whose order is kept as positions; empty words are none."""
    places = blocks = None
    n, mean = 0, 1.0
    if positions:
        after = F.arrays_zip(F.col("words").alias("word"), F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))).alias("next"))
        rows = docs.filter("doc is not null").select("doc", F.monotonically_increasing_id().alias("row"), after.alias("w")).select("doc", "row", F.posexplode("w").alias("at", "w"))
        places = save(rows.select("w.word", "w.next", "doc", "row", "at").filter("word <> ''"), "places")
    if impacts:
        n, mean, repeated = search.totals(docs)
        each = search.dealt(docs, F.col("doc"), repeated, n * mean).select("part", "doc", "size", F.explode_outer("words").alias("word")).filter("word <> ''")
        tf = each.groupBy("part", "doc", "size", "word").agg(F.count("*").cast("int").alias("tf"))
        level = F.floor(search.impact(mean) * LEVELS).cast("int").alias("level")
        blocks = save(tf.select("word", level, "doc", "tf", "size"), "blocks")
    return Index(blocks, places, n, mean, save)


def phrases(index: Index, asked: DataFrame) -> DataFrame:
    """(query, doc) of documents that hold the phrase's words next to each other; asked is (query, words).

    Starts from each phrase's rarest two words side by side; the places that they allow are then counted down by the others.
    """
    asked = asked.filter((F.size("words") > 0) & ~F.exists("words", lambda w: F.coalesce(w == "", F.lit(True))))
    single = asked.filter(F.size("words") == 1).select("query", F.col("words")[0].alias("word"))
    alone = index.places.join(single, "word").select("query", "doc")
    pair = F.arrays_zip(F.slice("words", F.lit(1), F.size("words") - 1).alias("word"), F.slice("words", F.lit(2), F.size("words") - 1).alias("next"))
    each = asked.filter(F.size("words") > 1).select("query", (F.size("words") - 1).alias("n"), F.posexplode(pair).alias("place", "p")).select("query", "n", "place", "p.*")
    places = index.save(index.places.join(each.select("word", "next").distinct(), ["word", "next"], "left_semi"), "places-asked")
    each = each.join(places.groupBy("word", "next").agg(F.count("*").alias("df")), ["word", "next"])
    whole = each.groupBy("query").agg(F.count("*").alias("known"), F.min("n").alias("n"), F.min_by(F.struct("word", "next", "place"), F.struct("df", "place")).alias("first")).filter("known = n")
    start = whole.select("query", "n", "first.*").join(places, ["word", "next"])
    start = index.save(start.select("query", "n", "doc", "row", (F.col("at") - F.col("place")).alias("begin")), "begins")
    rest = each.select("query", "word", "next", "place").join(start, "query").withColumn("at", F.col("begin") + F.col("place"))
    hits = rest.join(places, ["word", "next", "doc", "row", "at"])
    found = hits.groupBy("query", "doc", "row", "begin", "n").agg(F.count("*").alias("found")).filter("found = n").select("query", "doc")
    return found.union(alone).distinct()


def best_words(index: Index, queries: DataFrame, k: int, mask: DataFrame | None = None) -> DataFrame:
    """(query, doc, score): each query's k best documents of the mask by BM25, ties by document; queries are (query, words).

    Up to `ASKED` words of queries, and `SENT` pairs or documents of the mask, go to all tasks, counted first; more of them are
    joined as Spark plans it. Where bounds leave out less than half of the postings, all are read once and scored at once. The
    mask is read up to three times.
    """
    save, impact = index.save, search.impact(index.mean)
    gained = F.col("weight") * impact
    words = save(queries.select("query", F.explode(F.array_distinct("words")).alias("word")).filter("word <> ''").distinct(), "words")
    ids = save(words.select("word").distinct().withColumn("id", F.monotonically_increasing_id()), "ids")
    sent = F.broadcast if words.count() <= ASKED else lambda df: df
    n = tasks(words.sparkSession, index.docs * words.select("query").distinct().count())
    hits = save(index.blocks.join(sent(ids), "word").drop("word"), "hits")
    levels = save(hits.groupBy("id", "level").agg(F.count("*").alias("n"), F.max(impact).alias("top")), "levels")
    known = levels.groupBy("id").agg(F.sum("n").alias("df"), F.max("top").alias("top")).select("id", search.weight(index.docs).alias("weight"), "top")
    asked = save(words.join(ids, "word").join(known, "id").select("query", "id", "weight", (F.col("weight") * F.col("top")).alias("most")), "asked")
    weights = asked.select("query", "id", "weight")

    masked = None if mask is None else mask.select("doc").filter("doc is not null").distinct()
    short = masked is not None and masked.count() <= SENT
    inside = hits.join(F.broadcast(masked), "doc", "left_semi") if short else hits.filter("doc is not null")

    def dealt(postings: DataFrame) -> DataFrame:
        """By document, those of the mask. A long mask meets them there by an inner join: Spark would take a semi-join to all of the hits."""
        by = [n, "doc"] if n else ["doc"]
        rows = postings.repartition(*by)
        return rows if masked is None or short else rows.join(masked.repartition(*by), "doc")

    def scored(pairs: DataFrame) -> DataFrame:
        """(query, doc, score) of few pairs by all words."""
        held = hits.join(F.broadcast(pairs.select("doc", F.col("query").alias("of"))), "doc").withColumnRenamed("id", "held")
        met = held.join(sent(weights), F.col("of").eqNullSafe(F.col("query")) & (F.col("held") == F.col("id")))
        return met.groupBy("query", "doc").agg(F.sum(gained).alias("score"))

    # 1. what a document must reach
    down = Window.partitionBy("id").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)  # a row a level
    heads = levels.withColumn("lacks", 2 * k - F.coalesce(F.sum("n").over(down), F.lit(0))).filter("lacks > 0")
    heads = heads.select("id", "level", F.ceil(F.col("lacks") / F.col("n") * SHARES).alias("share"))  # any documents of a level will do
    seeds = inside.join(sent(heads), ["id", "level"]).filter(F.pmod(F.xxhash64("doc"), F.lit(SHARES)) < F.col("share")).drop("level", "share")
    sums = dealt(seeds).join(sent(weights), "id").groupBy("query", "doc").agg(F.sum(gained).alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    begun = save(sums.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r"), "begun")
    reached = scored(begun.drop("score")) if begun.count() <= SENT else begun
    least = reached.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).select("query", (F.col("least") - SLACK).alias("least"))
    # 2. words and levels that can't reach it
    up = Window.partitionBy("query").orderBy("most", "id").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("query")
    limits = asked.join(least, "query", "left").withColumn("least", F.coalesce("least", F.lit(0.0)))
    limits = limits.withColumns({"rank_sum": F.sum("most").over(up), "total": F.sum("most").over(every)})
    could = F.col("weight") * F.col("top")
    fits = (F.col("rank_sum") >= F.col("least")) & (could + F.col("total") - F.col("most") >= F.col("least"))
    bounds = limits.join(levels, "id").groupBy("query", "id", "weight", "least").agg(F.min(F.when(fits, F.col("level"))).alias("low"), F.coalesce(F.max(F.when(~fits, could)), F.lit(0.0)).alias("rest"))
    bounds = save(bounds.withColumn("rests", F.sum("rest").over(every)), "bounds")
    lowest = bounds.groupBy("id").agg(F.min("low").alias("lowest"))
    left = levels.join(lowest, "id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("level") >= F.col("lowest"), F.col("n"))).alias("read")).first()
    # 3. documents that can't, from blocks that can; 4. scores of what is left
    chosen = None
    if (left["read"] or 0) * 2 <= (left["n"] or 0):
        near = dealt(inside.join(sent(lowest), "id").filter("level >= lowest").drop("lowest"))
        gain = F.sum(gained - F.col("rest")).alias("gain")
        seen = near.join(sent(bounds), "id").filter("level >= low").groupBy("query", "doc").agg(gain, F.first("rests").alias("rests"), F.first("least").alias("least"))
        chosen = save(seen.filter("gain + rests >= least").select("query", "doc"), "candidates")
    if chosen is not None and chosen.count() <= SENT:
        full = scored(chosen)
    else:
        every_word = dealt(inside.drop("level")).join(sent(bounds.select("query", "id", "weight", "least")), "id")
        full = every_word.groupBy("query", "doc").agg(F.sum(gained).alias("score"), F.first("least").alias("least")).filter("score >= least").drop("least")
        full = save(full, "candidates")
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "doc")
    return full.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).drop("_r")


def tasks(spark: SparkSession, pairs: int) -> int | None:
    """Null where a task for each core is enough. Joins don't go below the session's number of partitions, so this doesn't either."""
    n = -(-pairs // PAIRS)
    return None if n <= spark.sparkContext.defaultParallelism else max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))


def hybrid(index: Index, vectors: DataFrame, queries: DataFrame, mask: DataFrame, per_leg: int = 200, base: int = 60, keep: int = 200) -> DataFrame:
    """(query, doc, rrf): both legs over the mask, fused by reciprocal ranks. vectors (doc, q), queries (query, words, q)."""
    mask = index.save(mask.select("doc").distinct(), "mask")
    inside = vectors.join(mask, "doc", "left_semi").select(F.col("doc").alias("vec_id"), "q")
    near = relational.top_k(inside, queries.filter("q is not null").select(F.col("query").alias("vec_id"), "q"), per_leg)
    by_words = best_words(index, queries.select("query", "words"), per_leg, mask)
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 6)), "doc")
    ranked = by_words.select("query", "doc", F.row_number().over(order).alias("rank"))
    both = ranked.unionByName(near.select(F.col("query_id").alias("query"), F.col("vec_id").alias("doc"), "rank"))
    fused = both.groupBy("query", "doc").agg(F.round(F.sum(1 / (base + F.col("rank"))), 12).alias("rrf"))
    top = Window.partitionBy("query").orderBy(F.desc("rrf"), "doc")
    return fused.withColumn("rank", F.row_number().over(top)).filter(F.col("rank") <= keep)
