"""Secret scans in DataFrame functions: three patterns, and Markov models over characters.

Two first-order character models, one of random strings and one of ordinary identifiers, are
trained from labelled samples; a candidate is a run of token characters of 16 or more with a
letter, and it is reported as kind `markov` where the log-likelihood ratio of the models is at
least `THRESHOLD` and no pattern has found anything there. The models are one table of ratios
(69 x 69, a fixed size) in the plan as a literal; everything runs in the JVM without Python.

Positions: splitting a text at a pattern gives the pieces between the matches that extracting gives,
so running lengths of both are the matches' code-point positions.

Defined cases: null or empty text has no spans, counts 0 and the digest of the empty string; equal
starts are ordered assign, access, hex, markov; repeated rows give equal rows; long texts are read
whole; an empty table gives an empty result; other columns are
kept by `scan`, which adds only `spans` and `base`, in place of columns with these names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import read

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WIDTH = len(ALPHABET) + 1
THRESHOLD = 8.0
SAMPLES = 3000
# Parts of ordinary identifiers, from which labelled samples are made.
PARTS = (
    "account action active address admin agent alert alias amount answer apply archive array async attach audit author backup balance base batch before begin block board body bool border bound branch "
    "buffer build button cache call cancel case category center change channel char check child class clean clear client clone close cluster code collect color column command commit compare config "
    "connect console content context control convert copy core count create current custom data date debug decode default define delete depth detail device dialog digest display document domain "
    "download draft driver edit element email empty enable encode engine entity entry error event example execute export factory field file filter find finish first flag folder format frame function "
    "global graph group handle header height hidden history host image import index info input insert install item iterator join json kernel label language last layer layout length level library line "
    "link list load local lock login main manager map mask master match member memory menu merge message method model module monitor name network node notify number object offset option order output "
    "owner package page panel parent parse path payment pending phone pixel player plugin point policy pool position prefix preview print process product profile project property provider public query "
    "queue random range reader record region register release remote remove render report request reset resource response result retry return role root route sample save scale schedule schema screen "
    "search section select sender sequence server service session setting share signal size socket sort source space stage start state status step storage store stream string style submit summary "
    "support switch symbol sync system table target task template test text theme thread time title total track transfer tree trigger type update upload user util valid value vector version view visible "
    "volume watch weight widget width window worker wrapper writer zone"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """(token, secret): n of either label; `n` is the bound of the sample."""
    parts = F.split(F.lit(" ".join(PARTS)), " ")
    part = lambda salt: F.element_at(parts, (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(PARTS))) + 1).cast("int"))
    digest = F.sha2(F.concat(F.lit("sample-"), F.col("id").cast("string")), 256)
    random = F.when(F.col("id") % 3 == 0, F.base64(F.unhex(digest))).when(F.col("id") % 3 == 1, F.substring(digest, 1, 40)).otherwise(F.translate(F.upper(F.base64(F.unhex(digest))), "+/=", ""))
    number = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(3000)).cast("string")
    plain = (
        F.when(F.col("id") % 8 == 0, F.concat_ws("_", part(1), part(2), part(3), number))
        .when(F.col("id") % 8 == 1, F.concat(part(1), F.initcap(part(2)), F.initcap(part(3)), number))
        .when(F.col("id") % 8 == 2, F.concat(part(1), part(2), part(3)))
        .when(F.col("id") % 8 == 3, F.concat_ws("/", part(1), F.concat_ws("_", part(2), part(3))))
        .when(F.col("id") % 8 == 4, F.concat(F.initcap(part(1)), F.initcap(part(2)), F.initcap(part(3)), F.initcap(part(4)), number))
        .when(F.col("id") % 8 == 5, F.upper(F.concat(part(1), part(2), part(3))))
        .when(F.col("id") % 8 == 6, F.upper(F.concat_ws("_", part(1), part(2), part(3))))
        .otherwise(F.concat_ws("-", F.concat(part(1), number), part(2), part(3)))
    )
    ids = spark.range(n)
    return ids.select(random.alias("token"), F.lit(True).alias("secret")).union(ids.select(plain.alias("token"), F.lit(False).alias("secret")))


def code(token: Column, at: Column) -> Column:
    """Place in the alphabet of a character, 0 for others and before the first."""
    return F.call_function("locate", F.substring(token, at, F.lit(1)), F.lit(ALPHABET))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of character pairs, smoothed by one half; row 0: before the first."""
    pairs = samples.filter("token is not null and length(token) > 0").select(
        "secret", F.explode(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.struct(F.when(i == 1, 0).otherwise(code(F.col("token"), i - 1)).alias("a"), code(F.col("token"), i).alias("b")))).alias("p")
    )
    rows = pairs.groupBy("secret", "p.a", "p.b").count().collect()  # at most 2 x WIDTH x WIDTH
    seen = {(r["secret"], r["a"], r["b"]): r["count"] for r in rows}
    total = {(s, a): sum(seen.get((s, a, b), 0) for b in range(WIDTH)) for s in (True, False) for a in range(WIDTH)}
    chance = lambda s, a, b: (seen.get((s, a, b), 0) + 0.5) / (total[s, a] + 0.5 * WIDTH)
    return [round(math.log(chance(True, a, b) / chance(False, a, b)), 4) for a in range(WIDTH) for b in range(WIDTH)]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ratio(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token, in one pass over its characters."""
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded into one literal

    def step(acc: Column, own: Column) -> Column:
        place = F.call_function("locate", own, F.lit(ALPHABET))
        return F.struct(place.alias("last"), (acc["sum"] + F.element_at(table, (acc["last"] * WIDTH + place + 1).cast("int"))).alias("sum"))

    return F.aggregate(F.split(token, ""), F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), step, lambda acc: acc["sum"])


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, found>> of the leftmost matches that don't overlap, in code points."""
    kind = "array<struct<start:bigint,end:bigint,found:string>>"
    none = F.array().cast(kind)

    def step(acc: Column, s: Column) -> Column:
        low = acc["at"] + F.length(s["gap"])
        high = low + F.length(s["hit"])
        return F.struct(high.alias("at"), F.concat(acc["out"], F.array(F.struct(low.alias("start"), high.alias("end"), s["hit"].alias("found")))).alias("out"))

    def offset(acc: Column, n: Column) -> Column:
        return F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def placed(steps: Column) -> Column:
        """Running sums in blocks of about the root of their number, as each append copies an array."""
        width = F.ceil(F.sqrt(F.size(steps))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / width).cast("int")), lambda b: F.slice(steps, b * width + 1, width))
        total = F.transform(blocks, lambda p: F.aggregate(p, zero, lambda n, s: n + F.length(s["gap"]) + F.length(s["hit"])))
        begin = F.aggregate(total, F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out")), offset, lambda acc: acc["out"])
        return F.flatten(F.zip_with(blocks, begin, lambda p, at: F.aggregate(p, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

    zero = F.lit(0).cast("long")
    # the last piece has no match after it; a lambda's variable is computed once, an expression inside a lambda again and again
    steps = F.slice(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")), 1, F.greatest(F.regexp_count(text, F.lit(pattern)), F.lit(1)))
    return F.when(text.rlike(pattern), once(steps, placed)).otherwise(none)


def tagged(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """Adds base and spans: arrays of (start, rank, end, kind), in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    wide = F.filter(matches(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 6)
    found = docs.withColumn("base", F.array_sort(F.concat(tagged(wide, "assign"), tagged(matches(text, ACCESS), "access"), tagged(matches(text, HEX), "hex"))))
    own = F.filter(matches(text, CANDIDATE), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    own = F.filter(own, lambda s: ratio(s["found"], model) >= THRESHOLD)
    return found.withColumn("spans", F.array_sort(F.concat("base", tagged(own, "markov"))))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), train(labelled_samples(spark)))
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
