"""Keys, kinds and texts of records as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of records by name, and phrases for them.
KINDS = {"constant": 1, "theorem": 2, "type": 3, "class": 4, "locale": 5, "collection": 6, "method": 7, "experience": 8, "introduction": 0x12, "elimination": 0x22, "induction": 0x32, "case_split": 0x42}
RULES = ("introduction", "elimination", "induction", "case_split")
EXPERIENCE = KINDS["experience"]
EXPERIENCE_HEAD = "This is an experience that aims to help prove goals of the following forms:"
EXPERIENCE_WHEN = "The experience should be used in the following situation:"
MEMBER = r"^(.*)\((\d+)\)$"


def byte_at(key: Column, at: int) -> Column:
    """The number of byte `at` (0-based) of a binary key."""
    return F.conv(F.hex(F.substring(key, at + 1, 1)), 16, 10).cast("int")


def key_class(key: Column, kinds: Sequence[int] = tuple(KINDS.values())) -> Column:
    """status (16 bytes), meta (shorter, or of no known kind) or entity."""
    n = F.octet_length(key)
    return F.when(n == 16, "status").when((n > 16) & byte_at(key, 16).isin(*kinds), "entity").otherwise("meta")


def is_persistent(key: Column) -> Column:
    """The lowest bit of the first byte is off."""
    return byte_at(key, 0) % 2 == 0


def retag(key: Column, kind: Column) -> Column:
    """The key of another face: only byte 16 differs."""
    return F.concat(F.substring(key, 1, 16), F.unhex(F.lpad(F.hex(kind.cast("long")), 2, "0")), F.substring(key, 18, 1 << 20))


def ships(key: Column, constituents: Column, composed: Column) -> Column:
    """Composed keys by all their constituents' hashes where they are known, others by their own bit; counters never."""
    own = is_persistent(key)
    return F.when(F.octet_length(key) < 16, False).when(composed & constituents.isNotNull(), F.forall(constituents, is_persistent)).otherwise(own)


def interpreted(persistent: Column, finished: Column, stored: Column, caller: Column) -> Column:
    """Persistent: its mark; else the stored pair of process and serial is the caller's, and there is one."""
    return F.when(persistent, F.coalesce(finished, F.lit(False))).otherwise(F.coalesce(caller.isNotNull() & stored.eqNullSafe(caller), F.lit(False)))


def belongs(theory: Column, constituents: Column, chosen: Column) -> Column:
    """Its own theory or one of its constituents is chosen."""
    return F.array_contains(chosen, theory) | F.coalesce(F.arrays_overlap(constituents, chosen), F.lit(False))


def in_scope(theories: Column, sessions: Sequence[str]) -> Column:
    """Every theory's session - what stands before the first dot - is declared."""
    return F.forall(theories, lambda t: F.substring_index(t, ".", 1).isin(*sessions))


def value_class(value: Column, size: int) -> Column:
    n = F.octet_length(value)
    return F.when(n == 0, "tombstone").when(n == size, "vector").otherwise("marker")


def format_class(length: Column, dimension: int) -> Column:
    return F.when(length == 4 * dimension, "float32").when(length == 2 * dimension, "q15").otherwise("other")


def is_member(name: Column, kind: Column, position: Column, collections: Column) -> Column:
    """`base(N)` without a position whose base is a collection; methods and experiences never are."""
    return F.coalesce(~kind.isin(7, 8) & position.isNull() & name.rlike(MEMBER) & F.array_contains(collections, F.regexp_extract(name, MEMBER, 1)), F.lit(False))


def live_name(name: Column, live: Column, collection: Column | None = None) -> Column:
    """The live name where there is one; with `collection`, only for members whose live name is indexed."""
    if collection is None:
        return F.coalesce(live, name)
    return F.when(collection.isNotNull() & live.rlike(r"\(\d+\)$"), live).otherwise(name)


# How rules are named. A base name that ends in the letter counts if no capital stands before it.
RULE_ENDS = {
    "introduction": ("I", ("_intro", ".intro", "_intros", ".intros")),
    "elimination": ("E", ("_elim", ".elim", "_elims", ".elims", "_dest", ".dest")),
}
BASE_ENDS = {"induction": ("_induct", "_ind"), "case_split": ("_cases", "_case")}


def rule_class(name: Column) -> Column:
    """By the end of a rule's name, the first that fits: induction, case split, introduction, elimination."""
    base = F.substring_index(name, ".", -1)
    ends = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda e: c.endswith(e))
    out = F.when(ends(base, BASE_ENDS["induction"]), "induction").when(ends(base, BASE_ENDS["case_split"]), "case_split")
    for kind, (letter, words) in RULE_ENDS.items():
        out = out.when(base.rlike(rf"(?s)[^A-Z]{letter}\z") | ends(name, words), kind)
    return out


def kinds_phrase(kinds: Column, phrases: Mapping[str, str], default: str = "constructs") -> Column:
    """One noun phrase: kinds in order, each phrase once, `a, b and c`; rules are one; unknown or no kinds: the default."""
    known = F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv])
    each = F.array_distinct(F.transform(kinds, lambda k: F.coalesce(F.element_at(known, k), F.when(k.isin(*RULES), "inference rules").otherwise(default))))
    n = F.size(each)
    return F.when(n <= 0, default).when(n == 1, F.element_at(each, 1)).otherwise(F.concat(F.array_join(F.slice(each, 1, n - 1), ", "), F.lit(" and "), F.element_at(each, -1)))


def document_text(kind: Column, pretty: Column, interpretation: Column, patterns: Column) -> Column:
    """What is embedded for a record; null where there is no interpretation, or an experience has no patterns."""
    lines = F.concat(F.array(F.lit(EXPERIENCE_HEAD)), F.transform(patterns, lambda p: F.concat(F.lit("- "), p)), F.array(F.lit(EXPERIENCE_WHEN), interpretation))
    experience = F.when(F.size(patterns) > 0, F.array_join(lines, "\n"))
    return F.when(interpretation.isNotNull(), F.when(kind == EXPERIENCE, experience).otherwise(F.concat(pretty, F.lit("\n"), interpretation)))


def apply_template(template: str, text: Column, task: Column | None = None) -> Column:
    """Literal replacement: the task first, then the text, which is not looked at again."""
    out = F.lit(template)
    if task is not None:
        out = F.replace(out, F.lit("{task}"), F.when(task.contains("{text}") | task.contains("{task}"), F.raise_error(F.lit("a task must not contain {text} or {task}"))).otherwise(task))
    return F.replace(out, F.lit("{text}"), text)


def store_name(model: Column) -> Column:
    return F.replace(model, F.lit("/"), F.lit("__"))


def model_name(store: Column) -> Column:
    """The inverse, but for names that hold two underscores."""
    return F.replace(store, F.lit("__"), F.lit("/"))


def boosted(score: Column, hit: Column, n_patterns: Column) -> Column:
    """Nearer to one by a quarter of the hit rate, with more than one pattern only."""
    return F.when(n_patterns > 1, score + (1 - score) * 0.25 * hit).otherwise(score)


def single_line(text: Column) -> Column:
    """Without a last `begin`, carriage returns and line ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"\s*\bbegin$", ""), r"\s*[\r\n]+\s*", " ")


def without_surrogates(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{D800}-\x{DFFF}]", "")


def qualifier(name: Column) -> Column:
    return F.when(name.contains("."), F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise("")


def middle(name: Column) -> Column:
    """Without the first and the last part."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 2, F.size(parts) - 2), ".")).otherwise("")


def has_suffix(name: Column, suffix: Column) -> Column:
    """Equal, or ends with a dot and the suffix."""
    return (name == suffix) | name.endswith(F.concat(F.lit("."), suffix))


def line_and_column(text: Column, offset: Column) -> Column:
    """Of a 0-based character offset: 1-based line and byte column."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    last = F.substring_index(before, "\n", -1)
    return F.struct((F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).alias("line"), (F.octet_length(last) + 1).alias("col"))


def portable_path(path: Column, roots: Mapping[str, str]) -> Column:
    """The first root that a path lies under, by its variable."""
    out = None
    for root, name in roots.items():
        hit = path.startswith(root + "/")
        new = F.concat(F.lit(name), F.substring(path, F.lit(len(root) + 1), F.length(path)))
        out = F.when(hit, new) if out is None else out.when(hit, new)
    return path if out is None else out.otherwise(path)


def redacted(url: Column) -> Column:
    """Without user, password, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"//[^/@]*@", "//")


def version_segment(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/(v[0-9]+[a-z0-9]*)(?:/|$)", 1), F.lit(""))


def cost(input_tokens: Column, cached: Column, output: Column, prices: tuple[float, float, float]) -> Column:
    """Per million tokens of input, cached input and output; no more is cached than there is."""
    hit = F.least(F.greatest(cached, F.lit(0)), input_tokens)
    return ((input_tokens - hit) * prices[0] + hit * prices[1] + output * prices[2]) / 1e6


def human_bytes(n: Column) -> Column:
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KiB", "MiB", "GiB"), 1):
        out = out.when(n < 1024 ** (i + 1), F.concat(F.format_number(n / 1024**i, 1), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_number(n / 1024**4, 1), F.lit(" TiB")))


def infrastructure(name: Column, attributes: dict[str, Column], preserved: Column, declared: Column) -> Column:
    """A helper nobody searches for: declared as one, or not to be preserved and concealed, hidden or named like one."""
    base = F.substring_index(name, ".", -1)
    named = name.contains(".class.") | name.contains("??.") | base.rlike(r"^(Abs|Rep)_") | base.endswith("_class")
    marks = F.lit(False)
    for c in attributes.values():
        marks = marks | F.coalesce(c, F.lit(False))
    return declared | (~preserved & (marks | named))
