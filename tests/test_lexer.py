import unicodedata

import pytest

from ferrule.functions import lexer

# Texts and the subtokens that they must have.
CASES = [
    ("sorted_wrt R ?xs", ["sorted", "wrt", "R", "xs"]),
    ("Kelly_1_39 ?C ?T ?a", ["Kelly", "1", "39", "C", "T", "a"]),
    ("Stirling_Formula.c = ln (2*pi)/2", ["Stirling", "Formula", "c", "=", "ln", "(", "2", "*", "pi", ")", "/", "2"]),
    ("f x + y", ["f", "x", "+", "y"]),
    ("_wrt", ["wrt"]),
    (r"\<Longrightarrow>", ["⟹"]),
    ("::", ["::"]),
    ("-->", ["-->"]),
    ("==>", ["==>"]),
    (r"x\<^sub>i + y\<^sup>T", ["x", "+", "y"]),
    (r"f\<^bsub>i\<^esub> = g", ["f", "i", "=", "g"]),
    (r"\<^bold>x \<^bold>(", ["𝐱", "("]),
    (r"[x]\<^sup>c\<^sup>e", ["[", "x", "]", "ᶜᵉ"]),
    (r"f\<^sub>1", ["f"]),
    ("a?b", ["a", "b"]),
    ("?a+?b", ["a", "+", "b"]),
    ("HOL-Analysis.Path_Connected.path_image_join", ["HOL", "-", "Analysis", "Path", "Connected", "path", "image", "join"]),
    ("f'", ["f'"]),
    (r"\<=", [r"\<="]),
    (r"\<binit>", [r"\<", "binit", ">"]),
    (r"\<alpha>", ["α"]),
    (r"\< \<alpha>", [r"\<", "α"]),
    (r"\<\<alpha>", [r"\<", "α"]),
    ("x1", ["x1"]),
    ("f 1000", ["f", "1000"]),
    (r"1 / 10\<^sup>2", ["1", "/", "10", "²"]),
    ("x-y", ["x", "-", "y"]),
    ("%x. x", ["%", "x", "x"]),
    *((t, []) for t in ("_", ".", "?", "   ", "???", "_.", r"\<^sub>", "")),
]
EQUAL = [("x + y", "x+y"), (r"A \<Longrightarrow> B", r"A\<Longrightarrow>B"), (r"\<lbrakk>?P; ?Q\<rbrakk>", r"\<lbrakk>?P;?Q\<rbrakk>"), (r"\<lambda>x. P x", r"\<lambda>x.P x"), ("x :: nat", "x::nat"), (r"x\<^sub>1 + y", r"x\<^sub>1+y"), ("sorted_wrt R ?xs", "sorted_wrt R xs")]


@pytest.mark.parametrize("text,expected", CASES)
def test_subtokens(text, expected):
    assert lexer.subtokens(text) == expected


@pytest.mark.parametrize("a,b", EQUAL)
def test_equal_texts(a, b):
    assert lexer.subtokens(a) == lexer.subtokens(b)


def test_white_space_parts_and_composed_forms():
    assert lexer.subtokens("f x") != lexer.subtokens("fx")
    assert lexer.subtokens("size Č = 0") == lexer.subtokens(unicodedata.normalize("NFD", "size Č = 0"))
    assert lexer.normalize("x⇩1 x⇩⇩1 x⇩⇩⇩1") == "x₁ x⇩⇩1 x⇩⇩₁"


def test_ranges_cover_the_class():
    assert lexer.ranges(str.isdigit, 0x7F) == [(0x30, 0x39)]
    held = {c for a, b in lexer.ranges(str.isalpha, 0x2FFF) for c in range(a, b + 1)}
    assert held == {c for c in range(0x3000) if chr(c).isalpha()}


def test_sequences_in_texts(spark):
    df = spark.createDataFrame([("sorted_wrt R xs", "wrt R"), ("sorted_wrt R xs", "R wrt"), ("a", "_"), (None, "a")], "hay string, needle string")
    assert [r[0] for r in df.select(lexer.sequence_in(df.hay, df.needle)).collect()] == [True, False, False, False]


def test_batches_are_worked_on_in_pieces():
    import pyarrow as pa

    texts = pa.array(["a_b c" * 40, None, "", "x" * 5000, *["\\<alpha> y_z"] * 300])
    parts = list(lexer.pieces(texts, 500))
    assert pa.concat_arrays(parts).to_pylist() == texts.to_pylist()
    assert max(sum(len(t or "") for t in p.to_pylist()) for p in parts if "x" * 5000 not in p.to_pylist()) <= 1000 and len(parts) > 5
    run = lexer.default_lexer().subtokens
    kind = pa.list_(pa.string())
    assert lexer.by_pieces(run, texts, kind).to_pylist() == run(texts).to_pylist()
    assert lexer.by_pieces(run, texts.slice(0, 0), kind).to_pylist() == []
