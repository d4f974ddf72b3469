"""The tokenizer's asset and its vectors, and the batch lexer against a character-by-character model."""

import json
import random
import re
import unicodedata

import pyarrow as pa
import pytest

from ferrule.functions import lexer
from ferrule.sources import assets, snapshot


def model(asset, text):
    """Tokens and subtokens, one character after the other."""
    held = {k: {c for a, b in asset[k] for c in range(a, b + 1)} for k in ("letters", "digits", "spaces")}
    text = unicodedata.normalize("NFC", text or "").replace("\x7f", " ")
    text = re.sub(r"\\<\^?[A-Za-z][A-Za-z0-9_']*>", lambda m: asset["symbols"].get(m[0], m[0]), text)
    markers, out, i = {k[0] for k in asset["fold"]}, "", 0
    while i < len(text):
        pair = text[i : i + 2]
        wide = len(pair) == 2 and pair[0] in markers
        out += asset["fold"].get(pair, pair) if wide else text[i]
        i += 2 if wide else 1
    tokens, mode = [], ""
    for c in out:
        name = ord(c) in held["letters"] or mode == "name" and (ord(c) in held["digits"] or c in asset["quasi_letters"])
        now = "" if ord(c) in held["spaces"] or c in asset["discarded"] else "name" if name else "number" if ord(c) in held["digits"] and c not in asset["rendered_digits"] else "signs" if c in asset["ascii_symbolic"] else "alone"
        if now and now == mode != "alone":
            tokens[-1] += c
        elif now:
            tokens.append(c)
        mode = now
    parts = []
    for t in tokens:
        cut = [x for x in re.split(f"[{re.escape(asset['separators'])}]", t) if x]
        parts += cut or ([t] if all(c in asset["rendered_subsup"] for c in t) else [])
    return out, tokens, parts


def test_batches_against_the_model():
    asset = lexer.default_asset()
    own, rng = lexer.Lexer(asset), random.Random(5)
    bits = ["a", "Z", "é", "e\u0301", "1", "²", "ᶜ", "₁", "_", "'", ".", "?", " ", "\n", "+", "<", "\\", "⇩", "⇧", "❙", "x", "9", "𝐱", "\x7f", r"\<alpha>", r"\<^sub>", r"\<unknown>", r"\<^bold>", "∀", "\\<", ">", "一", "\u2028"]
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000))]
    rows = pa.array(texts, pa.string())
    got = list(zip(own.normalized(rows).strings().to_pylist(), own.tokens(rows).to_pylist(), own.subtokens(rows).to_pylist(), strict=True))
    assert got == [model(asset, t) for t in texts]
    assert own.subtokens(pa.array([], pa.string())).to_pylist() == [] and own.subtokens(rows.slice(7, 3)).to_pylist() == [model(asset, t)[2] for t in texts[7:10]]


def test_asset_from_symbol_files(spark, tmp_path):
    (tmp_path / "a").write_text("# comment\n\\<oplus>  code: 0x002295  group: operator\n\\<mine>  code: 0x00e000\n\\<oplus2> no code\n\\<^here> code: 0x002302 font: x\n")
    (tmp_path / "b").write_text("\\<oplus>\tcode: 0x002A01\n")
    asset = assets.build(spark, [f"file://{tmp_path}/a", f"file://{tmp_path}/b"])
    assert asset["symbols"][r"\<oplus>"] == "⨁" and asset["symbols"][r"\<^here>"] == "⌂" and asset["symbols_private_use"] == [r"\<mine>"]
    whole = lexer.default_asset()
    assert all(asset[k] == whole[k] for k in whole if k not in ("symbols", "symbols_private_use"))
    at = f"file://{tmp_path}/asset.json"
    assert assets.write(spark, asset, at) == assets.digest(asset) and json.loads(snapshot.read_text(spark, at)) == asset
    own = assets.load(spark, at)
    assert own.subtokens(pa.array([r"x \<oplus> y \<mine> z"]))[0].as_py() == ["x", "⨁", "y", "\\<", "mine", ">", "z"]
    assets.write(spark, asset | {"tokenizer_rule": 2}, at)
    with pytest.raises(ValueError):
        assets.load(spark, at)


def test_vectors_gate(spark, tmp_path):
    asset, at = lexer.default_asset(), f"file://{tmp_path}/golden"
    texts = spark.createDataFrame([(str(i), f"f{i} + x\\<^sub>{i % 10} \u2028?y_{i}") for i in range(200)], "id string, input string")
    few = assets.sampled(texts, 4)
    assert 20 < few.count() < 90 and few.exceptAll(assets.sampled(texts, 4)).count() == 0
    meta = assets.write_vectors(texts, asset, at)
    assert meta["count"] == 200 and assets.check_vectors(spark, at, asset) == []
    changed = asset | {"separators": asset["separators"].replace("_", "")}
    assert len(assets.check_vectors(spark, at, changed)) == 6
    snapshot.write_text(spark, f"{at}/history.txt", "other\n")
    spark.createDataFrame([("other", "a", ["a"], ["a"])], "id string, input string, tokens array<string>, subtokens array<string>").write.mode("append").json(f"{at}/vectors")
    assert len(assets.check_vectors(spark, at, asset)) == 3
