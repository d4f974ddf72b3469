"""Queries of this subpackage and the SQL of those that SQL can express."""

from . import decontaminate, html, language, lines, lm, media, mixing, neardup, periodic, secrets, tokens, toxicity, upsert

QUERIES = {
    "op1_line_spread": lines.query,
    "op2_mixing": mixing.query,
    "op3_class_lm": lm.query,
    "op4_token_ids": tokens.query,
    "op5_language_bloom": language.query,
    "op6_html_main_text": html.query,
    "op7_secret_scan": secrets.query,
    "op8_minhash": neardup.query,
    "op9_string_tiling": decontaminate.query,
    "op10_transport_stream": media.query,
    "op11_keyed_upsert": upsert.query,
    "op12_toxicity": toxicity.query,
    "op13_word_runs": periodic.query,
}
SQL = {"op1_line_spread": lines.SQL, "op2_mixing": mixing.SQL}
