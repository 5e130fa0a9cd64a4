"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from runforge.llm import bpe, chroma, context_tree, decontaminate, html_extract, line_dedup, minhash, quality, repeats, simhash, spelling, token_align, url_filter

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_simhash": simhash.op2_simhash,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_bpe": bpe.op4_bpe,
    "op5_chroma": chroma.op5_chroma,
    "op6_quality": quality.op6_quality,
    "op7_context_tree": context_tree.op7_context_tree,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_repeats": repeats.op9_repeats,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_minhash": minhash.op11_minhash,
    "op12_spelling": spelling.op12_spelling,
    "op13_token_align": token_align.op13_token_align,
}

ORACLE_SQL = {
    "op3_url_filter": url_filter.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
}
