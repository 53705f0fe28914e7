"""Queries of the numbered operators, one for each, with SQL where it can express them."""

from __future__ import annotations

from loomgraph.llm import chat, decontam, html_text, langid, merkle, mixing, ngram_join, spelling, substrings, token_files, topk, toxicity, urls

QUERIES = {
    "op1_exact_top_k": topk.op1,
    "op2_benchmark_decontamination": decontam.op2,
    "op3_chat_formatting": chat.op3,
    "op4_ngram_jaccard_join": ngram_join.op4,
    "op5_substring_dedup": substrings.op5,
    "op6_html_extraction": html_text.op6,
    "op7_url_filters": urls.op7,
    "op8_language_id": langid.op8,
    "op9_source_mixing": mixing.op9,
    "op10_toxicity": toxicity.op10,
    "op11_token_files": token_files.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_spelling_variants": spelling.op13,
}
SQL = {
    "op1_exact_top_k": topk.OP1_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op7_url_filters": urls.OP7_SQL,
    "op9_source_mixing": mixing.OP9_SQL,
    "op12_merkle_manifest": merkle.OP12_SQL,
    "op13_spelling_variants": spelling.OP13_SQL,
}
