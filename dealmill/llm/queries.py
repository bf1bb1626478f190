"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from dealmill.llm import ann, chat, decontam, divergence, html_extract, licenses, mixing, neardup, negatives, quality, tokens, toxicity, urls

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mix": mixing.op5_mix,
    "op6_licenses": licenses.op6_licenses,
    "op7_nearest": ann.op7_nearest,
    "op8_decontaminate": decontam.op8_decontaminate,
    "op9_urls": urls.op9_urls,
    "op10_extract": html_extract.op10_extract,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_quality": quality.op13_quality,
}

SQL = {
    "op1_chat_format": chat.OP1_SQL,
    "op2_near_duplicates": neardup.OP2_SQL,
    "op5_mix": mixing.mix_sql(),
    "op8_decontaminate": decontam.OP8_SQL,
    "op9_urls": urls.urls_sql(),
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_source_divergence": divergence.OP12_SQL,
}
