"""Queries of this subpackage by name, and SQL for those that SQL can say."""

from __future__ import annotations

from lexspark.llm import alignment, codes, extraction, mixing, pieces, quality, secrets, sharding, simhash, substrings, tokens, topk, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_html_extraction": extraction.op4_html_extraction,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_exact_top_k": topk.op7_exact_top_k,
    "op8_substring_dedup": substrings.op8_substring_dedup,
    "op9_sentencepiece": pieces.op9_sentencepiece,
    "op10_sharding": sharding.op10_sharding,
    "op11_vector_codes": codes.op11_vector_codes,
    "op12_alignment": alignment.op12_alignment,
    "op13_secrets": secrets.op13_secrets,
}

ORACLES = {
    "op2_mixing": mixing.SQL,
    "op6_quality_rules": quality.SQL,
    "op7_exact_top_k": topk.SQL,
    "op8_substring_dedup": substrings.SQL,
    "op11_vector_codes": codes.SQL,
}
