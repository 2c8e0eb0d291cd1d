"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from tallyspan.llm import best_fit_packing, chat_formatting, exact_topk, html_extraction, minhash_near_dedup, quality_rules, secret_scans, sharding, source_mixing, toxicity

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_best_fit_packing": best_fit_packing.op2_best_fit_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_secret_scans": secret_scans.op4_secret_scans,
    "op5_minhash_near_dedup": minhash_near_dedup.op5_minhash_near_dedup,
    "op6_html_extraction": html_extraction.op6_html_extraction,
    "op7_sharding": sharding.op7_sharding,
    "op8_chat_formatting": chat_formatting.op8_chat_formatting,
    "op9_exact_topk": exact_topk.op9_exact_topk,
    "op10_source_mixing": source_mixing.op10_source_mixing,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.oracle(),
    "op7_sharding": sharding.oracle(),
    "op9_exact_topk": exact_topk.oracle(),
}
