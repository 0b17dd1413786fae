"""Queries and SQL of the training-data operators, under the names the driver knows."""

from __future__ import annotations

from . import decontaminate, html_extract, language_id, lm_scoring, near_dedup, oracles, packing, quality_classifier, quality_rules, ranked_search, suffix_dedup, token_counts, url_filter, vector_codes

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_quality_rules": quality_rules.op2,
    "op3_lm_scoring": lm_scoring.op3,
    "op4_packing": packing.op4,
    "op5_url_filter": url_filter.op5,
    "op6_language_id": language_id.op6,
    "op7_decontamination": decontaminate.op7,
    "op8_quality_classifier": quality_classifier.op8,
    "op9_html_extraction": html_extract.op9,
    "op10_near_dedup": near_dedup.op10,
    "op11_token_counts": token_counts.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_ranked_search": ranked_search.op13,
}
ORACLES = {
    "op1_suffix_dedup": oracles.SUFFIX_DEDUP,
    "op7_decontamination": oracles.DECONTAMINATION,
    "op10_near_dedup": oracles.NEAR_DEDUP,
    "op12_vector_codes": oracles.VECTOR_CODES,
    "op13_ranked_search": oracles.RANKED_SEARCH,
}
