"""Queries of the corpus operators and the SQL that gives the same rows."""

from __future__ import annotations

from siltstone.llm import compression, html_text, knn, language, language_model, negatives, packing, pieces, quality_rules, simhash, spelling, toxicity, url_filter

QUERIES = {
    "op1_sentencepiece_nbest": pieces.op1_sentencepiece_nbest,
    "op2_cross_entropy_difference": language_model.op2_cross_entropy_difference,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_voronoi_top_k": knn.op8_voronoi_top_k,
    "op9_language_id": language.op9_language_id,
    "op10_compression_quality": compression.op10_compression_quality,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_html_extraction": html_text.op12_html_extraction,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}
ORACLE = {
    "op3_quality_rules": quality_rules.ORACLE,
    "op6_url_filter": url_filter.ORACLE,
    "op8_voronoi_top_k": knn.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op13_spelling_variants": spelling.ORACLE,
}
