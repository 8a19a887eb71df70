"""The queries of this package and their SQL."""

from __future__ import annotations

from . import byte_bpe, decontamination, exact_dedup, itemsets, language_id, merkle, near_dedup, quality, quality_rules, secret_scan, token_counts, toxicity, url_filter

QUERIES = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_language_id": language_id.op4_language_id,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_secret_scans": secret_scan.op7_secret_scans,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_closed_itemsets": itemsets.op11_closed_itemsets,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLE_SQL = {
    "op5_url_filters": url_filter.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_closed_itemsets": itemsets.ORACLE_SQL,
    "op12_quality_rules": quality_rules.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}
