"""Queries of the numbered operators and of the pipeline, with DuckDB SQL where it can express them."""

from __future__ import annotations

from veilspark.llm import align, maxent, mix, packing, pii, prefix, quality, secrets, simhash, tokens, tries, urls, vectors

QUERIES = {
    "op1_pareto_mix": mix.op1_pareto_mix,
    "op2_embedding_dedup": vectors.op2_embedding_dedup,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_token_counts": tokens.op4_token_counts,
    "op5_quality": quality.op5_quality,
    "op6_url_filter": urls.op6_url_filter,
    "op7_sum_of_squares_pack": packing.op7_pack,
    "op8_pii_tagger": pii.op8_pii,
    "op9_prefix_fingerprint": prefix.op9_prefix_fingerprint,
    "op10_simhash": simhash.op10_simhash,
    "op11_token_alignment": align.op11_token_alignment,
    "op12_lm_score": maxent.op12_lm_score,
    "op13_divergence_audit": tries.op13_divergence_audit,
}
ORACLES = {"op1_pareto_mix": mix.ORACLE, "op2_embedding_dedup": vectors.ORACLE, "op3_secret_scan": secrets.ORACLE, "op6_url_filter": urls.ORACLE, "op13_divergence_audit": tries.ORACLE}
