"""The queries of the training-data operators; none of them is given in SQL (their tests compare with brute force)."""

from __future__ import annotations

from docketry.llm import ann, decontamination, langid, packing, pii, secrets, simhash, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_packing": packing.op2_packing,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_neighbours": ann.op4_neighbours,
    "op5_pii": pii.op5_pii,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": langid.op7_language_id,
    "op8_secrets": secrets.op8_secrets,
    "op9_simhash": simhash.op9_simhash,
    "op10_decontamination": decontamination.op10_decontamination,
}
ORACLE_SQL: dict[str, str] = {}
