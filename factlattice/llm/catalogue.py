"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import byte_bpe, exact_dedup, filter_audit, language_id, lattice_lm, mixing, near_dedup, page_text, personal_data, spelling, token_counts, toxicity, vector_search

QUERIES = {
    "op10_page_text": page_text.query,
    "op8_vector_search": vector_search.query,
    "op4_token_counts": token_counts.query,
    "op9_lattice_lm": lattice_lm.query,
    "op5_language_id": language_id.query,
    "op3_toxicity": toxicity.query,
    "op2_near_dedup": near_dedup.query,
    "op7_byte_bpe": byte_bpe.query,
    "op1_mix_sources": mixing.query,
    "op6_exact_dedup": exact_dedup.query,
    "op11_spelling_variants": spelling.query,
    "op12_filter_audit": filter_audit.query,
    "op13_personal_data": personal_data.query,
}
ORACLE = {
    "op2_near_dedup": near_dedup.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op11_spelling_variants": spelling.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
