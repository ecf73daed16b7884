"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from streamloom.llm import byte_bpe, chat, exact_dedup, fingerprints, lm, mixing, ngram_join, pii, quality, token_count

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op10_lm_scoring": lm.query,
    "op2_pii": pii.query,
    "op3_token_counts": token_count.query,
    "op4_source_mixing": mixing.query,
    "op5_fingerprints": fingerprints.query,
    "op6_ngram_jaccard_join": ngram_join.query,
    "op7_chat_formatting": chat.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_byte_bpe": byte_bpe.query,
    "pii_base_spans": pii.base_query,
    "mixing_targets": mixing.targets_query,
    "lm_base_scores": lm.base_query,
    "document_edits": fingerprints.edits_query,
}
SQL = {
    "op6_ngram_jaccard_join": ngram_join.SQL,
    "op7_chat_formatting": chat.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "pii_base_spans": pii.SQL,
    "mixing_targets": mixing.TARGETS_SQL,
    "lm_base_scores": lm.SQL,
    "document_edits": fingerprints.SQL,
}
