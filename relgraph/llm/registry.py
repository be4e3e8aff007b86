"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import chat, decontamination, exact_dedup, hard_negatives, language_id, licenses, line_dedup, merkle, mixing, ngram_join, passage_dedup, token_counts, toxicity

QUERIES = {
    "op1_decontamination": decontamination.query,
    "op2_token_counts": token_counts.query,
    "op3_ngram_jaccard_join": ngram_join.query,
    "op4_mixing": mixing.query,
    "op5_passage_dedup": passage_dedup.query,
    "op6_toxicity": toxicity.query,
    "op7_exact_dedup": exact_dedup.query,
    "op8_line_dedup": line_dedup.query,
    "op9_chat_formatting": chat.query,
    "op10_language_id": language_id.query,
    "op11_hard_negatives": hard_negatives.query,
    "op12_license_scans": licenses.query,
    "op13_merkle_manifest": merkle.query,
}

SQL = {
    "op7_exact_dedup": exact_dedup.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op9_chat_formatting": chat.SQL,
    "op11_hard_negatives": hard_negatives.SQL,
    "op12_license_scans": licenses.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
