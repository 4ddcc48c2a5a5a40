"""The subpackage's queries and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from wearline.llm import (chat, decontaminate, fixity, language, licenses, manifest, mixing, negatives, neighbours, ngram_join, packing,
                          quality, token_counts)

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_mixing": mixing.op2_mixing,
    "op3_nearest_neighbours": neighbours.op3_nearest_neighbours,
    "op4_fixity_audit": fixity.op4_fixity_audit,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_language_id": language.op7_language_id,
    "op8_ngram_jaccard_join": ngram_join.op8_ngram_jaccard_join,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_license_scan": licenses.op10_license_scan,
    "op11_decontamination": decontaminate.op11_decontamination,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_merkle_manifest": manifest.op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op4_fixity_audit": fixity.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
    "op11_decontamination": decontaminate.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_merkle_manifest": manifest.ORACLE,
}
