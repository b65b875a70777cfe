"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

_MODULES = {
    "op1_decontaminate": "decontaminate",
    "op2_sentencepiece": "sentencepiece_codec",
    "op3_secret_scan": "secret_scan",
    "op4_token_counts": "token_counts",
    "op5_language_id": "language_id",
    "op6_toxicity": "toxicity",
    "op7_shingle_join": "shingle_join",
    "op8_lm_scores": "lm_scores",
    "op9_exact_dedup": "exact_dedup",
    "op10_license_scan": "license_scan",
    "op11_embedding_whitening": "embedding_whitening",
    "op12_filter_audit": "filter_audit",
    "op13_simhash": "simhash",
}


def queries() -> dict:
    return {name: import_module(f"rillway.llm.{m}").query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: import_module(f"rillway.llm.{m}").ORACLE for name, m in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
