"""The queries of the thirteen operators, by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontamination, embedding_dedup, fill_middle, filter_audit, fingerprint, language_id, mixing, secrets, sharding, simhash_dedup, toxicity, url_filter

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_secret_scan": secrets.query,
    "op3_simhash": simhash_dedup.query,
    "op4_sharding": sharding.query,
    "op5_decontamination": decontamination.query,
    "op6_language_id": language_id.query,
    "op7_mixing": mixing.query,
    "op8_embedding_dedup": embedding_dedup.query,
    "op9_toxicity": toxicity.query,
    "op10_url_filter": url_filter.query,
    "op11_fingerprint": fingerprint.query,
    "op12_filter_audit": filter_audit.query,
    "op13_fill_middle": fill_middle.query,
}

ORACLES = {"op1_chat_format": chat_format.ORACLE, "op4_sharding": sharding.oracle(), "op10_url_filter": url_filter.ORACLE, "op12_filter_audit": filter_audit.ORACLE, "op13_fill_middle": fill_middle.ORACLE}
