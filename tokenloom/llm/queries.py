"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

import importlib

_MODULES = {
    "op1_suffix_dedup": "suffixes",
    "op2_minmax_dedup": "minhash",
    "op3_sharding": "sharding",
    "op4_language_id": "langid",
    "op5_mixing": "mixing",
    "op6_license_scan": "licenses",
    "op7_embedding_dedup": "embeddings",
    "op8_quality": "quality",
    "op9_pii": "pii",
    "op10_decontamination": "decontam",
}


def queries() -> dict:
    import corpus_pipeline

    out = {name: importlib.import_module(f"{__package__}.{m}").query for name, m in _MODULES.items()}
    return out | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {name: importlib.import_module(f"{__package__}.{m}") for name, m in _MODULES.items()}
    out = {name: m.sql() for name, m in found.items() if hasattr(m, "sql")}
    return out | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
