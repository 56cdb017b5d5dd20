"""The queries of this folder and the SQL that states their results."""

from __future__ import annotations

import importlib

from .statements import ORACLE

#: query -> module that has it
QUERIES = {
    "op1_chat_format": "chat",
    "op2_ngram_jaccard": "ngram_join",
    "op3_benchmark_decontamination": "decontam",
    "op4_mix_sources": "mixing",
    "op5_pii": "pii",
    "op6_toxicity": "toxicity",
    "op7_warc": "warc",
    "op8_line_dedup": "line_dedup",
    "op9_embedding_dedup": "embedding",
    "op10_token_binary": "tokens",
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"{__package__}.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
