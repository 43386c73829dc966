"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

#: query name -> module that holds the function of that name
NAMES = {
    "op1_main_text": "main_text",
    "op2_warc": "warc",
    "op9_id_files": "id_files",
    "op10_toxicity": "toxicity",
    "op3_decontamination": "phrase_index",
    "op4_line_dedup": "line_dedup",
    "op5_token_counts": "token_counts",
    "op6_simhash": "simhash",
    "op7_topk": "topk",
    "op8_byte_bpe": "byte_bpe",
    "op11_filter_audit": "filter_audit",
    "op12_prefix_trie": "prefix_trie",
    "op13_source_mix": "source_mix",
}


def queries() -> dict:
    out = {n: getattr(importlib.import_module(f"{__package__}.{m}"), n) for n, m in NAMES.items()}
    return out


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
