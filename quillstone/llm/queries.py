"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("q_chat", "q_topk", "q_tokens", "q_licenses", "q_packing", "q_secrets", "q_decontaminate", "q_toxicity", "q_ngram", "q_langid", "q_align", "q_divergence", "q_lm")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"{__package__}.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
