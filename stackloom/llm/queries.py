"""Queries of this package and the SQL they are compared with."""

from importlib import import_module

MODULES = ["license_scan", "flac", "chat", "token_files", "toxicity", "decontaminate", "near_dedup", "html_wrapper", "sentencepiece_scan", "lm_trie",
           "quality_rules", "filter_audit", "conversation_repair"]

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"stackloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= getattr(_module, "SQL", {})
