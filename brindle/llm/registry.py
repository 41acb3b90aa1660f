"""The queries of the text operators and their SQL oracles."""

from __future__ import annotations

import importlib

MODULES = ("decontaminate", "simhash", "quality", "pii", "substring_dedup", "suffix_dedup", "html_text", "pieces", "url_filter", "licences")

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"brindle.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
