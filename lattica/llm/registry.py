"""Queries and SQL of the corpus operators, for the entry module."""

from __future__ import annotations

from importlib import import_module

#: name of the query: (module, attribute with its SQL or None)
OPERATORS = {
    "op1_line_dedup": ("line_dedup", "ORACLE_SQL"),
    "op2_ngram_join": ("ngram_join", None),
    "op3_lm_score": ("lm_score", None),
    "op4_substring_dedup": ("substring_dedup", None),
    "op5_language_id": ("language_id", None),
    "op6_packing": ("packing", None),
    "op7_secret_scan": ("secret_scan", None),
    "op8_exact_dedup": ("exact_dedup", "ORACLE_SQL"),
    "op9_mixing": ("mixing", None),
    "op10_quality_rules": ("quality_rules", "ORACLE_SQL"),
}


def queries() -> dict:
    return {name: import_module(f".{module}", __package__).query for name, (module, _) in OPERATORS.items()}


def oracle_sql() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), sql) for name, (module, sql) in OPERATORS.items() if sql}
