"""Queries and SQL of this package, by name."""

from __future__ import annotations

from importlib import import_module

#: Modules with QUERIES and ORACLE.
MODULES = ("pii", "html_text", "pieces", "language_id", "quality_rules", "sharding", "grading", "near_dedup", "decontaminate", "line_dedup", "vector_codes", "hard_negatives", "exact_search")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"{__package__}.{m}").ORACLE.items()}
