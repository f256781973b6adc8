"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from textloom.llm import boilerplate, encode, langid, leakage, neardup, repeated_lines, residue, truncation

MODULES = (boilerplate, residue, langid, neardup, repeated_lines, encode, leakage, truncation)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
