"""Queries of the subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from lexloom.llm import leakage, lookalikes, markup, near_duplicates, nearest_vectors, packing, residue, splitting, subjects, term_frequency

MODULES = [residue, splitting, term_frequency, nearest_vectors, markup, near_duplicates, lookalikes, packing, leakage, subjects]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for m in MODULES for k, q in m.SQL.items()}
