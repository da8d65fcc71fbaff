"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import byte_pairs, leaks, near_duplicates, reading_level, similar_vectors, splitting, token_counts, visual_forms

MODULES = [near_duplicates, splitting, token_counts, similar_vectors, visual_forms, byte_pairs, leaks, reading_level]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
