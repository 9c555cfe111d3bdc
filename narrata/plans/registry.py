"""All registered queries of the library but those for training data."""

from __future__ import annotations

from . import block_queries, book_queries, engine_queries, more_queries, text_queries

MODULES = [text_queries, block_queries, book_queries, more_queries, engine_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.SQL.items()}
