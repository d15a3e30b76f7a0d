"""The registry of the engine's own queries and their SQL."""

from __future__ import annotations

from docketloom.plans import answers, chats, graphs, literals, maintenance, quality, retrieval, texts

PARTS = (retrieval, graphs, maintenance, texts, chats, quality, answers, literals)


def queries() -> dict:
    return {name: query for part in PARTS for name, query in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
