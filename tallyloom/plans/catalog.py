"""All queries of the library proper, by name, with their SQL."""

from __future__ import annotations

from tallyloom.plans import leaks, money_flow, questions, review, runs, texts

_PARTS = (leaks, money_flow, texts, questions, runs, review)
QUERIES: dict = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
SQL: dict[str, str] = {k: q for part in _PARTS for k, q in part.SQL.items()}
