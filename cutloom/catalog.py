"""All queries over the given tables and their SQL."""

from __future__ import annotations

from cutloom.plans import documents, edits, quality, rules, script, words

PLANS = (words, edits, quality, script, rules, documents)


def queries() -> dict:
    return {name: f for plan in PLANS for name, f in plan.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
