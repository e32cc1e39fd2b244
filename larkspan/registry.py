"""The engine's queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from larkspan.plans import fields, ground, live, nodes, records, reports, terrain

PLANS = (reports, records, fields, ground, nodes, live, terrain)


def queries() -> dict:
    return {name: fn for plan in PLANS for name, fn in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
