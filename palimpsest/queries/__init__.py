"""Registered queries, one for each operator, and SQL that gives the same rows."""

from palimpsest.queries import collecting, condensing, live, logs, planning, texts

MODULES = (texts, condensing, planning, collecting, logs, live)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
