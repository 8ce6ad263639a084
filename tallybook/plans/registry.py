"""Every query of the engine by name, and the SQL that each is compared with."""

from __future__ import annotations

from tallybook.plans import coverage, extras, files, ledgers, office, pages, reports, statements

_MODULES: list = [coverage, reports, ledgers, extras, statements, office, pages, files]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
