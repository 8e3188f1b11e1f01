"""Named queries over the benchmark tables, with an equivalent SQL text where one exists.

Every module holds ``QUERIES`` (name to function of session and table folder) and ``SQL``.
"""

from shelfmark.catalog import audit, cleaning, files, filters, selection, text, vectors

_MODULES = [cleaning, files, selection, filters, text, vectors, audit]


def queries():
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
