"""All queries of the core library and their SQL, gathered from the modules of this package."""

from __future__ import annotations

from tessera.plans import curation, io, learning, strings, tokens

MODULES = [curation, io, learning, strings, tokens]


def queries() -> dict:
    """Name to callable."""
    return {name: q for module in MODULES for name, q in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
