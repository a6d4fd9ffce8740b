"""Queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from tickloom.queries import features, joins, levels, risk, streams

_MODULES = (features, levels, joins, risk, streams)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
