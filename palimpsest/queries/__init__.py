"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from . import asking, capturing, chains, extras, keeping, logs, reports, states, streams, trees

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _part in (capturing, asking, keeping, streams, chains, logs, reports, trees, states, extras):
    QUERIES |= _part.register.queries
    SQL |= _part.register.sql
