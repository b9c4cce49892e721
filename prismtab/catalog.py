"""All registered queries and their SQL."""

from __future__ import annotations

from prismtab.plans import analysis, inference, marketing, profiling

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _group in (marketing, profiling, analysis, inference):
    QUERIES |= _group.C.queries
    ORACLE_SQL |= _group.C.sql
