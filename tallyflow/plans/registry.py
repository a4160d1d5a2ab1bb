"""The library's own queries, from the modules of this package."""

from __future__ import annotations

from tallyflow.plans import branches, cost, git_work, patterns, periods, transcripts

MODULES = (cost, patterns, periods, branches, git_work, transcripts)


def queries():
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
