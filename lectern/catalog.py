"""Registry of the queries that stand for the retrieval engine's operators."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> callable) and SQL (name -> DuckDB text).
MODULES = ("q_clean", "q_vector", "q_lexical", "q_browse", "q_usage")


def queries() -> dict:
    out = {}
    for m in MODULES:
        out.update(importlib.import_module(f"lectern.plans.{m}").QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for m in MODULES:
        out.update(importlib.import_module(f"lectern.plans.{m}").SQL)
    return out
