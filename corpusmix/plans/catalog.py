"""Names of the library's queries, each with a Spark plan and, where there is one, DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("records", "signals", "selection", "experiments", "validation")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _m in MODULES:
    _module = import_module(f"corpusmix.plans.{_m}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
