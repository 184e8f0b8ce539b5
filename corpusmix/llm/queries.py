"""The queries and SQL of all training-data operators."""

from __future__ import annotations

from importlib import import_module

MODULES = ("cutoff", "pack", "mix", "sample", "tokens", "encode", "neardup", "leak", "pii")


def _all(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(import_module(f"corpusmix.llm.{m}"), name, {})
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
