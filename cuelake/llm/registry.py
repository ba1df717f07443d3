"""All named queries of this package."""

from __future__ import annotations

from importlib import import_module

MODULES = ["splitting", "topn", "bpe", "packing", "quality", "components", "overlaps"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"cuelake.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"cuelake.llm.{m}").SQL.items()}
