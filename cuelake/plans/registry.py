"""All named queries of the core."""

from __future__ import annotations

from importlib import import_module

MODULES = ["spans", "retrieval", "moments", "evaluation", "calibration", "routing", "governance", "questions", "ingest"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"cuelake.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"cuelake.plans.{m}").SQL.items()}
