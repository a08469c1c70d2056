"""Registered queries: each pairs a Spark plan with its SQL statement."""

from __future__ import annotations

import importlib

#: Modules that register queries, in the order of the operator inventory.
MODULES = ("flagship", "quality", "market", "panel", "factor", "evaluation", "candidates", "modeling", "ledger", "streams")


def _import_all() -> None:
    for name in MODULES:
        importlib.import_module(f"marketloom.plans.{name}")


def load() -> dict:
    from marketloom.plans.registry import PLANS

    _import_all()
    return dict(PLANS)


def load_sql() -> dict[str, str]:
    from marketloom.plans.registry import SQL

    _import_all()
    return dict(SQL)
