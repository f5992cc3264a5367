"""Named queries: every module here registers DataFrame builders and, where SQL can say it, the same in SQL."""

from __future__ import annotations

import importlib

MODULES = ("notices", "expressions", "relational", "linkage", "survival", "episodes", "stages", "audit", "evaluation")


def _all():
    return [importlib.import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    return {name: f for m in _all() for name, (f, _) in m.Q.registered.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _all() for name, (_, sql) in m.Q.registered.items() if sql}
