"""Queries over the driver's tables."""

from __future__ import annotations

import importlib

from lapforge.plans.registry import QUERIES, SQL, Query

_MODULES = ["laps", "marts", "history", "scoring", "text", "io"]


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"lapforge.plans.{name}_queries")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
