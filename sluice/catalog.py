"""The registered queries, gathered from the query modules of sluice.plans."""

from __future__ import annotations

from collections.abc import Callable

from .plans import MODULES


def queries() -> dict[str, Callable]:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
