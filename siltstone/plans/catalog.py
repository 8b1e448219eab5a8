"""Every query of the library by name, each beside the SQL that gives the same rows."""

from __future__ import annotations

from importlib import import_module

#: Modules of this package that hold queries.
MODULES: tuple[str, ...] = ("relational", "functions", "audit", "records")


def _all(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out |= getattr(import_module(f"siltstone.plans.{name}"), what)()
    return out


def queries() -> dict:
    return _all("queries")


def oracle_sql() -> dict[str, str]:
    return _all("oracle_sql")
