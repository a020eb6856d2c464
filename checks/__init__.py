"""Registered queries over the given tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "catalogue", "validation", "pairs", "windows", "features", "augment", "store",
    "similarity", "model", "evaluation", "profiling", "streams", "flagship",
)


def _merged(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(import_module(f"checks.{name}"), attribute))
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_sql() -> dict:
    return _merged("SQL")
