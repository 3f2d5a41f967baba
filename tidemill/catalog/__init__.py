"""All registered queries, by name."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("flagship", "tables", "series", "profiles", "learning", "known")


def _collect(attribute: str) -> dict:
    found = {}
    for name in _MODULES:
        found.update(getattr(import_module(f"tidemill.catalog.{name}"), attribute))
    return found


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLES")
