"""All queries outside the training-data subpackage."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["reduction", "review", "filters", "rollups", "texts", "keywords", "production", "marks", "concepts", "sourced", "places", "chains", "work"]


def _parts():
    return [import_module(f"sparkdocket.queries.{m}") for m in _MODULES]


def queries() -> dict:
    return {k: f for m in _parts() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _parts() for k, s in m.ORACLE.items()}
