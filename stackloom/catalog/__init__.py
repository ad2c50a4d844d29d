"""Registered queries, grouped by subject; each module has ``QUERIES`` and ``SQL``."""

from importlib import import_module

MODULES = ["trees", "selections", "filtering", "scalars", "aggregates", "reports", "ingest", "inputs", "composed"]


def _collect(attribute: str) -> dict:
    out = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"stackloom.catalog.{name}"), attribute).items():
            if key in out:
                raise ValueError(f"query registered twice: {key}")
            out[key] = value
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_sql() -> dict:
    return _collect("SQL")
