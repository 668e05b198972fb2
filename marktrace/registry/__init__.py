"""All registered queries with the DuckDB statements they are checked against."""

from __future__ import annotations

import importlib

FAMILIES = ["edges", "scalars", "reports", "correlation", "fusion", "storage", "jobs", "cycles", "streams"]


def load():
    """(queries, oracle statements) of every family."""
    from marktrace.registry import base

    for family in FAMILIES:
        importlib.import_module(f"marktrace.registry.{family}")
    return dict(base.QUERIES), dict(base.SQL)
