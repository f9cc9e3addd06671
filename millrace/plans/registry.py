"""The engine's own queries by name."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that hold ``QUERIES`` and ``ORACLE``.
MODULES = ("retrieval", "records", "graphs", "texts", "sources", "planning", "runs", "editing", "scopes", "reading", "changes", "estimates")


def _merged(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(import_module(f"millrace.plans.{name}"), attribute))
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
