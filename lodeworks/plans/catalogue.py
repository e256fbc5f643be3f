"""All registered queries over the driver tables, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ["relational", "texts", "derivations", "retrieval", "graphs", "validations", "checks", "streams", "readers", "knowledge", "cognition", "extensions"]


def _modules() -> list:
    return [importlib.import_module(f"lodeworks.plans.{name}") for name in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in m.SQL.items()}
