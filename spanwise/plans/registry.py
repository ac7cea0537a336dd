"""All queries of the core with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanwise.plans import audit, core, reference

_MODULES = (reference, audit, core)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in _MODULES for k, f in m.oracle_sql().items()}
