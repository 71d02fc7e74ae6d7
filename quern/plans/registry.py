"""Registered queries: each a function of a Library, with its SQL twin."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.model import Library, with_views

PLANS: dict[str, Callable[[Library], DataFrame]] = {}
SQL: dict[str, str] = {}


def plan(name: str, sql: str | None = None):
    def add(fn: Callable[[Library], DataFrame]):
        if name in PLANS:
            raise ValueError(f"{name} is registered twice")
        PLANS[name] = fn
        if sql:
            SQL[name] = with_views(sql)
        return fn
    return add


def _load() -> None:
    from quern.plans import all_plans  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {n: (lambda spark, path, fn=fn: fn(Library(spark, path))) for n, fn in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
