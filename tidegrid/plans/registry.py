"""Registered queries and their ANSI-SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: QueryFn
    sql: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` names the inventory lines it exercises."""

    def add(fn: QueryFn) -> QueryFn:
        if name in CATALOG:
            raise ValueError(f"query {name} is registered twice")
        CATALOG[name] = Query(name, tuple(covers.split()), fn, sql)
        return fn

    return add


def rounded(value: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero, so both engines print the same number."""
    col = F.col(value) if isinstance(value, str) else value
    return F.round(col, digits) + F.lit(0.0)


def rnd(expr: str, digits: int = 6) -> str:
    """SQL twin of :func:`rounded`."""
    return f"(round({expr}, {digits}) + 0.0)"
