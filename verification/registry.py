"""Collects queries and their SQL twins by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def case(name: str, sql: str | None = None) -> Callable:
    """Register a query under ``name``, with the SQL that must give the same rows."""

    def register(build: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def shift(digits: int) -> float:
    """A small offset added before rounding.

    Means of cents over 16 or 32 sales end exactly on a rounding edge, where the last bit of a
    floating-point sum would decide. The offset moves such values off the edge, in both engines.
    """
    return float(f"1.37e-{digits + 1}")


def steady(c: Column | str, digits: int) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + shift(digits), digits)


def steady_sql(expression: str, digits: int) -> str:
    return f"round({expression} + {shift(digits)!r}::DOUBLE, {digits})"
