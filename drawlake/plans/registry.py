"""Queries over the standard tables: each runs operators of this library and names those it shows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    operators: tuple[str, ...]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(operators: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register a function under its own name with the operators it shows and the SQL that gives the same rows."""

    def add(run: Run) -> Run:
        REGISTRY[run.__name__] = Query(run, tuple(operators.split()), sql)
        return run

    return add
