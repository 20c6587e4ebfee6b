"""The registry's entry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class QuerySpec:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


class Specs:
    """Collects the specs of a module through a decorator."""

    def __init__(self) -> None:
        self.found: list[QuerySpec] = []

    def query(self, sql: str | None = None) -> Callable:
        def register(run: Callable[[SparkSession, str], DataFrame]) -> Callable:
            self.found.append(QuerySpec(run.__name__, run, sql))
            return run

        return register
