"""Tagged handles: data is published under tags, found by tag, worked on where it is, and fetched on request.

A handle is a lazy DataFrame; nothing runs until ``get``. Code goes to the data as a function of a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Handle:
    name: str
    tags: frozenset[str]
    description: str
    data: DataFrame

    def apply(self, function: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The result of a function on the data, still lazy."""
        return function(self.data)

    def get(self, limit: int = 10_000) -> list:
        """The rows themselves, if there are no more than ``limit``; more raise an error, and none are left out silently."""
        rows = self.data.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError(f"{self.name} has more than {limit} rows; work on them with apply, or write them to a table")
        return rows


class Store:
    """Handles of one session, each also a temporary view."""

    def __init__(self, spark: SparkSession):
        self.spark, self._handles = spark, {}

    def publish(self, name: str, data: DataFrame, tags: Iterable[str] = (), description: str = "") -> Handle:
        data.createOrReplaceTempView(name)
        self._handles[name] = handle = Handle(name, frozenset(tags), description, data)
        return handle

    def find(self, *tags: str) -> list[Handle]:
        """The handles that have all of the tags, by name."""
        return [h for _, h in sorted(self._handles.items()) if h.tags >= set(tags)]

    def withdraw(self, name: str) -> None:
        self._handles.pop(name)
        self.spark.catalog.dropTempView(name)
