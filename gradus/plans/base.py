"""How queries are registered: a function of (spark, sf_dir) and its SQL twin side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        """Decorates a query; without ``sql`` only a test can check it."""

        def keep(function: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"two queries named {name}")
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function

        return keep


def tables(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame | list[DataFrame]:
    found = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return found[0] if len(found) == 1 else found
