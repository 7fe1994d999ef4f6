"""A plan module registers (name, Spark query, oracle SQL) triples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlore.sources.tables import table


class Tables:
    """Attribute access to the driver's tables: ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None, name: str | None = None):
        """Decorator for ``f(t: Tables) -> DataFrame``."""

        def register(fn: Callable[[Tables], DataFrame]):
            key = name or fn.__name__
            self.queries[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if sql:
                self.oracles[key] = sql
            return fn

        return register
