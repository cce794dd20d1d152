"""Registration of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The parquet tables of one folder; ``t.orders`` reads one lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.kept = spark, folder.rstrip("/"), {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """What ``build`` returns, built at its first use in a query."""
        if name not in self.kept:
            self.kept[name] = build()
        return self.kept[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` as ``name``, with its DuckDB twin."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register
