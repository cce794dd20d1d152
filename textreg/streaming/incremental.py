"""Idempotent batch loading: replace one slice of a table, skip what is already loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textreg.plans.skew import lookup_join


def upsert_partition(batch: DataFrame, path: str, partition: str) -> None:
    """Replace, in the table at ``path``, exactly the ``partition`` values that occur in ``batch``.

    Rows are dealt by value into partitions of the advised size: small values share a task, a hot value is split
    over several, and the number of files follows the data instead of tasks times values.
    """
    (
        batch.hint("rebalance", partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition).parquet(path)
    )


def read_partitioned(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def new_keys(batch: DataFrame, loaded: DataFrame, key: str, spread_by: str | None = None) -> DataFrame:
    """Rows of ``batch`` whose key is not loaded yet; ``spread_by`` differs between rows of one key."""
    known = loaded.select(key).filter(F.col(key).isNotNull()).distinct()
    return lookup_join(batch, known, key, "left_anti", spread_by=spread_by)
