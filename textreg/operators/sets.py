"""Set arithmetic over key columns of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textreg.functions.text import strip_lower


def difference_counts(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys only in ``first`` and only in ``second``. Null equals null, as in set operations."""
    sides = first.select(*keys, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(
        second.select(*keys, F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    )
    per_key = sides.groupBy(*keys).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b"))
    return per_key.agg(
        F.count_if(F.col("__b") == 0).alias("only_first"), F.count_if(F.col("__a") == 0).alias("only_second")
    )


def venn_regions(df: DataFrame, title: str, in_first: Column, in_second: Column) -> DataFrame:
    """Distinct stripped lower-case titles only in the first, only in the second, and in both origins.

    One aggregation over 128-bit digests: no title set is built anywhere and no title moves.
    """
    digest = F.unhex(F.md5(strip_lower(title)))
    sides = df.select(digest.alias("t"), in_first.alias("a"), in_second.alias("b")).filter("t is not null")
    per_title = sides.groupBy("t").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    return per_title.agg(
        F.count_if(F.col("a") & ~F.col("b")).alias("only_first"),
        F.count_if(~F.col("a") & F.col("b")).alias("only_second"),
        F.count_if(F.col("a") & F.col("b")).alias("both"),
    )
