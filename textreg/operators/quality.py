"""Checks that guard a pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def validate_columns(df: DataFrame, required: Sequence[str], name: str = "table") -> None:
    """Fail, naming them, when required columns are missing. Looks at the schema only."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns: {', '.join(missing)}")


def alignment_violations(base: DataFrame, result: DataFrame, target: str, row: str = "row_index") -> DataFrame:
    """One row of counts: rows on either side, indices missing, doubled or out of range, targets that differ."""
    left = base.select(F.col(row).alias("i"), F.lit(1).alias("in_base"), F.lit(0).alias("in_result"),
                       F.col(target).alias("base_y"), F.lit(None).cast(result.schema[target].dataType).alias("result_y"))
    right = result.select(F.col(row).alias("i"), F.lit(0).alias("in_base"), F.lit(1).alias("in_result"),
                          F.lit(None).cast(base.schema[target].dataType).alias("base_y"),
                          F.col(target).alias("result_y"))
    per_row = left.union(right).groupBy("i").agg(
        F.sum("in_base").alias("nb"), F.sum("in_result").alias("nr"),
        F.max("base_y").alias("by"), F.max("result_y").alias("ry"),
    )
    return per_row.agg(
        F.coalesce(F.sum("nb"), F.lit(0)).alias("base_rows"),
        F.coalesce(F.sum("nr"), F.lit(0)).alias("result_rows"),
        F.count_if((F.col("nb") != 1) | (F.col("nr") != 1)).alias("unmatched"),
        F.count_if(~F.col("by").eqNullSafe(F.col("ry"))).alias("target_differs"),
        # Distance of the least index from 0 and of the greatest from the last one; neither can offset the other.
        (F.abs(F.coalesce(F.min("i"), F.lit(0))) + F.abs(F.coalesce(F.max("i"), F.lit(-1)) - F.count("i") + 1))
        .alias("index_gaps"),
    )


def assert_alignment(base: DataFrame, result: DataFrame, target: str, row: str = "row_index") -> None:
    v = alignment_violations(base, result, target, row).first()
    if v["base_rows"] != v["result_rows"] or v["unmatched"] or v["target_differs"] or v["index_gaps"]:
        raise ValueError(f"embedding rows do not line up with their source: {v.asDict()}")


def row_count_check(source: DataFrame, features: DataFrame) -> DataFrame:
    """``source_rows``, ``feature_rows`` and whether they agree."""
    both = source.select(F.lit(1).alias("s"), F.lit(0).alias("f")).union(
        features.select(F.lit(0).alias("s"), F.lit(1).alias("f"))
    )
    counts = both.agg(F.sum("s").alias("source_rows"), F.sum("f").alias("feature_rows"))
    return counts.withColumn("equal", (F.col("source_rows") == F.col("feature_rows")).cast("int"))


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException:
        return False
    return True


def require_fitted_state(spark: SparkSession, path: str) -> None:
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no fitted state at {path}; run the train split first")


def validate_selection(chosen: Sequence[str], allowed: Sequence[str], what: str) -> list[str]:
    """The chosen names (all allowed ones when empty); unknown names are an error."""
    unknown = [c for c in chosen if c not in allowed]
    if unknown:
        raise ValueError(f"unknown {what}: {', '.join(unknown)}; use some of: {', '.join(allowed)}")
    return list(chosen) or list(allowed)


def validate_positive(**numbers: int) -> None:
    for name, value in numbers.items():
        if value < 1:
            raise ValueError(f"{name} must be >= 1")
