"""Exact per-group quantiles with linear interpolation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textreg.plans.ordering import add_row_index
from textreg.plans.stage import write_stage


def group_quantiles(
    df: DataFrame,
    key: str,
    value: str,
    probs: dict[str, float],
    max_group_values: int = 1_000_000,
    block_rows: int = 500_000,
) -> DataFrame:
    """One row per ``key`` with the quantiles ``{name: p}`` of the non-null ``value``. A null key is a group.

    The rows are first reduced to one count per (key, value). Groups with at most
    ``max_group_values`` distinct values use ``percentile`` over those counts. If any group is
    larger, cumulative counts are built over range-partitioned blocks instead and the rows that
    cover the wanted ranks are picked, so no task holds a whole group.
    """
    return quantiles_of_counts(stored_counts(df, key, value), key, value, probs, max_group_values, block_rows)


def stored_counts(df: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value, n)`` of the non-null values, stored."""
    return write_stage(
        df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n")), "value-counts"
    )


def quantiles_of_counts(
    counts: DataFrame, key: str, value: str, probs: dict[str, float], max_group_values: int = 1_000_000,
    block_rows: int = 500_000,
) -> DataFrame:
    """``group_quantiles`` of rows that are counted already."""
    widest = counts.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if widest <= max_group_values:
        wanted = F.percentile(value, F.array(*[F.lit(p) for p in probs.values()]), F.col("n"))
        picked = counts.groupBy(key).agg(wanted.alias("q"))
        return picked.select(key, *[F.get("q", F.lit(i)).alias(name) for i, name in enumerate(probs)])
    return _quantiles_by_rank(counts, key, value, probs, block_rows)


def _quantiles_by_rank(counts: DataFrame, key: str, value: str, probs: dict[str, float], block_rows: int) -> DataFrame:
    blocks = add_row_index(counts, [key, value], "i").withColumn("b", F.expr(f"i div {block_rows}"))
    inside = Window.partitionBy(key, "b").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(key)
    # One row per (key, block): as many rows per key as the group has blocks.
    totals = blocks.groupBy(key, "b").agg(F.sum("n").alias("block_n")).select(
        F.col(key).alias("__key"), F.col("b").alias("__b"),
        F.coalesce(F.sum("block_n").over(before), F.lit(0)).alias("carry"),
        F.sum("block_n").over(whole).alias("total"),
    )
    ranked = (
        blocks.withColumn("upto", F.sum("n").over(inside))
        .join(totals.hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("__key")) & (F.col("b") == F.col("__b"))).drop("__key", "__b")
        .withColumn("last", F.col("carry") + F.col("upto") - 1)
        .withColumn("first", F.col("last") - F.col("n") + 1)
    )
    results = []
    for name, p in probs.items():
        spot = (F.col("total") - 1) * F.lit(float(p))
        low, high = F.floor(spot), F.ceil(spot)
        at_low = (F.col("first") <= low) & (low <= F.col("last"))
        at_high = (F.col("first") <= high) & (high <= F.col("last"))
        results += [
            F.max(F.when(at_low, F.col(value))).alias(f"{name}__lo"),
            F.max(F.when(at_high, F.col(value))).alias(f"{name}__hi"),
            F.max(spot - low).alias(f"{name}__w"),
        ]
    picked = ranked.groupBy(key).agg(*results)
    return picked.select(
        key,
        *[
            (F.col(f"{n}__lo") + (F.col(f"{n}__hi") - F.col(f"{n}__lo")) * F.col(f"{n}__w")).alias(n)
            for n in probs
        ],
    )
