"""Joins of a large side to a lookup side that hold when one key owns a third of the rows."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType

from textreg.plans.stage import write_stage

#: ``spread_by`` for rows that may repeat whole: they are written out with a number each, by which they are dealt.
EACH_ROW = "*"
MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20


def _bytes(value: Column, kind: DataType) -> Column:
    """Size of a value in memory: lengths of text and lists, 8 for any other field."""
    if isinstance(kind, (StringType, BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        if isinstance(kind.elementType, (StringType, BinaryType, ArrayType, StructType)):
            inner = F.aggregate(value, F.lit(0).cast("bigint"), lambda n, x: n + _bytes(x, kind.elementType))
        else:
            inner = 8 * F.size(value)
        return F.coalesce(inner, F.lit(0)) + 16
    if isinstance(kind, StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    return F.lit(8)


def fits_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS, max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """Measure ``df`` (rows and their sizes by type) against the broadcast bound."""
    row = sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    size = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(row.cast("bigint")), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "inner",
    spread_by: str | Sequence[str] | None = None,
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    hot_share: int = 1000,
    salts: int = 64,
    stored: bool = False,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join ``left`` to ``right`` on equal keys; ``how`` is inner, left, left_semi or left_anti.

    A ``right`` measured below the bounds is broadcast, so ``left`` is not shuffled. Otherwise
    both sides shuffle, and the keys that own more than ``1/hot_share`` of ``left`` - at most
    ``hot_share`` of them, whatever the data - are split by a hash of ``spread_by`` (a column that differs within a
    key, or ``EACH_ROW``), with the matching ``right`` rows copied: into as many pieces as they own such shares, so no piece is larger
    than the least of them. Rows with a null key match nothing and are spread over ``salts`` pieces.
    Keys already known to be frequent come as ``hot`` instead, save a pass over ``left`` and get ``salts`` pieces each.
    ``right`` is written out before it is measured, so it is computed once; pass ``stored`` when it
    is a table already.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    keys = [on] if isinstance(on, str) else list(on)
    if not stored:
        right = write_stage(right, "lookup")
    if fits_broadcast(right, max_broadcast_rows, max_broadcast_bytes):
        return left.join(F.broadcast(right), keys, how)
    if spread_by is None:
        return left.join(right, keys, how)
    numbered = spread_by == EACH_ROW
    if numbered:
        # Written first: a number that is computed anew after a lost executor could deal a row twice.
        left = write_stage(left.withColumn("__number", F.monotonically_increasing_id()), "numbered")
    spread = ["__number"] if numbered else [spread_by] if isinstance(spread_by, str) else list(spread_by)
    if hot is None:
        counts = write_stage(left.groupBy(*keys).count(), "key-counts")
        limit = max(1, (counts.agg(F.sum("count")).first()[0] or 0) // hot_share)
        hot = counts.filter(F.col("count") > limit).select(*keys, F.ceil(F.col("count") / limit).cast("int").alias("__pieces"))
    else:
        hot = hot.select(*keys, F.lit(salts).alias("__pieces"))
    no_key = functools.reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    pieces = F.when(no_key, F.lit(salts)).otherwise(F.coalesce("__pieces", F.lit(1)))
    salted_left = left.join(F.broadcast(hot), keys, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*spread), pieces).cast("int")
    ).drop("__pieces")
    copies = F.sequence(F.lit(0), F.coalesce("__pieces", F.lit(1)) - 1)
    salted_right = (
        right.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(copies)).drop("__pieces")
    )
    return salted_left.join(salted_right, [*keys, "__salt"], how).drop("__salt", *(["__number"] if numbered else []))
