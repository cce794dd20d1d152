"""Global row numbers and neighbour access without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textreg.plans.stage import write_stage

_SLOT = "__slot"
# monotonically_increasing_id() keeps the partition number above bit 33 and the position below it.
_POSITION_BITS = 33


def _cols(keys: str | Column | Sequence) -> list:
    return [keys] if isinstance(keys, (str, Column)) else list(keys)


def add_row_index(df: DataFrame, order_by, name: str = "row_index", start: int = 0) -> DataFrame:
    """Number the rows ``start, start+1, ...`` in the order of ``order_by``.

    The rows are range-partitioned and sorted, so each partition knows its own positions; only one
    count per partition reaches the driver, where it becomes that partition's offset. ``order_by``
    must be unique per row (add the id last), which is also what lets a hot leading value spread
    over many partitions. The ranged rows are written once, so both passes see the same partitions.
    """
    keys = _cols(order_by)
    ranged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn(_SLOT, F.monotonically_increasing_id())
    )
    stored = write_stage(ranged, "ranged", "zstd")
    part = F.shiftright(_SLOT, _POSITION_BITS)
    sizes = {r["p"]: r["n"] for r in stored.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    offsets, running = [], start
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(running)
        running += sizes.get(p, 0)
    if not offsets:
        return stored.withColumn(name, F.col(_SLOT)).drop(_SLOT)
    table = df.sparkSession.createDataFrame(list(enumerate(offsets)), "__part int, __offset bigint")
    position = F.col(_SLOT).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    # One row per partition, so the table is as small as the plan's list of tasks.
    placed = stored.withColumn("__part", part.cast("int")).join(F.broadcast(table), "__part")
    return placed.select(*[F.col(f"`{c}`") for c in stored.columns if c not in (_SLOT, name)], (F.col("__offset") + position).alias(name))


def shift_features(
    df: DataFrame,
    features: dict[str, tuple[str, int]],
    index: str = "row_index",
    block_rows: int = 200_000,
) -> DataFrame:
    """Add ``{new: (column, offset)}``: the column's value ``offset`` rows later (negative: earlier).

    ``index`` must be contiguous. Rows are cut into blocks of ``block_rows`` and each block also
    gets copies of the few neighbours its edges need, so every block is one bounded window.
    """
    reach_next = max([o for _, o in features.values() if o > 0], default=0)
    reach_prev = max([-o for _, o in features.values() if o < 0], default=0)
    if max(reach_next, reach_prev) > block_rows:
        raise ValueError("block_rows must be at least the largest offset")
    home = F.expr(f"`{index}` div {block_rows}")
    within = F.col(index) % block_rows
    copies = [F.struct(home.alias("block"), F.lit(True).alias("own"))]
    if reach_next:
        copies.append(F.when(within < reach_next, F.struct((home - 1).alias("block"), F.lit(False).alias("own"))))
    if reach_prev:
        edge = within >= block_rows - reach_prev
        copies.append(F.when(edge, F.struct((home + 1).alias("block"), F.lit(False).alias("own"))))
    spread = df.withColumn("__c", F.explode(F.array_compact(F.array(*copies))))
    w = Window.partitionBy("__c.block").orderBy(index)
    added = [
        (F.lead(c, o).over(w) if o > 0 else F.lag(c, -o).over(w)).alias(new)
        for new, (c, o) in features.items()
    ]
    return spread.select("*", *added).filter(F.col("__c.own")).drop("__c")


def running_count(
    df: DataFrame,
    key: str | Sequence[str],
    order_by: str | Sequence[str],
    value: str,
    name: str,
    max_group_rows: int = 5_000_000,
    block_rows: int = 1_000_000,
) -> DataFrame:
    """Per ``key``, the number of non-null ``value`` seen so far in the order of ``order_by``.

    While no group exceeds ``max_group_rows`` this is one window. Beyond that the rows are numbered
    by (key, order), counted inside blocks of ``block_rows``, and each later block of a group adds
    the total of the group's earlier blocks: a hot group runs in many tasks.
    """
    keys, order = _cols(key), _cols(order_by)
    largest = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= max_group_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.count(value).over(w))
    blocks = add_row_index(df, keys + order, "__i").withColumn("__b", F.expr(f"__i div {block_rows}"))
    w = Window.partitionBy(*keys, "__b").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumn("__local", F.count(value).over(w))
    # One row per (key, block); earlier totals per key are at most rows / block_rows long.
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.groupBy(*keys, "__b").agg(F.count(value).alias("__n"))
        .withColumn("__carry", F.sum("__n").over(before))
        .filter(F.col("__carry").isNotNull())
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__kb"), "__carry")
    )
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__b") == F.col("__kb")]
    return local.join(carried, same, "left").select(
        *df.columns, (F.col("__local") + F.coalesce("__carry", F.lit(0))).alias(name)
    )


def top_per_group(df: DataFrame, group: str | Sequence[str], order_by: Sequence, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in the given order, with their 1-based ``rank``.

    The rank is bounded, so every task drops what lies beyond it before anything is shuffled.
    """
    if n < 1:
        raise ValueError("n must be >= 1")
    keys = [group] if isinstance(group, str) else list(group)
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)))
    return ranked.filter(F.col(rank) <= n)


def page_ranks(df: DataFrame, group: str, order_by: Sequence[str], id_col: str, per_page: int = 10) -> DataFrame:
    """Add the 1-based ``nr_page`` and ``nr_order`` of each hit of a group, ``per_page`` hits to a page; ``id_col`` must not be null.

    Counted block by block where a group is large (``running_count``).
    """
    if per_page < 1:
        raise ValueError("per_page must be >= 1")
    hits = running_count(df, group, order_by, id_col, "__seen")
    i = F.col("__seen") - 1
    page = F.floor(i / per_page)
    return hits.withColumns({"nr_page": page + 1, "nr_order": page * per_page + i % per_page + 1}).drop("__seen")
