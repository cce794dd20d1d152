"""Exploding multi-valued text, cross-tabulating, and sparse or dense vector layouts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textreg.functions.text import replace_first, strip
from textreg.plans.ordering import add_row_index
from textreg.plans.skew import lookup_join
from textreg.plans.stage import write_stage

MAX_PIVOT_VALUES = 10_000


def split_explode(df: DataFrame, column: str, alias: str | None = None, sep: str = ",") -> DataFrame:
    """One row per stripped part of a multi-valued text; null stays one null row."""
    alias = alias or column
    parts = F.split(strip(column), f"\\Q{sep}\\E")
    others = [c for c in df.columns if c != alias]
    return df.select(*others, F.explode_outer(parts).alias("__part")).select(
        *others, strip("__part").alias(alias)
    )


def protect_then_split(df: DataFrame, column: str, protected: str, alias: str | None = None) -> DataFrame:
    """``split_explode`` that keeps one bracketed list whole.

    The commas of ``protected`` are written as `` & `` before the split; the first `` & `` of each
    part is turned back.
    """
    alias = alias or column
    whole = protected.replace(", &", " &").replace(",", " &")
    guarded = df.withColumn(column, replace_first(column, protected, whole, literal=True))
    return split_explode(guarded, column, alias).withColumn(
        alias, strip(replace_first(alias, " & ", ", ", literal=True))
    )


def explode_paragraphs(df: DataFrame, column: str, position: str = "pos") -> DataFrame:
    """One row per list entry with its position; an empty list stays as one null row."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.posexplode_outer(column).alias(position, column))


def pair_counts(df: DataFrame, x: str, y: str, name: str = "len") -> DataFrame:
    """Rows per (x, y)."""
    return df.groupBy(x, y).agg(F.count("*").alias(name))


def pivot_values(df: DataFrame, on: str) -> list:
    """The pivot columns, refused when there are more than a result row can hold."""
    rows = df.select(on).distinct().orderBy(on).limit(MAX_PIVOT_VALUES + 1).collect()
    if len(rows) > MAX_PIVOT_VALUES:
        raise ValueError(f"{on} has more than {MAX_PIVOT_VALUES} values; give the values to pivot, or use sparse_crosstab")
    return [r[0] for r in rows]


def _zeros(table: DataFrame, index: str) -> DataFrame:
    """Null cells to 0; a null ``index`` stays null."""
    cells = [c for c in table.columns if c != index]
    return table.fillna(0, subset=cells) if cells else table


def pivot_flags(df: DataFrame, index: str, on: str, values: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per value: 1 when the index has it."""
    values = list(values) if values is not None else pivot_values(df, on)
    return _zeros(df.groupBy(index).pivot(on, values).agg(F.max(F.lit(1))), index)


def crosstab(
    df: DataFrame, x: str, y: str, cell: str, how: str = "sum", values: Sequence[str] | None = None
) -> DataFrame:
    """``x`` by ``y`` with the sum or mean of ``cell``; combinations that do not occur are 0."""
    if how not in ("sum", "mean"):
        raise ValueError("how must be 'sum' or 'mean'")
    values = list(values) if values is not None else pivot_values(df, y)
    agg = F.sum(cell) if how == "sum" else F.avg(cell)
    return _zeros(df.groupBy(x).pivot(y, values).agg(agg), x)


def crosstab_distinct(df: DataFrame, id_col: str, x: str, y: str, values: Sequence[str] | None = None) -> DataFrame:
    """``x`` by ``y`` with distinct ids per cell. Duplicates are dropped before anything is counted."""
    cells = df.select(id_col, x, y).distinct().groupBy(x, y).agg(F.count("*").alias("len"))
    return crosstab(cells, x, y, "len", "sum", values)


@dataclass(frozen=True)
class SparseTable:
    """A cross-tabulation of any width: ``columns(column_index, <y>)`` and ``rows(<x>, column_indices, column_values, n_columns)``."""

    columns: DataFrame
    rows: DataFrame


def sparse_crosstab(df: DataFrame, x: str, y: str, cell: str | Column, how: str = "sum") -> SparseTable:
    """``x`` by ``y`` with the sum, mean or maximum of ``cell``, for any number of values of ``y``.

    The values of ``y`` are numbered in order, as a table, and only cells that occur are stored, by column number. A row is as long
    as it has different columns. A null ``x`` or ``y`` is a value of its own; nulls come first. A cell without a value is 0 and so not stored.
    """
    if how not in ("sum", "mean", "max"):
        raise ValueError("how must be 'sum', 'mean' or 'max'")
    value = F.col(cell) if isinstance(cell, str) else cell
    cells = df.select(F.col(x), F.col(y), value.alias("cell")).groupBy(x, y).agg({"sum": F.sum, "mean": F.avg, "max": F.max}[how]("cell").alias("cell"))
    cells = write_stage(cells, "cells")
    columns = write_stage(add_row_index(cells.select(y).distinct(), y, "column_index"), "columns")
    size = columns.count()
    known = columns.filter(F.col(y).isNotNull())
    placed = lookup_join(cells, known, y, "left", spread_by=x, stored=False)
    nothing = columns.filter(F.col(y).isNull()).first()
    index = F.coalesce("column_index", F.lit(None if nothing is None else nothing["column_index"]).cast("bigint"))
    entry = F.when(F.coalesce(F.col("cell"), F.lit(0)) != 0, F.struct(index.alias("i"), F.col("cell").alias("v")))
    rows = placed.groupBy(x).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return SparseTable(columns, rows.select(
        x, F.col("e.i").alias("column_indices"), F.col("e.v").alias("column_values"), F.lit(size).cast("bigint").alias("n_columns")
    ))


def sparse_flags(df: DataFrame, index: str, on: str) -> SparseTable:
    """1 for every value of ``on`` that ``index`` has, however many there are."""
    return sparse_crosstab(df, index, on, F.lit(1), "max")


def row_sum_order(table: DataFrame, index: str) -> DataFrame:
    """Rows of a cross-tabulation with their total, largest first."""
    total = F.lit(0)
    for c in table.columns:
        if c != index:
            total = total + F.col(f"`{c}`")
    return table.select(index, total.alias("total")).orderBy(F.desc("total"), index)


def sparse_rows_to_triplets(df: DataFrame, row: str = "row_index") -> DataFrame:
    """``(row_index, term_index, value)`` per stored entry; empty rows have none."""
    pair = F.explode_outer(F.arrays_zip("embedding_indices", "embedding_values")).alias("e")
    return df.select(row, pair).filter(F.col("e").isNotNull()).select(
        row, F.col("e.embedding_indices").alias("term_index"), F.col("e.embedding_values").cast("double").alias("value")
    )


def sparse_payload(entry: Column) -> tuple[Column, Column]:
    """Aggregates that collect ``struct<i, v>`` entries (null ones skipped) into index and value lists."""
    # In generated code; the comparison of ``array_sort`` is interpreted. There are no nulls in the list.
    ordered = F.sort_array(F.collect_list(entry))
    indices = F.transform(ordered, lambda e: e["i"].cast("bigint"))
    values = F.transform(ordered, lambda e: e["v"].cast("float"))
    return indices, values


def triplets_to_sparse_rows(triplets: DataFrame, rows: DataFrame, size: int, row: str = "row_index") -> DataFrame:
    """Index and value lists per row, ordered by index. A row of ``rows`` without entries keeps empty lists.

    A list is as long as its own document has different terms, whatever the number of documents.
    """
    entry = F.when(F.col("term_index").isNotNull(), F.struct(F.col("term_index").alias("i"), F.col("value").alias("v")))
    indices, values = sparse_payload(entry)
    empty = rows.select(row).withColumn("term_index", F.lit(None).cast("bigint")).withColumn(
        "value", F.lit(None).cast("double")
    )
    return triplets.select(row, "term_index", "value").unionByName(empty).groupBy(row).agg(
        indices.alias("embedding_indices"), values.alias("embedding_values")
    ).withColumn("embedding_size", F.lit(size).cast("int"))


def dense_to_columns(df: DataFrame, column: str = "embedding", size: int | None = None) -> DataFrame:
    """List column to ``emb_1 .. emb_n``; ``n`` is measured when not given, short lists give nulls."""
    if size is None:
        size = df.agg(F.max(F.size(column))).first()[0] or 0
    others = [c for c in df.columns if c != column]
    return df.select(*others, *[F.get(column, F.lit(i)).alias(f"emb_{i + 1}") for i in range(size)])


def attach_payload(base: DataFrame, payload: DataFrame, method: str, storage: str, row: str = "row_index") -> DataFrame:
    """Base columns plus the embedding columns, the method and how the vector is stored."""
    if storage not in ("sparse", "dense"):
        raise ValueError("storage must be 'sparse' or 'dense'")
    return base.join(payload, row, "left").withColumns(
        {"embedding_method": F.lit(method), "embedding_storage": F.lit(storage)}
    )
