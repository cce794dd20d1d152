"""Reading groups from sorted Arrow batches, and stages in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textreg.plans.stage import shared_root


def stage(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, whichever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/textreg/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Cut batches sorted by the integer column ``key`` into tables of whole groups, with the groups' bounds.

    One group is held at a time beside ``rows`` others, so memory follows the largest group.
    """

    def cut(table: pa.Table) -> np.ndarray:
        keys = table.column(key).to_numpy()
        return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])

    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        bounds = cut(table)
        if len(bounds) > 2:
            yield table.slice(0, int(bounds[-2])), bounds[:-1]
        held = table.slice(int(bounds[-2])).to_batches()
        n = sum(b.num_rows for b in held)
        rows = max(rows, 2 * n)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cut(table)
