"""Hard negatives of anchors by a secondary sort of pair scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textreg.llm.batches import stage

#: Bytes of anchor vectors sent to the tasks at a time (one pass over the rows each), and numbers of one block of scores.
PASS_BYTES = 16 << 20
BLOCK = 1 << 21

_PAIR = pa.schema([("anchor", pa.int64()), ("descending", pa.int64()), ("kind", pa.int8()), ("id", pa.int64()), ("anchor_id", pa.int64())])
_PAIR_TYPES = "anchor bigint, descending bigint, kind tinyint, id bigint, anchor_id bigint"
_FOUND = pa.schema([
    ("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("rank", pa.int32()), ("negative_id", pa.int64()),
    ("positive_score", pa.int64()), ("negative_score", pa.int64()),
])
_FOUND_TYPES = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _matrix(column: pa.ListArray, width: int, kind: type) -> np.ndarray:
    """Integer vectors as rows of ``width`` numbers; missing components are 0."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy()
    values, row = column.flatten().to_numpy(), np.repeat(np.arange(len(column)), lengths)
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.zeros((len(column), width), kind)
    inside = place < width
    out[row[inside], place[inside]] = values[inside]
    return out


def _block_rows(width: int) -> int:
    return max(1, BLOCK // max(width, 256))


@dataclass
class _Anchors:
    """Anchors of one pass: row number, id, label, vectors, and per positive the window of negative scores (empty: low > high)."""

    number: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _candidates(shared, positives: int, negatives: int):
    """Pairs of a block that can be among the first: same-label ones without windows, different-label ones with them."""

    def best(score: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        """Per anchor the rows of the ``k`` highest scores, of equal ones those on the left; -1 where there are fewer."""
        n = score.shape[1]
        # One number orders by score, then by place: exact, as the caller bounds its size.
        packed = np.where(allowed, score * n + (n - 1 - np.arange(n)), np.array(-1, score.dtype) * 2**62)
        if k < n:
            packed = np.partition(packed, n - k, axis=1)[:, n - k :]
        return np.where(packed > -(2**61), n - 1 - np.mod(packed, n), -1).astype(np.int64)

    def block(a: _Anchors, some: slice, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        number, id_, label = (rows.column(c).to_numpy() for c in ("number", "id", "label"))
        score = a.vectors[some] @ _matrix(rows.column("v"), a.vectors.shape[1], a.vectors.dtype.type).T
        same = a.label[some, None] == label
        if a.low.shape[1] == 0:
            kind, found = 0, [best(score, same & (a.number[some, None] != number), positives)]
        else:
            kind, found = 1, []
            for w in range(a.low.shape[1]):
                low, high = a.low[some, w, None], a.high[some, w, None]
                if (low <= high).any():
                    found.append(best(score, ~same & (score >= low) & (score <= high), negatives))
        if not found:
            return
        at = np.concatenate(found, axis=1)
        of = np.broadcast_to(np.arange(len(at))[:, None], at.shape)[at >= 0]
        pair = np.unique(np.stack([of, at[at >= 0]], axis=1), axis=0)
        of, at = pair[:, 0], pair[:, 1]
        yield pa.RecordBatch.from_arrays([
            pa.array(a.number[some][of]), pa.array(-score[of, at].astype(np.int64)), pa.array(np.full(len(of), kind, np.int8)),
            pa.array(id_[at]), pa.array(a.id[some][of]),
        ], schema=_PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for batch in batches:
            step = _block_rows(a.vectors.shape[1])
            for at in range(0, batch.num_rows, step):
                rows = pa.Table.from_batches([batch.slice(at, step)]).sort_by([("id", "ascending"), ("number", "ascending")])
                wide = max(1, BLOCK // rows.num_rows)
                for k in range(0, len(a.number), wide):
                    yield from block(a, slice(k, k + wide), rows)

    return run


def _first(positives: int):
    """The first ``positives`` pairs of each anchor, from sorted pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, 0
        for batch in batches:
            keep = []
            for anchor in batch.column(0).to_pylist():
                now, seen = anchor, seen + 1 if anchor == now else 1
                keep.append(seen <= positives)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _mine(negatives: int, low: int, high: int):
    """Walk sorted pairs: a positive opens a window, a negative goes to the open windows it lies in. Only windows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, windows = None, []
        for batch in batches:
            out = []
            for anchor, descending, kind, id_, anchor_id in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if anchor != now:
                    now, windows = anchor, []
                score = -descending
                if kind == 0:
                    windows.append([id_, score, 0])
                    continue
                for window in windows:
                    positive_id, positive, taken = window
                    if taken < negatives and low * positive <= 100 * score <= high * positive:
                        window[2] += 1
                        out.append((anchor_id, positive_id, taken + 1, id_, positive, score))
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)

    return run


def _sorted(pairs: DataFrame) -> DataFrame:
    """Secondary sort: pairs meet by anchor, and each task reads its own in the order of (anchor, descending score, id); positives come
    before negatives of the same score."""
    return pairs.repartition("anchor").sortWithinPartitions("anchor", "descending", "kind", "id")


def mine_hard_negatives(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
    scale: int = 256, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
) -> DataFrame:
    """Negatives of each anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Component x counts as ``floor(scale * x)``; a score is the integer inner product with the anchor. Higher scores come first, ties by smaller id.
    An anchor's positives are its first ``n_positives`` other rows of its label; for each, the first ``n_negatives`` rows of other labels
    whose score is ``low`` to ``high`` percent of the positive's are returned (for a score below 0 there are none).

    Anchors go to the tasks in passes of ``PASS_BYTES``, and a pass reads the rows once. A task scores a block of rows against blocks of
    anchors and keeps the pairs that no other row of the block can push out: first those of the same label, then, with the positives known, those of each
    window. Only these pairs are shuffled, keyed by (anchor, descending score, id) and sorted within partitions (the DataFrame form of
    ``repartitionAndSortWithinPartitions``); an iterator walks them, opens a window per positive and emits negatives. It holds an
    anchor's windows, never its pairs.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Rows that repeat count each, also as anchors, and a row is
    not its own positive. Vectors of unequal length are compared as if the shorter went on with zeros; an empty one scores 0. An empty table, or one without anchors, gives
    no rows. Scores must fit 62 bits with room for a block's rows; larger components are an error. Other columns are ignored.
    """
    x = F.col(vector_col)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    valid = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & F.coalesce(finite, F.lit(False))
    kept = stage(
        rows.filter(valid).select(
            F.monotonically_increasing_id().alias("number"), F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
            F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
        ),
        "vectors",
    )
    spark = rows.sparkSession
    largest = F.array_max(F.transform("v", lambda c: F.abs(c)))
    shape = kept.agg(F.max(F.size("v")).alias("width"), F.max(largest).alias("largest"), F.sum(F.col("is_anchor").cast("bigint")).alias("n")).first()
    if not shape["n"]:
        return spark.createDataFrame([], _FOUND_TYPES)
    width = max(shape["width"], 1)
    bound = width * max(shape["largest"] or 0, 1) ** 2 * _block_rows(width)
    if bound >= 2**61:
        raise ValueError("components are too large for exact scores")
    exact = np.float64 if bound < 2**53 else np.int64
    passes = max(1, math.ceil(shape["n"] * width * 8 / PASS_BYTES))
    anchors = kept.filter("is_anchor").withColumn("turn", F.pmod(F.xxhash64("number"), F.lit(passes)))

    def pairs(positives: DataFrame | None) -> DataFrame:
        out = None
        for turn in range(passes):
            mine = anchors.filter(F.col("turn") == turn).select("number", "id", "label", "v").toArrow().sort_by("number")
            number = mine.column("number").to_numpy()
            empty = np.zeros((len(number), 0), np.int64)
            a = _Anchors(number, mine.column("id").to_numpy(), mine.column("label").to_numpy(), _matrix(mine.column("v"), width, exact), empty, empty)
            if positives is not None:
                a.low, a.high = np.ones((len(number), n_positives), np.int64), np.zeros((len(number), n_positives), np.int64)
                known = positives.filter(F.pmod(F.xxhash64("anchor"), F.lit(passes)) == turn).select("anchor", "descending").distinct().toArrow()
                known = known.sort_by([("anchor", "ascending"), ("descending", "ascending")])
                of, score = np.searchsorted(number, known.column("anchor").to_numpy()), -known.column("descending").to_numpy()
                place = np.arange(len(of)) - np.searchsorted(of, of)
                a.low[of, place], a.high[of, place] = -((-low * score) // 100), (high * score) // 100
            found = kept.select("number", "id", "label", "v").mapInArrow(
                _candidates(spark.sparkContext.broadcast(a), n_positives, n_negatives), _PAIR_TYPES
            )
            found = stage(found, "pairs") if passes > 1 else found
            out = found if out is None else out.unionByName(found)
        return out

    positives = stage(_sorted(pairs(None)).mapInArrow(_first(n_positives), _PAIR_TYPES), "positives")
    return _sorted(positives.unionByName(pairs(positives))).mapInArrow(_mine(n_negatives, low, high), _FOUND_TYPES)
