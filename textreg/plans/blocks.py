"""Feature rows packed in blocks, and sums over them for many fits in one pass.

A block is a few hundred rows in compressed sparse form with their targets and fold labels, so a pass over the rows moves no row: a task
adds up arrays over its blocks and only the sums leave it.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stored entries of one block at most, and numbers of a dense slice of it.
ENTRIES, SLICE = 1 << 19, 1 << 21
#: Bytes of packed rows that are sent to the tasks whole, so that every task runs fits of its own.
SENT_BYTES = 64 << 20
#: Numbers of one chunk of a sum. Beyond so many partitions, or numbers of all of them, the chunks are added on the executors before they reach the driver.
CHUNK, DIRECT, DIRECT_NUMBERS = 1 << 18, 64, 1 << 23


@dataclass(frozen=True)
class Fit:
    """One fit over shared rows: all rows train but those whose ``label``-th fold is ``held`` (none, if ``label`` is null).

    ``features`` are the indices kept, ascending; null keeps all.
    """

    label: int | None = None
    held: int | None = None
    features: tuple[int, ...] | None = None


@dataclass
class Block:
    """Rows: stored entries ``starts[i]:starts[i + 1]``, target, fold labels and a number of their own. ``kept`` is for what a task derives."""

    starts: np.ndarray
    indices: np.ndarray
    values: np.ndarray
    y: np.ndarray
    labels: np.ndarray
    row: np.ndarray
    kept: dict = field(default_factory=dict)

    def trains(self, fits: list[Fit], a: int, b: int) -> np.ndarray:
        """1 where a row trains a fit, else 0: rows a to b by fits."""
        out = np.ones((b - a, len(fits)))
        for k, fit in enumerate(fits):
            if fit.label is not None:
                out[:, k] = self.labels[a:b, fit.label] != fit.held
        return out

    def some(self, rows: np.ndarray) -> Block:
        """The block of the given rows."""
        counts = np.diff(self.starts)[rows]
        upto = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        entries = np.arange(upto[-1]) + np.repeat(self.starts[:-1][rows] - upto[:-1], counts)
        return Block(upto, self.indices[entries], self.values[entries], self.y[rows], self.labels[rows], self.row[rows])

    def dense(self, columns: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """Rows a to b as a dense matrix of the features that ``columns`` maps to a place (others: -1), slice by slice."""
        step = max(1, SLICE // max(width, 1))
        for a in range(0, len(self.y), step):
            b = min(a + step, len(self.y))
            lo, hi = self.starts[a], self.starts[b]
            row = np.repeat(np.arange(b - a), np.diff(self.starts[a : b + 1]))
            at = columns[self.indices[lo:hi]]
            out = np.zeros((b - a, width))
            out[row[at >= 0], at[at >= 0]] = self.values[lo:hi][at >= 0]
            yield a, b, out


_PACKED = "n int, starts binary, indices binary, values binary, y binary, labels binary, row binary"
_PARTS = pa.schema([("chunk", pa.int32()), ("part", pa.binary())])


def _pack(n_labels: int, unit: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sparse, values = batch.column(0), batch.column(1)
            lengths = values.value_lengths().to_numpy()
            upto = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
            flat = values.flatten().to_numpy().astype(np.float64)
            place = np.arange(len(flat)) - np.repeat(upto[:-1], lengths)
            listed = np.repeat(np.asarray(sparse.is_valid()), lengths)
            place[listed] = sparse.flatten().to_numpy()
            y, row = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            labels = [batch.column(4 + k).to_numpy() for k in range(n_labels)] or [np.zeros(batch.num_rows)]
            labels = np.stack(labels, axis=1).astype(np.int32)
            if unit:
                length = np.sqrt(np.bincount(np.repeat(np.arange(len(y)), lengths), weights=flat * flat, minlength=len(y)))
                flat /= np.repeat(np.where(length > 0, length, 1.0), lengths)
            a = 0
            while a < len(y):
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + ENTRIES, side="right")) - 1)
                b = min(b, a + 4096, len(y))
                lo, hi = upto[a], upto[b]
                columns = [upto[a : b + 1] - lo, place[lo:hi].astype(np.int32), flat[lo:hi], y[a:b].astype(np.float64), labels[a:b], row[a:b]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b - a], pa.int32()), *[pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in columns]],
                    names=["n", "starts", "indices", "values", "y", "labels", "row"],
                )
                a = b

    return run


def _unpacked(batches: Iterator[pa.RecordBatch], n_labels: int) -> Iterator[Block]:
    for batch in batches:
        for k in range(batch.num_rows):
            n, starts, indices, values, y, labels, row = (c[k].as_py() for c in batch.columns)
            yield Block(
                np.frombuffer(starts, np.int64), np.frombuffer(indices, np.int32), np.frombuffer(values, np.float64), np.frombuffer(y, np.float64),
                np.frombuffer(labels, np.int32).reshape(n, max(n_labels, 1)), np.frombuffer(row, np.int64),
            )


def _added(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(p.as_py(), np.float64) for p in table.column("part")], axis=0)
    return pa.Table.from_arrays([table.column("chunk").slice(0, 1), pa.array([total.tobytes()], pa.binary())], schema=_PARTS)


class Local:
    """Blocks in the memory of one process, summed there."""

    def __init__(self, blocks: list):
        self.blocks = blocks

    def total(self, work: Callable[[Block, object], list[np.ndarray]], payload: object, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
        out = [np.zeros(s) for s in shapes]
        for block in self.blocks:
            for whole, part in zip(out, work(block, payload), strict=True):
                whole += part
        return out

    def derive(self, run: Callable[[Iterator], Iterator]) -> Local:
        return Local(list(run(iter(self.blocks))))

    def drop(self) -> None:
        self.blocks = []


class Derived:
    """What was made of blocks, kept by the tasks that made it; summed like blocks."""

    def __init__(self, frame: DataFrame, read: Callable[[Iterator[pa.RecordBatch]], Iterator], run: Callable[[Iterator], Iterator]):
        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in run(read(batches)):
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part, protocol=5)], pa.binary())], names=["part"])

        self.frame = frame.mapInArrow(make, "part binary").persist(StorageLevel.MEMORY_AND_DISK)
        self.frame.count()
        self.partitions = self.frame.rdd.getNumPartitions()

    def total(self, work: Callable[[object, object], list[np.ndarray]], payload: object, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
        return _total(self.frame, _unpickled, self.partitions, work, payload, shapes)

    def derive(self, run: Callable[[Iterator], Iterator]) -> Derived:
        return Derived(self.frame, _unpickled, run)

    def drop(self) -> None:
        self.frame.unpersist()


def _unpickled(batches: Iterator[pa.RecordBatch]) -> Iterator:
    for batch in batches:
        for part in batch.column(0):
            yield pickle.loads(part.as_py())


def _total(frame: DataFrame, read: Callable, partitions: int, work: Callable, payload: object, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    shared = frame.sparkSession.sparkContext.broadcast(payload)
    size = int(sum(np.prod(s) for s in shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in read(batches):
            found = np.concatenate([np.ravel(x) for x in work(block, shared.value)])
            total = found if total is None else total + found
        if total is not None:
            for chunk, at in enumerate(range(0, size, CHUNK)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int32()), pa.array([total[at : at + CHUNK].tobytes()], pa.binary())], schema=_PARTS
                )

    parts = frame.mapInArrow(run, "chunk int, part binary")
    if partitions > DIRECT or partitions * size > DIRECT_NUMBERS:
        parts = parts.groupBy("chunk").applyInArrow(_added, "chunk int, part binary")
    whole = np.zeros(size)
    for chunk, part in parts.toLocalIterator() if size > 64 * CHUNK else parts.collect():
        whole[chunk * CHUNK : (chunk + 1) * CHUNK] += np.frombuffer(part, np.float64)
    shared.destroy()
    out, at = [], 0
    for s in shapes:
        n = int(np.prod(s))
        out.append(whole[at : at + n].reshape(s))
        at += n
    return out


class Blocks:
    """``rows(features, y, *labels)`` packed and kept; rows without features or target are left out. Use as a context manager.

    ``row_index``, if there, names the rows. ``total`` sums over all blocks in one pass. ``each`` runs independent jobs: rows of at most ``SENT_BYTES`` go to
    the tasks whole and each task runs some jobs on its copy; more rows stay where they are and the jobs take turns, pass by pass.
    """

    def __init__(self, rows: DataFrame, labels: list[str], unit: bool = False):
        self.spark, self.n_labels = rows.sparkSession, len(labels)
        vector = F.unwrap_udt("features")
        row = F.col("row_index").cast("bigint") if "row_index" in rows.columns else F.monotonically_increasing_id()
        # A full vector stores no indices.
        read = rows.filter("features IS NOT NULL AND y IS NOT NULL").select(
            vector["indices"].alias("i"), vector["values"].alias("v"), F.col("y").cast("double"), row, *[F.col(c).cast("int") for c in labels]
        )
        self.frame = read.mapInArrow(_pack(self.n_labels, unit), _PACKED).persist(StorageLevel.MEMORY_AND_DISK)

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.frame.unpersist()

    @functools.cached_property
    def _counted(self) -> tuple[int, int]:
        found = self.frame.agg(F.sum("n"), F.sum(F.octet_length("values"))).first()
        return found[0] or 0, (found[1] or 0) // 8

    @property
    def n_rows(self) -> int:
        return self._counted[0]

    @property
    def entries(self) -> int:
        """Stored entries of all rows."""
        return self._counted[1]

    @functools.cached_property
    def small(self) -> bool:
        sizes = [F.octet_length(c) for c in ("indices", "values", "starts", "row")]
        return (self.frame.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0) <= SENT_BYTES

    def each(self, job: Callable[[Local | Blocks, object], object], jobs: list) -> list:
        """``job(blocks, argument)`` for every argument in ``jobs``, in their order."""
        if not self.small:
            return [job(self, argument) for argument in jobs]
        n_labels = self.n_labels
        shared = self.spark.sparkContext.broadcast((self.frame.toArrow(), jobs))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packed, every = shared.value
            local = Local(list(_unpacked(iter(packed.to_batches()), n_labels)))
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int64()), pa.array([pickle.dumps(job(local, every[k]))], pa.binary())], names=["id", "result"]
                    )

        dealt = self.spark.range(0, len(jobs), 1, max(1, len(jobs)))
        found = {k: pickle.loads(r) for k, r in dealt.mapInArrow(run, "id bigint, result binary").collect()}
        shared.unpersist()
        return [found[k] for k in range(len(jobs))]

    def over(self, run: Callable[[Iterator[Block]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``run`` yields for the blocks of each task."""
        n_labels = self.n_labels
        return self.frame.mapInArrow(lambda batches: run(_unpacked(batches, n_labels)), schema)

    def total(self, work: Callable[[Block, object], list[np.ndarray]], payload: object, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
        """Sums over all blocks of the arrays, of the given shapes, that ``work(block, payload)`` returns."""
        n_labels = self.n_labels
        return _total(self.frame, lambda batches: _unpacked(batches, n_labels), self.partitions, work, payload, shapes)

    @functools.cached_property
    def partitions(self) -> int:
        return self.frame.rdd.getNumPartitions()

    def derive(self, run: Callable[[Iterator[Block]], Iterator]) -> Derived:
        """What ``run`` makes of the blocks of each task, kept until ``drop``."""
        n_labels = self.n_labels
        return Derived(self.frame, lambda batches: _unpacked(batches, n_labels), run)
