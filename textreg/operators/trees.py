"""Regression trees on rows of any number: second-order boosting over histograms, and forests of exact trees.

Rows stay packed in blocks (``plans/blocks.py``); absent entries of sparse rows are never stored. A tree is a few arrays.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textreg.plans.blocks import Block, Blocks, Fit, Local
from textreg.plans.stage import release_shuffles, write_stage

#: Most cuts of a feature in boosting, and rows of a node that one task splits down to its leaves.
CUTS, NODE_ROWS = 256, 50_000
#: Cells of a task's sums over nodes, and entries of rows that may be on their way between tasks at a time, when a forest splits nodes.
NODE_CELLS, MOVED_ENTRIES = 1 << 21, 1 << 25
#: Entries of rows in cells that are put together, and trees after which their margins are renewed.
JOINED, RENEWED = 1 << 22, 10
#: A node splits only where the objective gains more than this.
LEAST_GAIN = 1e-6


@dataclass
class Tree:
    """Nodes as arrays: a row goes left where its value is at most ``threshold``, or, if absent, where ``absent_left``; feature -1 is a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    absent_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, columns: np.ndarray, x: np.ndarray, present: np.ndarray) -> np.ndarray:
        """The node where each row ends, for dense rows whose features are at ``columns``."""
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            moving = self.feature[at] >= 0
            if not moving.any():
                return at
            r, n = rows[moving], at[moving]
            column = columns[self.feature[n]]
            low = np.where(present[r, column], x[r, column] <= self.threshold[n], self.absent_left[n])
            at[moving] = np.where(low, self.left[n], self.right[n])


class _Growing:
    """Nodes of a tree under construction."""

    def __init__(self):
        self.feature, self.threshold, self.absent_left, self.left, self.right, self.value = [], [], [], [], [], []

    def node(self, value: float) -> int:
        for array, x in zip((self.feature, self.threshold, self.absent_left, self.left, self.right), (-1, 0.0, False, -1, -1), strict=True):
            array.append(x)
        self.value.append(value)
        return len(self.value) - 1

    def split(self, node: int, feature: int, threshold: float, absent_left: bool, values: tuple[float, float]) -> tuple[int, int]:
        self.feature[node], self.threshold[node], self.absent_left[node] = feature, threshold, absent_left
        self.left[node], self.right[node] = self.node(values[0]), self.node(values[1])
        return self.left[node], self.right[node]

    def tree(self) -> Tree:
        return Tree(
            np.array(self.feature, np.int64), np.array(self.threshold, float), np.array(self.absent_left, bool),
            np.array(self.left, np.int64), np.array(self.right, np.int64), np.array(self.value, float),
        )


def _distinct(x: np.ndarray, present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Each row once, and the place of every row among them; the rows as they are, if fewer than half repeat or they are wide."""
    if 0 < x.shape[1] <= 16:
        _, first, back = np.unique(np.concatenate([x, present], axis=1), axis=0, return_index=True, return_inverse=True)
        if 2 * len(first) <= len(x):
            return x[first], present[first], back.ravel()
    return x, present, None


@dataclass(frozen=True)
class TreeModel:
    """``base`` plus the sum of the trees' values, or, for a forest, their mean."""

    trees: tuple[Tree, ...]
    base: float
    mean: bool

    def predict(self, block: Block) -> np.ndarray:
        used = np.unique(np.concatenate([t.feature[t.feature >= 0] for t in self.trees] or [np.zeros(0, np.int64)]))
        columns = np.full(max(int(used.max(initial=-1)), int(block.indices.max(initial=-1))) + 1, -1, np.int64)
        columns[used] = np.arange(len(used))
        out = np.zeros(len(block.y))
        marked = Block(block.starts, block.indices, np.ones(len(block.values)), block.y, block.labels, block.row)
        for (a, b, x), (_, _, present) in zip(block.dense(columns, len(used)), marked.dense(columns, len(used)), strict=True):
            x, present, back = _distinct(x, present > 0)
            found = np.zeros(len(x))
            for tree in self.trees:
                found += tree.value[tree.leaves(columns, x, present)]
            out[a:b] = found if back is None else found[back]
        return self.base + (out / max(len(self.trees), 1) if self.mean else out)

    def prediction(self, column: str = "features") -> Column:
        """The prediction for a vector column, in Arrow batches."""

        @F.arrow_udf("double")
        def predict(vector: pa.Array) -> pa.Array:
            indices, values = vector.field("indices"), vector.field("values")
            lengths = np.asarray(values.value_lengths().fill_null(0))
            place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            place[np.repeat(np.asarray(indices.is_valid()), lengths)] = indices.flatten().to_numpy()
            n = len(vector)
            block = Block(
                np.concatenate([[0], np.cumsum(lengths)]), place, values.flatten().to_numpy(zero_copy_only=False).astype(float),
                np.zeros(n), np.zeros((n, 1), np.int32), np.arange(n),
            )
            return pa.array(self.predict(block), mask=~np.asarray(values.is_valid()))

        return predict(F.unwrap_udt(column))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.prediction())


def _held_errors(block: Block, payload) -> list[np.ndarray]:
    fit, model = payload
    block = block.some(np.flatnonzero(block.trains([fit], 0, len(block.y))[:, 0] == 0))
    error = model.predict(block) - block.y
    return [np.array([len(error), error @ error, block.y.sum(), block.y @ block.y])]


def held_errors(blocks: Blocks | Local, fit: Fit, model: TreeModel) -> np.ndarray:
    """Number of rows left out of the fit, their squared errors, targets and squared targets, summed."""
    if fit.label is None:
        return np.zeros(4)
    return blocks.total(_held_errors, (fit, model), [(4,)])[0]


# ---- second-order boosting ----


def feature_cuts(rows: DataFrame, most: int = CUTS, column: str = "features", kept: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cut points of every feature, as (feature, value) in order: its distinct values, or where it has more than ``most``, those at which its
    rows pass another ``most``-th of their weight.

    Every row weighs its curvature, which is 1 for squared errors. Counts per value are reduced before they are ranked, a feature's values are
    ranked by a running sum, and at most ``most`` values per feature come to the driver; with ``kept``, only those of the features named.
    """
    v = F.unwrap_udt(column)
    places = F.coalesce(v["indices"], F.transform(F.sequence(F.lit(0), F.size(v["values"]) - 1), lambda i: i.cast("int")))
    entries = F.explode_outer(F.when(F.size(v["values"]) > 0, F.arrays_zip(places.alias("f"), v["values"].alias("x"))))
    stored = rows.filter(F.col(column).isNotNull() & F.col("y").isNotNull()).select(entries.alias("e")).filter("e IS NOT NULL")
    stored = stored.select(F.col("e").getField("f").alias("f"), F.col("e").getField("x").alias("x"))
    if kept is not None:
        named = rows.sparkSession.createDataFrame(pa.table({"f": pa.array(sorted({int(f) for f in kept}), pa.int32())}))
        stored = stored.join(F.broadcast(named), "f", "left_semi")
    counted = stored.groupBy("f", "x").agg(F.count("*").alias("n"))
    run = Window.partitionBy("f").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("f")
    ranked = counted.select(
        "f", "x", F.coalesce(F.sum("n").over(run), F.lit(0)).alias("before"), "n", F.sum("n").over(whole).alias("total"), F.count("*").over(whole).alias("values")
    )
    share = F.floor(F.col("before") * most / F.col("total"))
    starts = F.coalesce(share > F.lag(share).over(Window.partitionBy("f").orderBy("x")), F.lit(True))
    kept = ranked.withColumn("starts", starts).filter((F.col("values") <= most) | F.col("starts")).select("f", "x").toArrow().sort_by([("f", "ascending"), ("x", "ascending")])
    return kept.column("f").to_numpy().astype(np.int64), kept.column("x").to_numpy()


@dataclass
class _Cells:
    """The cuts as one line of cells: cell k holds the values of ``feature[k]``, the ``column[k]``-th, from ``low[k]`` to before the next cell's."""

    feature: np.ndarray
    low: np.ndarray
    first: np.ndarray
    last: np.ndarray
    column: np.ndarray

    @staticmethod
    def of(feature: np.ndarray, low: np.ndarray, kept: Sequence[int] | None) -> _Cells:
        if kept is not None:
            some = np.isin(feature, np.asarray(kept, np.int64))
            feature, low = feature[some], low[some]
        change = np.flatnonzero(np.diff(feature)) + 1
        bounds = np.concatenate([[0], change, [len(feature)]])
        sizes = np.diff(bounds)
        return _Cells(feature, low, np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:] - 1, sizes), np.repeat(np.arange(len(sizes)), sizes))

    def threshold(self, cell: int) -> float:
        """The largest value that lies in the cell or before."""
        return float(np.nextafter(self.low[cell + 1], -np.inf)) if cell < self.last[cell] else np.inf


@dataclass
class _Rows:
    """Training rows in cells: those that lie in the same cells are one, with their number, the sum of their targets and their margin so far.

    ``cell`` has a row each and a column per feature, or, where features may be absent, an entry per stored value, of the rows in ``row``.
    """

    weight: np.ndarray
    target: np.ndarray
    margin: np.ndarray
    cell: np.ndarray
    row: np.ndarray | None

    @staticmethod
    def of(block: Block, fit: Fit, cells: _Cells) -> _Rows:
        block = block.some(np.flatnonzero(block.trains([fit], 0, len(block.y))[:, 0] > 0))
        n = len(block.y)
        row = np.repeat(np.arange(n), np.diff(block.starts))
        order = np.lexsort((block.values, block.indices))
        # Entries and cells are merged in order of (feature, value); a cell comes before its equals.
        feature = np.concatenate([cells.feature, block.indices[order]])
        value = np.concatenate([cells.low, block.values[order]])
        kind = np.concatenate([np.zeros(len(cells.low), np.int8), np.ones(len(order), np.int8)])
        by = np.lexsort((kind, value, feature))
        cell = np.cumsum(kind[by] == 0)[kind[by] == 1] - 1
        known = cell >= 0
        known[known] = cells.feature[cell[known]] == block.indices[order][known]
        row, cell = row[order][known].astype(np.int32), cell[known].astype(np.int32)
        width = int(cells.column.max(initial=-1)) + 1
        found = _Rows(np.ones(n), block.y.astype(float), np.zeros(n), cell, row)
        if width and (np.bincount(row, minlength=n) == width).all():
            found.cell, found.row = cell[np.lexsort((cell, row))].reshape(n, width), None
        return found

    def folded(self) -> _Rows:
        if self.row is not None or not len(self.weight):
            return self
        line = np.ascontiguousarray(self.cell).view([("", self.cell.dtype)] * self.cell.shape[1]).ravel() if self.cell.shape[1] > 1 else self.cell[:, 0]
        _, first, at = np.unique(line, return_index=True, return_inverse=True)
        if 2 * len(first) > len(line):
            return self
        k = len(first)
        return _Rows(
            np.bincount(at, weights=self.weight, minlength=k), np.bincount(at, weights=self.target, minlength=k), self.margin[first], self.cell[first], None
        )

    def nodes(self, tree: _Coded, cells: _Cells) -> np.ndarray:
        at = np.zeros(len(self.weight), np.int64)
        if self.row is None:
            rows = np.arange(len(at))
            while True:
                cell = tree.cell[at]
                rows = rows[cell[rows] >= 0]
                if not len(rows):
                    return at
                here = cell[rows]
                at[rows] = np.where(self.cell[rows, cells.column[here]] <= here, tree.left[at[rows]], tree.right[at[rows]])
        first = np.where(tree.cell >= 0, cells.first[tree.cell], -1)
        last = np.where(tree.cell >= 0, cells.last[tree.cell], -1)
        while (tree.cell[at] >= 0).any():
            node = at[self.row]
            mine = (tree.cell[node] >= 0) & (self.cell >= first[node]) & (self.cell <= last[node])
            low = tree.absent_left[at]
            low[self.row[mine]] = self.cell[mine] <= tree.cell[node[mine]]
            at = np.where(tree.cell[at] < 0, at, np.where(low, tree.left[at], tree.right[at]))
        return at

    def margins(self, trees: list, rate: float, cells: _Cells) -> np.ndarray:
        margin = self.margin
        for tree in trees:
            margin = margin + rate * tree.value[self.nodes(tree, cells)]
        return margin


def _joined(parts: list[_Rows]) -> _Rows:
    if len(parts) == 1:
        return parts[0]
    return _Rows(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("weight", "target", "margin", "cell")), None)


def _code(fit: Fit, cells: _Cells):
    """Blocks as rows in cells; those of one task are put together up to ``JOINED`` entries."""

    def run(blocks: Iterator[Block]) -> Iterator[_Rows]:
        held: list[_Rows] = []
        for block in blocks:
            rows = _Rows.of(block, fit, cells).folded()
            if rows.row is not None:
                yield rows
                continue
            held.append(rows)
            if sum(r.cell.size for r in held) >= JOINED:
                whole = _joined(held).folded()
                held = [whole]
                if 2 * whole.cell.size >= JOINED:
                    yield whole
                    held = []
        if held:
            yield _joined(held).folded()

    return run


def _advance(trees: list, rate: float, cells: _Cells):
    def run(parts: Iterator[_Rows]) -> Iterator[_Rows]:
        for rows in parts:
            rows.margin = rows.margins(trees, rate, cells)
            yield rows

    return run


@dataclass
class _Coded:
    """A tree whose thresholds are cells."""

    cell: np.ndarray
    absent_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def _histogram(rows: _Rows, payload) -> list[np.ndarray]:
    """Gradient and curvature sums of the chosen nodes: per cell, and in all."""
    trees, rate, base, tree, slots, cells = payload
    n_slots, n_cells = int(slots.max()) + 1, len(cells.low)
    slot = slots[rows.nodes(tree, cells)]
    gradient = rows.weight * (base + rows.margins(trees, rate, cells)) - rows.target
    inside = slot >= 0
    if rows.row is None:
        width = rows.cell.shape[1]
        key = (slot[inside, None] * n_cells + rows.cell[inside]).ravel()
        g, h = (np.repeat(x[inside], width) for x in (gradient, rows.weight))
    else:
        some = inside[rows.row]
        at = rows.row[some]
        key, g, h = slot[at] * n_cells + rows.cell[some], gradient[at], rows.weight[at]
    return [
        np.bincount(key, weights=g, minlength=n_slots * n_cells), np.bincount(key, weights=h, minlength=n_slots * n_cells),
        np.bincount(slot[inside], weights=gradient[inside], minlength=n_slots), np.bincount(slot[inside], weights=rows.weight[inside], minlength=n_slots),
    ]


def _mean(block: Block, fit: Fit) -> list[np.ndarray]:
    train = block.trains([fit], 0, len(block.y))[:, 0]
    return [np.array([train.sum(), train @ block.y])]


def boost(
    blocks: Blocks | Local, fit: Fit, cuts: tuple[np.ndarray, np.ndarray], trees: int = 100, depth: int = 6, rate: float = 0.3,
    penalty: float = 1.0, least_weight: float = 1.0,
) -> TreeModel:
    """Second-order boosting of squared errors.

    Rows are put in cells once, with the sum of the trees so far, which is renewed every ``RENEWED`` trees. Per level one pass sums gradients and curvatures of each node's smaller child by cell; its sibling's are the parent's less these. A split
    maximizes ``G_l^2 / (H_l + penalty) + G_r^2 / (H_r + penalty)`` over cells and over the side that absent entries take; a leaf is worth ``-G / (H + penalty)``. Ties go
    to the lower feature and the higher cut. It starts from the mean target.
    """
    cells = _Cells.of(*cuts, fit.features)
    bare = Fit(fit.label, fit.held)
    (sums,) = blocks.total(_mean, bare, [(2,)])
    base = float(sums[1] / sums[0]) if sums[0] else 0.0
    rows = blocks.derive(_code(bare, cells))
    news, final = [], []
    n_cells = len(cells.low)
    for _ in range(trees):
        grown = _Growing()
        grown.node(0.0)
        cell_of = [-1]
        open_nodes, parents = [0], {}
        for level in range(depth):
            if not open_nodes or not n_cells:
                break
            # Of two siblings, the one with less curvature is summed.
            summed = [x for x in open_nodes if x not in parents or parents[x][2]]
            slots = np.full(len(cell_of), -1, np.int64)
            slots[summed] = np.arange(len(summed))
            now = _Coded(*map(np.array, (cell_of, grown.absent_left, grown.left, grown.right, grown.value)))
            k = len(summed)
            payload = (news, rate, base, now, slots, cells)
            g, h, g_all, h_all = rows.total(_histogram, payload, [(k * n_cells,), (k * n_cells,), (k,), (k,)])
            found = {x: (g[i * n_cells : (i + 1) * n_cells], h[i * n_cells : (i + 1) * n_cells], g_all[i], h_all[i]) for i, x in enumerate(summed)}
            for x in open_nodes:
                if x not in found:
                    above, sibling, _ = parents[x]
                    found[x] = tuple(a - b for a, b in zip(above, found[sibling], strict=True))
            following, parents = [], {}
            for x in open_nodes:
                split = _best_cell(*found[x], cells, penalty, least_weight)
                if split is None:
                    continue
                cell, absent_left, (gl, hl), (gr, hr) = split
                left, right = grown.split(
                    x, int(cells.feature[cell]), cells.threshold(cell), absent_left, (-gl / (hl + penalty), -gr / (hr + penalty))
                )
                cell_of[x] = cell
                cell_of += [-1, -1]
                parents[left], parents[right] = (found[x], right, hl <= hr), (found[x], left, hl > hr)
                following += [left, right]
            if level == 0 and not following:
                root_g, root_h = found[0][2], found[0][3]
                grown.value[0] = -root_g / (root_h + penalty)
            open_nodes = following
        if not n_cells:
            break
        news.append(_Coded(*map(np.array, (cell_of, grown.absent_left, grown.left, grown.right, grown.value))))
        if len(final) + 1 < trees and (isinstance(rows, Local) or len(news) == RENEWED):
            before, rows = rows, rows.derive(_advance(news, rate, cells))
            before.drop()
            news = []
        tree = grown.tree()
        tree.value = tree.value * rate
        final.append(tree)
    rows.drop()
    return TreeModel(tuple(final), base, mean=False)


def _best_cell(g: np.ndarray, h: np.ndarray, g_all: float, h_all: float, cells: _Cells, penalty: float, least: float):
    """Cell, side of absent entries and sums of both sides of the best split of a node, or nothing."""
    runs = []
    for x in (g, h):
        total = np.cumsum(x)
        runs.append(total - (total[cells.first] - x[cells.first]))
    gl, hl = runs
    g_here, h_here = gl[cells.last], hl[cells.last]
    best = None
    for absent_left in (False, True):
        left_g, left_h = (gl + (g_all - g_here), hl + (h_all - h_here)) if absent_left else (gl, hl)
        right_g, right_h = g_all - left_g, h_all - left_h
        valid = (left_h >= least - 1e-9) & (right_h >= least - 1e-9)
        gain = np.where(valid, left_g**2 / (left_h + penalty) + right_g**2 / (right_h + penalty), -np.inf)
        top = gain.max(initial=-np.inf)
        if top - g_all**2 / (h_all + penalty) <= LEAST_GAIN or (best is not None and top <= best[0] * (1 + 1e-12)):
            continue
        level = np.flatnonzero(gain >= top - abs(top) * 1e-12)
        # The lowest feature, and of its equal cuts the highest.
        cell = int(level[cells.feature[level] == cells.feature[level[0]]][-1])
        best = (top, cell, absent_left, (left_g[cell], left_h[cell]), (right_g[cell], right_h[cell]))
    return None if best is None else best[1:]


# ---- exact trees and forests ----

# The distribution function of a Poisson variable of mean 1.
_POISSON = np.cumsum([np.exp(-1.0) / f for f in (1, 1, 2, 6, 24, 120, 720, 5040, 40320, 362880, 3628800)])


def drawn(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree's bootstrap draws each row: Poisson numbers from a hash of seed, tree and row, wherever the row lies."""
    with np.errstate(over="ignore"):
        z = row.astype(np.uint64) + np.uint64((seed * 1_000_003 + tree + 1) % 2**63) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) / 2.0**53, side="right").astype(float)


def _one_block(blocks: list[Block]) -> Block:
    if len(blocks) == 1:
        return blocks[0]
    counts = np.concatenate([np.diff(b.starts) for b in blocks])
    return Block(
        np.concatenate([[0], np.cumsum(counts)]), *(np.concatenate([getattr(b, c) for b in blocks]) for c in ("indices", "values", "y", "labels", "row"))
    )


def _values(block: Block, kept: Sequence[int] | None) -> tuple[np.ndarray, ...]:
    """Stored entries but zeros, as (row, value number) by value number, and the values: feature and value of each number, in order, and the number of a feature's zero."""
    if "values" not in block.kept:
        row = np.repeat(np.arange(len(block.y)), np.diff(block.starts))
        some = block.values != 0
        if kept is not None:
            some &= np.isin(block.indices, np.asarray(kept, np.int64))
        row, feature, value = row[some], block.indices[some].astype(np.int64), block.values[some]
        features = np.unique(feature)
        every = np.concatenate([feature, features]), np.concatenate([value, np.zeros(len(features))])
        order = np.lexsort((every[1], every[0]))
        f, v = every[0][order], every[1][order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (v[1:] != v[:-1])
        number = np.empty(len(f), np.int64)
        number[order] = np.cumsum(new) - 1
        zero = np.zeros(int(features.max(initial=-1)) + 1, np.int64)
        zero[features] = number[len(feature) :]
        by = np.argsort(number[: len(feature)], kind="stable")
        block.kept["values"] = row[by], number[: len(feature)][by], f[new], v[new], zero
    return block.kept["values"]


def _columns(block: Block, kept: Sequence[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Features, their values in a line per feature, and the rows in the order of each; nothing, unless every row stores every feature."""
    if "columns" not in block.kept:
        n = len(block.y)
        width = int(block.starts[1]) if n else 0
        found = None
        if width and (np.diff(block.starts) == width).all() and np.isfinite(block.values).all():
            listed = block.indices.reshape(n, width)
            if (listed == listed[0]).all() and (np.diff(listed[0]) > 0).all():
                some = np.arange(width) if kept is None else np.flatnonzero(np.isin(listed[0], np.asarray(kept, np.int64)))
                x = np.ascontiguousarray(block.values.reshape(n, width)[:, some].T)
                order = np.empty(x.shape, np.int32)
                for k in range(len(some)):
                    order[k] = np.argsort(x[k], kind="stable")
                found = listed[0][some].astype(np.int64), x, order
        block.kept["columns"] = found
    return block.kept["columns"]


def _gains(x: np.ndarray, order: np.ndarray, weight: np.ndarray, wy: np.ndarray, starts: np.ndarray, sizes: np.ndarray, w: np.ndarray, s: np.ndarray):
    """What a split behind each row is worth, for rows of one feature in the order of node and value, with the weight and target up to it. ``w`` and ``s`` are the sums of
    the node of each row."""
    value, own_w, own_s = x[order], weight[order], wy[order]
    left_w, left_s = np.cumsum(own_w), np.cumsum(own_s)
    left_w -= np.repeat(left_w[starts] - own_w[starts], sizes)
    left_s -= np.repeat(left_s[starts] - own_s[starts], sizes)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / left_w + (s - left_s) ** 2 / (w - left_w)
    gain[:-1][value[1:] <= value[:-1]] = -np.inf
    gain[starts + sizes - 1] = -np.inf
    return gain, value, left_w, left_s


def _full_tree(found: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray) -> Tree:
    """``exact_tree`` of rows that store every feature: the rows of a level lie in the order of node and value, feature by feature."""
    features, x, order = found
    grown = _Growing()
    total = weight.sum()
    grown.node(float(weight @ y / total) if total else 0.0)
    wy = weight * y
    node_of = np.where(weight > 0, 0, -1).astype(np.int32)
    names = np.array([0])
    lines = list(order)
    while len(names):
        k = len(names)
        inside = np.flatnonzero(node_of >= 0)
        at = node_of[inside]
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        np.minimum.at(low, at, y[inside])
        np.maximum.at(high, at, y[inside])
        # Nodes are numbered anew without those whose targets are equal.
        uneven = low < high
        number = np.append(np.where(uneven, np.cumsum(uneven) - 1, -1), -1).astype(np.int32)
        node_of, names = number[node_of], names[uneven]
        k = len(names)
        if not k:
            break
        inside = np.flatnonzero(node_of >= 0)
        at = node_of[inside]
        sizes = np.bincount(at, minlength=k)
        starts = np.cumsum(sizes) - sizes
        node_w, node_s = (np.bincount(at, weights=c[inside], minlength=k) for c in (weight, wy))
        w, s = np.repeat(node_w, sizes), np.repeat(node_s, sizes)
        top = np.full((len(features), k), -np.inf)
        for j in range(len(features)):
            line, node = lines[j], node_of[lines[j]]
            if len(line) > len(inside):
                live = node >= 0
                line, node = line[live], node[live]
            # A stable sort by node, in linear time for 16 bits, keeps the order of values.
            lines[j] = line[np.argsort(node.astype(np.uint16) if k < 1 << 16 else node, kind="stable")]
            top[j] = np.maximum.reduceat(_gains(x[j], lines[j], weight, wy, starts, sizes, w, s)[0], starts)
        best = top.max(axis=0, initial=-np.inf)
        least = best - np.abs(best) * 1e-12
        with np.errstate(invalid="ignore"):
            chosen = np.where(np.isfinite(best), np.argmax(top >= least, axis=0), -1)
        threshold, sums = np.zeros(k), np.zeros((k, 2))
        for j in np.unique(chosen[chosen >= 0]).tolist():
            mine = np.flatnonzero(chosen == j)
            size = sizes[mine]
            upto = np.cumsum(size)
            first = upto - size
            places = np.repeat(starts[mine] - first, size) + np.arange(upto[-1])
            gain, value, left_w, left_s = _gains(x[j], lines[j][places], weight, wy, first, size, w[places], s[places])
            near = np.flatnonzero(gain >= np.repeat(least[mine], size))
            c = near[np.unique(np.repeat(np.arange(len(mine)), size)[near], return_index=True)[1]]
            middle = (value[c] + value[c + 1]) / 2
            threshold[mine] = np.where((value[c] <= middle) & (middle < value[c + 1]), middle, value[c])
            right_w, right_s = node_w[mine] - left_w[c], node_s[mine] - left_s[c]
            sums[mine] = np.stack([left_s[c] / left_w[c], right_s / right_w], axis=1)
        children, following = np.full(k, -1), []
        for n in np.flatnonzero(chosen >= 0).tolist():
            children[n] = len(following)
            following += grown.split(int(names[n]), int(features[chosen[n]]), float(threshold[n]), bool(threshold[n] >= 0), (float(sums[n, 0]), float(sums[n, 1])))
        above = x[chosen[at], inside] > threshold[at]
        node_of[inside] = np.where(chosen[at] >= 0, children[at] + above, -1)
        names = np.array(following, np.int64)
    return grown.tree()


def exact_tree(block: Block, weight: np.ndarray, kept: Sequence[int] | None = None) -> Tree:
    """A tree grown until the rows of a leaf have one target or equal features.

    Entries are kept sorted by (feature, value), absent ones are zeros. All nodes of a level are split together: running sums of weight and
    target along each (node, feature) give the squared error of every split between two neighbouring values; ties go to the lower feature and value.
    Rows that store every feature are taken feature by feature (``_full_tree``).
    """
    full = _columns(block, kept)
    if full is not None:
        return _full_tree(full, block.y, weight)
    row, number, feature, value, zero = _values(block, kept)
    grown = _Growing()
    drawn_rows = weight > 0
    total = weight.sum()
    grown.node(float(weight @ block.y / total) if total else 0.0)
    node_of = np.where(drawn_rows, 0, -1)
    wy = weight * block.y
    names = np.array([0])
    live = drawn_rows[row]
    row, number = row[live], number[live]
    n_values = max(len(feature), 1)
    while len(names):
        k = len(names)
        inside = node_of >= 0
        node_w, node_s = (np.bincount(node_of[inside], weights=x[inside], minlength=k) for x in (weight, wy))
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        np.minimum.at(low, node_of[inside], block.y[inside])
        np.maximum.at(high, node_of[inside], block.y[inside])
        node_of = np.where(inside & (low < high)[np.maximum(node_of, 0)], node_of, -1)
        live = node_of[row] >= 0
        row, number = row[live], number[live]
        if not len(row):
            break
        # Entries are in the order of values; a stable sort by node, in linear time for 16 bits, keeps it.
        by = np.argsort(node_of[row].astype(np.uint16 if k < 1 << 16 else np.int64), kind="stable")
        in_order = row[by]
        key = node_of[in_order] * n_values + number[by]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        key = key[starts]
        w, s = (np.add.reduceat(x[in_order], starts) for x in (weight, wy))
        group = key // n_values * len(zero) + feature[key % n_values]
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        groups = group[starts]
        rest_w = node_w[groups // len(zero)] - np.add.reduceat(w, starts)
        rest_s = node_s[groups // len(zero)] - np.add.reduceat(s, starts)
        some = rest_w > 0.5
        key = np.concatenate([key, groups[some] // len(zero) * n_values + zero[groups[some] % len(zero)]])
        order = np.argsort(key, kind="stable")
        key, w, s = key[order], np.concatenate([w, rest_w[some]])[order], np.concatenate([s, rest_s[some]])[order]
        node, f, v = key // n_values, feature[key % n_values], value[key % n_values]
        first = np.ones(len(key), bool)
        first[1:] = (node[1:] != node[:-1]) | (f[1:] != f[:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
        left_w, left_s = (np.cumsum(x) for x in (w, s))
        left_w, left_s = left_w - (left_w - w)[start], left_s - (left_s - s)[start]
        right_w, right_s = node_w[node] - left_w, node_s[node] - left_s
        splits = np.append(~first[1:], False)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(splits, left_s**2 / left_w + right_s**2 / right_w, -np.inf)
        bounds = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        top = np.full(k, -np.inf)
        top[node[bounds]] = np.maximum.reduceat(gain, bounds)
        near = np.flatnonzero(splits & (gain >= (top - np.abs(top) * 1e-12)[node]))
        chosen = near[np.unique(node[near], return_index=True)[1]] if len(near) else near
        split_feature, threshold = np.full(k, -1), np.zeros(k)
        children = np.full((k, 2), -1)
        following = []
        for c in chosen.tolist():
            at = (v[c] + v[c + 1]) / 2
            at = at if v[c] <= at < v[c + 1] else v[c]
            x = int(node[c])
            pair = grown.split(
                int(names[x]), int(f[c]), float(at), bool(at >= 0), (float(left_s[c] / left_w[c]), float(right_s[c] / right_w[c]))
            )
            split_feature[x], threshold[x] = f[c], at
            children[x] = len(following), len(following) + 1
            following += pair
        x = np.zeros(len(block.y))
        e_node = node_of[row]
        mine = feature[number] == split_feature[e_node]
        x[row[mine]] = value[number[mine]]
        at = np.maximum(node_of, 0)
        node_of = np.where((node_of >= 0) & (split_feature[at] >= 0), children[at, (x > threshold[at]).astype(int)], -1)
        names = np.array(following, np.int64)
    return grown.tree()


def running_sums(cells: DataFrame, keys: list[str], order: str, sums: list[str]) -> DataFrame:
    """Add ``left_<c>``, the sum of each of ``sums`` up to the row, and ``after``, the next ``order`` value, within ``keys``.

    Rows are range-partitioned by keys and order, so a key's rows may lie in many partitions: sums run within each, and the totals of the
    partitions before are added. No task sorts a whole key.
    """
    ranged = cells.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
    stored = write_stage(ranged.withColumn("part", F.spark_partition_id()), "ranged")
    parts = stored.groupBy(*keys, "part").agg(*[F.sum(c).alias(f"part_{c}") for c in sums], F.min(order).alias("low"))
    by_part = Window.partitionBy(*keys).orderBy("part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *keys, "part", *[F.coalesce(F.sum(f"part_{c}").over(before), F.lit(0.0)).alias(f"before_{c}") for c in sums],
        F.lead("low").over(by_part).alias("next_low"),
    )
    here = Window.partitionBy(*keys, "part").orderBy(order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    found = stored.join(offsets, [*keys, "part"])
    return found.select(
        *cells.columns, *[(F.col(f"before_{c}") + F.sum(c).over(upto)).alias(f"left_{c}") for c in sums],
        F.coalesce(F.lead(order).over(here), "next_low").alias("after"),
    )


def _gain() -> Column:
    right_w, right_s = F.col("all_w") - F.col("left_w"), F.col("all_s") - F.col("left_s")
    return F.col("left_s") ** 2 / F.col("left_w") + right_s**2 / right_w - F.col("all_s") ** 2 / F.col("all_w")


def _rank(gain: Column) -> Column:
    """One number of 12 digits orders the gains alike on any number of partitions; then the lower feature and value."""
    rounded = F.format_string("%.11e", F.greatest(gain, F.lit(0.0))).cast("double")
    return F.struct(rounded, (-F.col("feature")).alias("f"), (-F.col("value")).alias("v"))


def best_splits(cells: DataFrame, nodes: DataFrame) -> DataFrame:
    """The best split of every node: ``node, feature, value, after, left_w, left_s, gain``, from ``cells(node, feature, value, w, s)``.

    ``w`` and ``s`` are weight and weighted target of the rows of a node with a value; values of 0 may be left out. ``nodes(node, all_w, all_s)`` holds the
    nodes' sums. ``gain`` is what a split between ``value`` and the next value takes from the sum of squares; of equal ones
    (to 12 digits of the node's spread) the lowest feature and value is chosen. Nodes without two values of any feature have no row.
    """
    summed = cells.groupBy("node", "feature", "value").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    held = summed.groupBy("node", "feature").agg(F.sum("w").alias("some_w"), F.sum("s").alias("some_s"))
    zeros = held.join(nodes, "node").filter(F.col("all_w") - F.col("some_w") > 0.5).select(
        "node", "feature", F.lit(0.0).alias("value"), (F.col("all_w") - F.col("some_w")).alias("w"), (F.col("all_s") - F.col("some_s")).alias("s")
    )
    every = summed.unionByName(zeros).groupBy("node", "feature", "value").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    run = running_sums(every, ["node", "feature"], "value", ["w", "s"]).filter("after IS NOT NULL").join(nodes, "node")
    scored = run.select("node", "feature", "value", "after", "left_w", "left_s", _gain().alias("gain"))
    best = scored.groupBy("node").agg(F.max_by(F.struct("feature", "value", "after", "left_w", "left_s", "gain"), _rank(F.col("gain"))).alias("b"))
    return best.select("node", "b.*")


@dataclass
class _Spans:
    """The line of values of each feature, cut into spans: span k holds values from ``low[k]`` to before the next one's, the spans of ``feature[j]`` begin at ``start[j]``."""

    feature: np.ndarray
    low: np.ndarray
    start: np.ndarray

    def of(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The span of each value; features are in order, those without spans get -1."""
        out = np.full(len(value), -1, np.int64)
        a, b = (np.searchsorted(feature, self.feature, side=side) for side in ("left", "right"))
        for j in np.flatnonzero(b > a).tolist():
            low = self.low[self.start[j] : self.start[j + 1]]
            out[a[j] : b[j]] = self.start[j] + np.maximum(np.searchsorted(low, value[a[j] : b[j]], side="right") - 1, 0)
        return out

    def zeros(self) -> np.ndarray:
        return self.of(self.feature, np.zeros(len(self.feature)))


def _spans(blocks: Blocks, kept: Sequence[int] | None) -> _Spans:
    """Spans of about equal numbers of stored entries. Where they are cut makes no difference to a tree."""

    def entries(parts: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for block in parts:
            _, number, feature, value, _ = _values(block, kept)
            yield pa.RecordBatch.from_arrays([pa.array(feature[number]), pa.array(value[number])], names=["feature", "value"])

    shares = [k / CUTS for k in range(1, CUTS)]
    found = blocks.over(entries, "feature bigint, value double").groupBy("feature").agg(F.percentile_approx("value", shares, 10 * CUTS).alias("cuts"))
    rows = sorted((r["feature"], np.unique(r["cuts"])) for r in found.collect())
    return _Spans(
        np.array([f for f, _ in rows], np.int64), np.concatenate([np.zeros(0), *(c for _, c in rows)]), np.concatenate([[0], np.cumsum([len(c) for _, c in rows])]).astype(np.int64)
    )


def _drawn_slots(block: Block, shared) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each tree with open nodes, the slot of each row, or -1, and its weight."""
    fit, trees, open_slots, seed, bootstrap = shared
    train = block.trains([fit], 0, len(block.y))[:, 0]
    for t, slot_of, where in _open_rows(block, fit, trees, open_slots):
        weight = train * (drawn(block.row, t, seed) if bootstrap else 1)
        yield np.where(weight > 0, slot_of[where], -1), weight


def _span_sums(shared, kept, n_slots: int):
    """Weight, target and squared target per (node, span) of a task's rows, a record per node."""

    def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        payload, spans = shared.value
        n = len(spans.low)
        total = np.zeros((3, n_slots * n))
        for block in blocks:
            row, number, feature, value, _ = _values(block, kept)
            span = spans.of(feature, value)[number]
            for slot, weight in _drawn_slots(block, payload):
                some = slot[row] >= 0
                at = row[some]
                key = slot[at] * n + span[some]
                for out, x in zip(total, (weight, weight * block.y, weight * block.y**2), strict=True):
                    out += np.bincount(key, weights=x[at], minlength=len(out))
        for x in range(n_slots):
            here = total[:, x * n : (x + 1) * n]
            if here[0].any():
                yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([here.tobytes()], pa.binary())], names=["node", "sums"])

    return run


def _likely_spans(spans: _Spans, w_all: np.ndarray, s_all: np.ndarray, ss_all: np.ndarray):
    """Of each node, the spans in which its best split may lie, with the weight and target of all rows below them, and the zeros of each feature.

    Splits at the ends of spans give a least gain. Inside a span the target on the left strays from a line by at most half the root of weight times spread, which
    bounds the gain of every split there; spans whose bound is below the least gain are left out.
    """

    def run(table: pa.Table) -> pa.Table:
        x = table.column("node")[0].as_py()
        w, s, ss = np.sum([np.frombuffer(p.as_py()).reshape(3, -1) for p in table.column("sums")], axis=0)
        a, t, tt = w_all[x], s_all[x], ss_all[x]
        first = spans.start[:-1]
        zero_w, zero_s, zero_ss = (every - np.add.reduceat(part, first) for every, part in ((a, w), (t, s), (tt, ss)))
        some = zero_w > 0.5
        at = spans.zeros()[some]
        w[at] += zero_w[some]
        s[at] += zero_s[some]
        ss[at] += np.maximum(zero_ss[some], 0)
        begins = np.repeat(first, np.diff(spans.start))
        upto_w, upto_s = (np.cumsum(c) for c in (w, s))
        below_w, below_s = ((c - part) - (c - part)[begins] for c, part in ((upto_w, w), (upto_s, s)))
        left_w, left_s = below_w + w, below_s + s
        with np.errstate(divide="ignore", invalid="ignore"):
            off = [np.abs(part_s - part_w * (t / a)) for part_w, part_s in ((below_w, below_s), (left_w, left_s))]
            ends = (left_w > 0.5) & (a - left_w > 0.5)
            least = np.where(ends, off[1] ** 2 * a / (left_w * (a - left_w)), 0).max(initial=0)
            spread = np.maximum(ss - s * s / w, 0) + 1e-10 * tt
            low, high = np.maximum(below_w, 1), np.minimum(left_w, a - 1)
            most = (np.maximum(*off) + np.sqrt(w * spread) / 2) ** 2 * a / np.minimum(low * (a - low), high * (a - high))
            likely = np.flatnonzero((w > 0.5) & ~(most < least * (1 - 1e-9) - 1e-10 * tt))
        lists = likely, below_w[likely], below_s[likely], np.where(some, zero_w, 0), np.where(some, zero_s, 0)
        return pa.table({"node": [x], "entries": [float(w[likely].sum())], **{c: pa.array([v.tobytes()], pa.binary()) for c, v in zip(_LIKELY, lists, strict=True)}})

    return run


_LIKELY = ("spans", "below_w", "below_s", "zero_w", "zero_s")


def _span_values(shared, kept):
    """Weight and target per (node, span, value) of the rows of each block that lie in the spans named."""

    def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        payload, spans, likely = shared.value
        for block in blocks:
            row, number, feature, value, _ = _values(block, kept)
            span = spans.of(feature, value)
            for slot, weight in _drawn_slots(block, payload):
                some = slot[row] >= 0
                some[some] = likely[slot[row[some]], span[number[some]]]
                at = row[some]
                key, back = np.unique(slot[at] * max(len(feature), 1) + number[some], return_inverse=True)
                if len(key):
                    place = key % len(feature)
                    w, s = (np.bincount(back, weights=x[at]) for x in (weight, weight * block.y))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key // len(feature)), pa.array(span[place]), pa.array(feature[place]), pa.array(value[place]), pa.array(w), pa.array(s)],
                        names=["node", "span", "feature", "value", "w", "s"],
                    )

    return run


def _next_values(shared, kept):
    """Per block, the least value of a node's feature beyond the value named."""

    def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        payload, feature, value = shared.value
        columns = np.full(int(feature.max()) + 1, -1, np.int64)
        columns[np.unique(feature)] = np.arange(len(np.unique(feature)))
        for block in blocks:
            wide = np.full(max(len(columns), int(block.indices.max(initial=-1)) + 1), -1, np.int64)
            wide[: len(columns)] = columns
            slots = [slot for slot, _ in _drawn_slots(block, payload)]
            least = np.full(len(feature), np.inf)
            for a, b, x in block.dense(wide, len(np.unique(feature))):
                for slot in slots:
                    rows = np.flatnonzero(slot[a:b] >= 0)
                    at = slot[a:b][rows]
                    here = x[rows, columns[feature[at]]]
                    beyond = here > value[at]
                    np.minimum.at(least, at[beyond], here[beyond])
            found = np.flatnonzero(least < np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(least[found])], names=["node", "after"])

    return run


def _split_nodes(blocks: Blocks, kept, spans: _Spans, payload, w: np.ndarray, s: np.ndarray, ss: np.ndarray) -> list[tuple[int, int, float, float]]:
    """``node, feature, value, after`` of the best split of each node in the slots of ``payload``, as ``best_splits`` finds it.

    Sums per span come first and bound the gains in it; only entries of spans that may hold the best split are sorted by value.
    """
    spark, n = blocks.spark, len(w)
    sums = blocks.over(_span_sums(spark.sparkContext.broadcast((payload, spans)), kept, n), "node bigint, sums binary")
    named = ", ".join(f"{c} binary" for c in _LIKELY)
    found = sums.groupBy("node").applyInArrow(_likely_spans(spans, w, s, ss), f"node bigint, entries double, {named}").collect()
    zero_span = spans.zeros()
    best: list[tuple[int, int, float]] = []
    for part in _batches(found, [r["entries"] for r in found]):
        likely = np.zeros((n, len(spans.low)), bool)
        known: list[list[np.ndarray]] = []
        for r in part:
            x = r["node"]
            here, below_w, below_s, zero_w, zero_s = (np.frombuffer(r[c], np.int64 if c == "spans" else np.float64) for c in _LIKELY)
            likely[x, here] = True
            zeros = np.flatnonzero((zero_w > 0.5) & likely[x, zero_span])
            feature = spans.feature[np.searchsorted(spans.start, here, side="right") - 1]
            known.append([np.full(len(here), x), here, feature, np.full(len(here), -np.inf), below_w, below_s])
            known.append([np.full(len(zeros), x), zero_span[zeros], spans.feature[zeros], np.zeros(len(zeros)), zero_w[zeros], zero_s[zeros]])
        shared = spark.sparkContext.broadcast((payload, spans, likely))
        schema = "node bigint, span bigint, feature bigint, value double, w double, s double"
        values = blocks.over(_span_values(shared, kept), schema)
        # What lies below a span comes as a first row of it.
        given = spark.createDataFrame(pa.table([np.concatenate(c) for c in zip(*known, strict=True)], names=values.columns), schema)
        each = values.unionByName(given).groupBy("node", "span", "feature", "value").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
        upto = Window.partitionBy("node", "span").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        nodes = spark.createDataFrame([(r["node"], float(w[r["node"]]), float(s[r["node"]])) for r in part], "node bigint, all_w double, all_s double")
        run = each.select("node", "feature", "value", *[F.sum(c).over(upto).alias(f"left_{c}") for c in ("w", "s")]).join(F.broadcast(nodes), "node")
        run = run.filter((F.col("value") > F.lit(-np.inf)) & (F.col("all_w") - F.col("left_w") > 0.5))
        chosen = run.groupBy("node").agg(F.max_by(F.struct("feature", "value"), _rank(_gain())).alias("b"))
        best += [(r["node"], r["b"]["feature"], r["b"]["value"]) for r in chosen.collect()]
        shared.unpersist()
        del values, given, each, run, chosen
        release_shuffles(spark)
    if not best:
        return []
    feature, value = np.zeros(n, np.int64), np.full(n, np.inf)
    for x, f, v in best:
        feature[x], value[x] = f, v
    after = blocks.over(_next_values(spark.sparkContext.broadcast((payload, feature, value)), kept), "node bigint, after double").groupBy("node").agg(F.min("after"))
    next_value = dict(map(tuple, after.collect()))
    return [(x, f, v, next_value[x]) for x, f, v in sorted(best)]


def _batches(items: list, sizes: list, most: float | None = None) -> Iterator[list]:
    """The items in their order, as many at a time as stay within ``most``, one at least."""
    most = MOVED_ENTRIES if most is None else most
    held, total = [], 0
    for item, size in zip(items, sizes, strict=True):
        if held and total + size > most:
            yield held
            held, total = [], 0
        held.append(item)
        total += size
    if held:
        yield held


def _open_rows(block: Block, fit: Fit, trees: dict[int, Tree], open_slots: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each tree with open nodes, the slots of its nodes and the node of each row."""
    for t, slot_of in open_slots.items():
        tree = trees[t]
        used = np.unique(tree.feature[tree.feature >= 0])
        columns = np.full(max(int(used.max(initial=-1)), int(block.indices.max(initial=-1))) + 1, -1, np.int64)
        columns[used] = np.arange(len(used))
        where = np.concatenate([tree.leaves(columns, x, np.ones(x.shape, bool)) for _, _, x in block.dense(columns, len(used))])
        yield t, slot_of, where


def _slot_sums(block: Block, payload) -> list[np.ndarray]:
    fit, trees, open_slots, seed, bootstrap, n_slots = payload
    out = np.zeros((4, n_slots))
    train = block.trains([fit], 0, len(block.y))[:, 0]
    for t, slot_of, where in _open_rows(block, fit, trees, open_slots):
        weight = train * (drawn(block.row, t, seed) if bootstrap else 1)
        slot = np.where(weight > 0, slot_of[where], -1)
        some = slot >= 0
        for k, x in enumerate((weight, weight * block.y, weight * block.y**2, np.ones(len(weight)))):
            out[k] += np.bincount(slot[some], weights=x[some], minlength=n_slots)
    return [out]


def _node_rows(shared):
    def run(blocks: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            for slot, weight in _drawn_slots(block, shared.value):
                for x in np.unique(slot[slot >= 0]).tolist():
                    rows = np.flatnonzero(slot == x)
                    sent = pickle.dumps((_narrow(block.some(rows)), weight[rows].astype(np.float32)))
                    yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([sent], pa.binary())], names=["node", "rows"])

    return run


def _narrow(block: Block) -> Block:
    """The block in fewer bytes: values as floats of 32 bits where that loses nothing, and the features of full rows not listed."""
    short = block.values.astype(np.float32)
    values = short if (short == block.values).all() else block.values
    width = int(block.starts[1]) if len(block.y) else 0
    full = width and len(block.indices) == width * len(block.y) and (block.indices.reshape(-1, width) == np.arange(width)).all()
    return Block(block.starts, block.indices[:0] if full else block.indices, values, block.y, block.labels[:, :0], block.row)


def _widened(block: Block) -> Block:
    full = len(block.indices) < len(block.values)
    indices = np.tile(np.arange(int(block.starts[1]), dtype=np.int32), len(block.y)) if full else block.indices
    return Block(block.starts, indices, block.values.astype(np.float64), block.y, block.labels, block.row)


def _finish(kept):
    def run(table: pa.Table) -> pa.Table:
        parts = [pickle.loads(p.as_py()) for p in table.column("rows")]
        parts.sort(key=lambda p: int(p[0].row[0]))
        tree = exact_tree(_one_block([_widened(p) for p, _ in parts]), np.concatenate([w for _, w in parts]).astype(np.float64), kept)
        return pa.table({"node": table.column("node").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return run


def forest(blocks: Blocks | Local, fit: Fit, trees: int = 100, bootstrap: bool = True, seed: int = 42, least_spread: float = 1e-14) -> TreeModel:
    """Exact trees, each on its own bootstrap of the rows; predictions are their means.

    Nodes of more than ``NODE_ROWS`` rows are split level by level, many trees together: sums per span of values tell where the best split can lie, and only entries there
    are shuffled and sorted by value (``_split_nodes``); the split is that of all values. The rows of smaller nodes meet in a task, which grows the rest of the branch.
    Nodes take turns, so that no more than ``MOVED_ENTRIES`` entries, or those of one node, are on their way at a time, whatever the number of trees. No
    depth limit; a tree has as many leaves as its rows need, and the trees are kept on the driver.
    """
    if isinstance(blocks, Local):
        block = _one_block(blocks.blocks) if blocks.blocks else None
        if block is None or not block.trains([fit], 0, len(block.y)).any():
            return TreeModel((), 0.0, mean=True)
        if len(blocks.blocks) > 1:
            blocks.blocks = [block]
        block.kept.clear()
        train = block.trains([fit], 0, len(block.y))[:, 0]
        return TreeModel(
            tuple(exact_tree(block, train * (drawn(block.row, t, seed) if bootstrap else 1), fit.features) for t in range(trees)), 0.0, mean=True
        )
    bare, kept = Fit(fit.label, fit.held), fit.features
    growing = {t: _Growing() for t in range(trees)}
    for g in growing.values():
        g.node(0.0)
    open_nodes = [(t, 0) for t in range(trees)]
    spark, spans = blocks.spark, None
    while open_nodes:
        partial = {t: growing[t].tree() for t in {t for t, _ in open_nodes}}
        n = len(open_nodes)
        ((w, s, ss, rows),) = blocks.total(_slot_sums, (bare, partial, _slots(partial, open_nodes), seed, bootstrap, n), [(4, n)])
        for k, (t, x) in enumerate(open_nodes):
            growing[t].value[x] = float(s[k] / w[k]) if w[k] else 0.0
        # A node whose targets are equal is a leaf.
        spread = ss - np.where(w > 0, s * s / np.maximum(w, 1), 0)
        uneven = spread > least_spread * np.maximum(ss, 1e-300)
        # Nodes of like size go together: a batch waits for its largest.
        small = sorted((k for k in range(n) if uneven[k] and rows[k] <= NODE_ROWS), key=lambda k: -rows[k])
        large = [k for k in range(n) if uneven[k] and rows[k] > NODE_ROWS]
        following = []
        entries = blocks.entries / max(blocks.n_rows, 1)
        for batch in _batches(small, [rows[k] * entries for k in small]):
            some = [open_nodes[k] for k in batch]
            shared = spark.sparkContext.broadcast((bare, partial, _slots(partial, some), seed, bootstrap))
            # A task for each node: bytes do not tell how long a branch takes.
            dealt = blocks.over(_node_rows(shared), "node bigint, rows binary").repartition(len(batch), "node")
            for node, tree in dealt.groupBy("node").applyInArrow(_finish(kept), "node bigint, tree binary").collect():
                _graft(growing[some[node][0]], some[node][1], pickle.loads(tree))
            shared.unpersist()
            del dealt
            release_shuffles(spark)
        if large and spans is None:
            spans = _spans(blocks, kept)
        for batch in _batches(large, [len(spans.low) for _ in large] if large else [], NODE_CELLS):
            some = [open_nodes[k] for k in batch]
            payload = (bare, partial, _slots(partial, some), seed, bootstrap)
            for node, feature, value, after in _split_nodes(blocks, kept, spans, payload, w[batch], s[batch], ss[batch]) if len(spans.low) else []:
                t, x = some[node]
                at = (value + after) / 2
                at = at if value <= at < after else value
                following += [(t, child) for child in growing[t].split(x, feature, at, at >= 0, (0.0, 0.0))]
        open_nodes = following
    return TreeModel(tuple(growing[t].tree() for t in range(trees)), 0.0, mean=True)


def _slots(trees: dict[int, Tree], nodes: list[tuple[int, int]]) -> dict[int, np.ndarray]:
    """Per tree the place of each of its nodes in the list, or -1."""
    out = {t: np.full(len(trees[t].value), -1, np.int64) for t, _ in nodes}
    for k, (t, x) in enumerate(nodes):
        out[t][x] = k
    return out


def _graft(grown: _Growing, node: int, branch: Tree) -> None:
    places = {0: node}
    grown.value[node] = float(branch.value[0])
    for x in range(len(branch.value)):
        if branch.feature[x] >= 0:
            pair = (float(branch.value[branch.left[x]]), float(branch.value[branch.right[x]]))
            left, right = grown.split(places[x], int(branch.feature[x]), float(branch.threshold[x]), bool(branch.absent_left[x]), pair)
            places[int(branch.left[x])], places[int(branch.right[x])] = left, right
