"""Linear fits on rows of any number, many at a time: least squares, ridge, lasso and elastic net.

The rows stay packed in blocks (``plans/blocks.py``). Every fit has its own training rows and features, and one pass over the blocks serves all
fits. Vectors as long as the features are kept on the driver; features are a few thousand by selection.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textreg.plans.blocks import Block, Blocks, Fit, Local

#: Directions that a fit gains per pass, and the residual, relative to the first one, at which it ends.
DIRECTIONS, RESIDUAL = 16, 1e-11
#: Gap between the objective and its lower bound, relative to the target's mean square, at which a lasso ends.
GAP = 1e-8


@dataclass
class Centred:
    """Moments of each fit's training rows over the shared features, and the scale of each feature (0: left out)."""

    fits: list[Fit]
    columns: np.ndarray
    features: np.ndarray
    n: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    y_mean: np.ndarray
    yy: np.ndarray
    xy: np.ndarray


def _moments(block: Block, payload) -> list[np.ndarray]:
    fits, columns, width = payload
    n, y, yy = np.zeros(len(fits)), np.zeros(len(fits)), np.zeros(len(fits))
    x, xx, xy = (np.zeros((width, len(fits))) for _ in range(3))
    for a, b, rows in block.dense(columns, width):
        train = block.trains(fits, a, b)
        target = block.y[a:b]
        n += train.sum(axis=0)
        y += target @ train
        yy += (target * target) @ train
        x += rows.T @ train
        xx += (rows * rows).T @ train
        xy += rows.T @ (train * target[:, None])
    return [n, y, yy, x, xx, xy]


def centred(blocks: Blocks | Local, fits: Sequence[Fit], width: int, standardize: bool) -> Centred:
    """Means of features and target over the training rows of each fit; with ``standardize`` features are divided by their population deviation."""
    fits = list(fits)
    whole = any(f.features is None for f in fits)
    features = np.arange(width) if whole else np.unique(np.concatenate([np.asarray(f.features, np.int64) for f in fits]))
    columns = np.full(width, -1, np.int64)
    columns[features] = np.arange(len(features))
    u, k = len(features), len(fits)
    # Only the labels go to the tasks.
    bare = [replace(f, features=None) for f in fits]
    n, y, yy, x, xx, xy = blocks.total(_moments, (bare, columns, u), [(k,), (k,), (k,), (u, k), (u, k), (u, k)])
    at_least = np.maximum(n, 1)
    mean, y_mean = x / at_least, y / at_least
    variance = np.maximum(xx / at_least - mean**2, 0)
    flat = variance <= 1e-12 * xx / at_least
    scale = np.where(flat, 1.0 if standardize else 0.0, 1 / np.sqrt(np.where(flat, 1, variance)) if standardize else 1.0)
    for j, f in enumerate(fits):
        if f.features is not None:
            kept = np.zeros(u, bool)
            kept[columns[list(f.features)]] = True
            scale[~kept, j] = 0
    return Centred(bare, columns, features, n, mean, scale, y_mean, np.maximum(yy - n * y_mean**2, 0), scale * (xy - mean * y))


def _times(block: Block, payload) -> list[np.ndarray]:
    """Of each fit, the centred rows times some vectors, times the centred rows again."""
    fits, columns, width, vectors, shift, of = payload
    out, sums = np.zeros((width, vectors.shape[1])), np.zeros(vectors.shape[1])
    for a, b, rows in block.dense(columns, width):
        t = (rows @ vectors - shift) * block.trains(fits, a, b)[:, of]
        out += rows.T @ t
        sums += t.sum(axis=0)
    return [out, sums]


def _gram_times(blocks: Blocks | Local, c: Centred, chosen: list[int], vectors: list[np.ndarray]) -> list[np.ndarray]:
    """``X'X v`` of the chosen fits' scaled and centred features, each with its own vectors, in one pass."""
    of = np.repeat(np.arange(len(chosen)), [v.shape[1] for v in vectors])
    through = np.concatenate([c.scale[:, [j]] * v for j, v in zip(chosen, vectors, strict=True)], axis=1)
    mean, scale = c.mean[:, chosen][:, of], c.scale[:, chosen][:, of]
    shift = (mean * through).sum(axis=0)
    u = len(c.features)
    out, sums = blocks.total(_times, ([c.fits[j] for j in chosen], c.columns, u, through, shift, of), [(u, len(of)), (len(of),)])
    out = scale * (out - mean * sums)
    return [out[:, of == k] for k in range(len(chosen))]


def _new_directions(block: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``known``; directions lost to rounding are dropped."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):
        if known is not None:
            block = block - known @ (known.T @ block)
        basis, triangle = np.linalg.qr(block)
        turned, singular, _ = np.linalg.svd(triangle)
        block = basis @ turned[:, singular > 1e-9]
    return block


def least_squares(blocks: Blocks | Local, c: Centred, alphas: Sequence[float], seed: int = 42) -> np.ndarray:
    """Weights (fit, alpha, feature) minimizing ``|y - Xw|^2 + alpha |w|^2`` over scaled and centred features.

    A block Krylov method on the normal equations, without forming them: each pass multiplies ``DIRECTIONS`` directions of each fit by ``X'X``,
    the products give the next ones, and the solution is the best of their span. One span serves all alphas, as damping does not change
    it. All directions are products of ``X'``, so with alpha 0 the solution is that of least norm, also where features outnumber rows
    or repeat. It ends when the residual of the normal equations is ``RESIDUAL`` of the first, or the span holds all that the rows span.
    """
    k, u = len(c.fits), len(c.features)
    out = np.zeros((k, len(alphas), u))
    r = np.random.default_rng(seed)
    open_fits = [j for j in range(k) if np.linalg.norm(c.xy[:, j]) > 0]
    start = _gram_times(blocks, c, open_fits, [r.normal(size=(u, DIRECTIONS - 1)) for _ in open_fits]) if open_fits else []
    ahead = {j: _new_directions(np.concatenate([c.xy[:, [j]], g], axis=1), None) for j, g in zip(open_fits, start, strict=True)}
    span = {j: (np.zeros((u, 0)), np.zeros((u, 0))) for j in open_fits}
    looked = dict.fromkeys(open_fits, DIRECTIONS)
    while open_fits:
        products = _gram_times(blocks, c, open_fits, [ahead[j] for j in open_fits])
        left = []
        for j, product in zip(open_fits, products, strict=True):
            q, w = (np.concatenate(x, axis=1) for x in zip(span[j], (ahead[j], product), strict=True))
            following = _new_directions(product, q)
            ended = not following.shape[1] or q.shape[1] >= min(u, c.n[j])
            if ended or q.shape[1] >= 1.4 * looked[j]:
                looked[j] = q.shape[1]
                found, worst = _best_of_span(q, w, c.xy[:, j], alphas)
                out[j] = found
                ended = ended or worst <= RESIDUAL
            if ended:
                del span[j]
            else:
                span[j], ahead[j] = (q, w), following
                left.append(j)
        open_fits = left
    return out


def _best_of_span(q: np.ndarray, w: np.ndarray, b: np.ndarray, alphas: Sequence[float]) -> tuple[np.ndarray, float]:
    values, basis = np.linalg.eigh((q.T @ w + w.T @ q) / 2)
    found, worst = [], 0.0
    right = basis.T @ (q.T @ b)
    for alpha in alphas:
        real = values > 1e-13 * values[-1]
        z = basis @ np.where(real, right / np.where(real, values + alpha, 1), 0)
        found.append(q @ z)
        worst = max(worst, float(np.linalg.norm(b - w @ z - alpha * found[-1]) / np.linalg.norm(b)))
    return np.stack(found), worst


# ---- absolute penalties ----


def _gram_of(block: Block, payload) -> list[np.ndarray]:
    fits, columns, width, places = payload
    out = [np.zeros((len(p), len(p))) for p in places]
    for a, b, rows in block.dense(columns, width):
        train = block.trains(fits, a, b)
        for k, p in enumerate(places):
            mine = rows[train[:, k] > 0][:, p]
            out[k] += mine.T @ mine
    return out


def _descend(gram: np.ndarray, b: np.ndarray, w: np.ndarray, l1: float, l2: float, tolerance: float) -> np.ndarray:
    """Cyclic coordinate descent; sweeps over the weights that move, and over all when these rest.

    Once the signs are right the weights solve a linear system; its solution is taken if it keeps them, which spares many sweeps.
    """
    diagonal = gram.diagonal().copy()
    live = np.flatnonzero(diagonal > 0)
    w = np.where(diagonal > 0, w, 0.0)
    rest = b - gram @ w

    def sweep(some: np.ndarray) -> float:
        moved = 0.0
        for j in some.tolist():
            old = w[j]
            rho = rest[j] + diagonal[j] * old
            new = (rho - l1 if rho > l1 else rho + l1 if rho < -l1 else 0.0) / (diagonal[j] + l2)
            if new != old:
                rest[:] -= gram[j] * (new - old)
                w[j] = new
                moved = max(moved, abs(new - old) * diagonal[j] ** 0.5)
        return moved

    while sweep(live) > tolerance:
        active = np.flatnonzero(w)
        for _ in range(10):
            if not len(active) or sweep(active) <= tolerance:
                break
        active = np.flatnonzero(w)
        signs = np.sign(w[active])
        system = gram[np.ix_(active, active)] + l2 * np.eye(len(active))
        try:
            solved = np.linalg.solve(system, b[active] - l1 * signs)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(solved).all() and (np.sign(solved) == signs).all() and np.abs(system @ solved + l1 * signs - b[active]).max(initial=0) <= tolerance:
            w[active] = solved
            rest[:] = b - gram @ w
    return w


def elastic_nets(blocks: Blocks | Local, c: Centred, penalties: Sequence[tuple[int, float, float]]) -> np.ndarray:
    """Weights (penalty, feature) minimizing ``|y - Xw|^2 / 2n + l1 |w|_1 + l2 |w|^2 / 2`` for each (fit, l1, l2).

    Coordinate descent over working sets: a path of falling l1 leads to each penalty, and at each of its points features enter by the
    strong rule (their correlation with the residual exceeds 2 l1 less the l1 before) or because they violate the optimality conditions, which one pass
    checks for all features and penalties. Only the products between features of a working set are summed, each set in one
    pass. A fit ends when no feature violates them and its duality gap is at most ``GAP`` of the target's mean square.
    """
    u = len(c.features)
    n = np.maximum(c.n, 1)
    correlation = {j: c.xy[:, j] / n[j] for j in {j for j, _, _ in penalties}}
    out = np.zeros((len(penalties), u))
    path, gradient, sets, grams = [], [], [], []
    for j, l1, _ in penalties:
        top = float(np.abs(correlation[j]).max(initial=0.0))
        steps = 0 if top <= l1 else max(1, int(np.ceil(np.log2(top / max(l1, 1e-4 * top)))))
        path.append([*(top * (max(l1, 1e-4 * top) / top) ** (s / steps) for s in range(1, steps)), l1] if steps else [])
        gradient.append(correlation[j].copy())
        sets.append(np.zeros(0, np.int64))
        grams.append(np.zeros((0, 0)))
    before = [float(np.abs(correlation[j]).max(initial=0.0)) for j, _, _ in penalties]
    open_ones = [i for i, p in enumerate(path) if p]
    while open_ones:
        enter = {}
        for i in open_ones:
            l1 = path[i][0]
            strong = np.abs(gradient[i]) >= min(2 * l1 - before[i], l1)
            strong[sets[i]] = False
            strong &= c.scale[:, penalties[i][0]] > 0
            enter[i] = np.flatnonzero(strong)
        grown = [i for i in open_ones if len(enter[i])]
        for i in grown:
            sets[i] = np.concatenate([sets[i], enter[i]])
        if grown:
            for i, gram in zip(grown, _grams(blocks, c, [(penalties[i][0], sets[i]) for i in grown]), strict=True):
                grams[i] = gram
        weights = []
        for i in open_ones:
            j, _, l2 = penalties[i]
            s = sets[i]
            tolerance = 1e-8 * (c.yy[j] / n[j]) ** 0.5
            out[i, s] = _descend(grams[i], correlation[j][s], out[i, s], path[i][0], l2, tolerance)
            weights.append(out[i][:, None])
        products = _by_fit(blocks, c, [penalties[i][0] for i in open_ones], weights)
        left = []
        for i, product in zip(open_ones, products, strict=True):
            j, _, l2 = penalties[i]
            l1 = path[i][0]
            gradient[i] = correlation[j] - product / n[j] - l2 * out[i]
            outside = np.ones(u, bool)
            outside[sets[i]] = False
            outside &= c.scale[:, j] > 0
            if (np.abs(gradient[i][outside]) > l1 * (1 + 1e-9) + 1e-14).any():
                before[i] = l1
                left.append(i)
                continue
            before[i] = path[i].pop(0)
            if path[i]:
                left.append(i)
        open_ones = left
    return out


def _by_fit(blocks: Blocks | Local, c: Centred, of: list[int], weights: list[np.ndarray]) -> list[np.ndarray]:
    """``X'X w`` per penalty: the penalties of a fit share its pass."""
    fits = sorted(set(of))
    mine = {j: [k for k, f in enumerate(of) if f == j] for j in fits}
    found = _gram_times(blocks, c, fits, [np.concatenate([weights[k] for k in mine[j]], axis=1) for j in fits])
    out: list[np.ndarray] = [np.zeros(0)] * len(of)
    for j, products in zip(fits, found, strict=True):
        for at, k in enumerate(mine[j]):
            out[k] = products[:, at]
    return out


def _grams(blocks: Blocks | Local, c: Centred, wanted: list[tuple[int, np.ndarray]]) -> list[np.ndarray]:
    """Mean products between the chosen scaled and centred features of each fit. The sets of a fit are summed as one."""
    fits = sorted({j for j, _ in wanted})
    union = {j: np.unique(np.concatenate([s for k, s in wanted if k == j])) for j in fits}
    payload = ([c.fits[j] for j in fits], c.columns, len(c.features), [union[j] for j in fits])
    sums = dict(zip(fits, blocks.total(_gram_of, payload, [(len(union[j]),) * 2 for j in fits]), strict=True))
    out = []
    for j, s in wanted:
        at = np.searchsorted(union[j], s)
        mean, scale = c.mean[s, j], c.scale[s, j]
        out.append(scale[:, None] * (sums[j][np.ix_(at, at)] / max(c.n[j], 1) - np.outer(mean, mean)) * scale)
    return out


def duality_gaps(blocks: Blocks | Local, c: Centred, penalties: Sequence[tuple[int, float, float]], weights: np.ndarray) -> np.ndarray:
    """How far each objective is above its lower bound, relative to the target's mean square; for the elastic net, rows are extended by ``sqrt(n l2) I``."""
    products = _by_fit(blocks, c, [j for j, _, _ in penalties], [w[:, None] for w in weights])
    out = []
    for (j, l1, l2), w, product in zip(penalties, weights, products, strict=True):
        n = max(c.n[j], 1)
        b = c.xy[:, j] / n
        residual = max(c.yy[j] / n - 2 * b @ w + w @ product / n, 0.0) + l2 * w @ w
        gradient = np.where(c.scale[:, j] > 0, b - product / n - l2 * w, 0)
        shrink = min(1.0, l1 / max(np.abs(gradient).max(initial=0.0), 1e-300))
        # With the residual r (rows extended), the dual point is shrink * r, and y r = yy - b w.
        dual = shrink * (c.yy[j] / n - b @ w) - shrink**2 * residual / 2
        out.append((residual / 2 + l1 * np.abs(w).sum() - dual) / max(c.yy[j] / n, 1e-300))
    return np.array(out)


# ---- fitted models ----


@dataclass(frozen=True)
class LinearFit:
    """``intercept + sum(weights * (x - centre) * scale)`` over ``features``; with ``unit``, rows are first scaled to length 1.

    ``weights`` belong to the scaled features. For rows that are scaled, ``intercept`` is the mean target; else ``centre`` is 0.
    """

    features: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    centre: np.ndarray
    intercept: float
    unit: bool = False

    def prediction(self, column: str = "features") -> Column:
        """The prediction for a vector column, computed from its stored entries in Arrow batches."""
        width = int(self.features.max(initial=-1)) + 1
        by_feature = np.zeros(width)
        by_feature[self.features] = self.weights * self.scale
        base = self.intercept - float(np.sum(self.weights * self.scale * self.centre))
        unit = self.unit

        @F.arrow_udf("double")
        def predict(vector: pa.Array) -> pa.Array:
            indices, values = vector.field("indices"), vector.field("values")
            lengths = np.asarray(values.value_lengths().fill_null(0))
            flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            place[np.repeat(np.asarray(indices.is_valid()), lengths)] = indices.flatten().to_numpy()
            row = np.repeat(np.arange(len(vector)), lengths)
            known = place < width
            total = np.bincount(row[known], weights=flat[known] * by_feature[place[known]], minlength=len(vector))
            if unit:
                length = np.sqrt(np.bincount(row, weights=flat * flat, minlength=len(vector)))
                total /= np.where(length > 0, length, 1.0)
            return pa.array(base + total, mask=~np.asarray(values.is_valid()))

        return predict(F.unwrap_udt(column))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.prediction())


def linear_fit(c: Centred, j: int, weights: np.ndarray, standardize: bool, unit: bool) -> LinearFit:
    kept = np.flatnonzero(c.scale[:, j] > 0) if c.fits[j].features is None else np.searchsorted(c.features, c.fits[j].features)
    scale = c.scale[kept, j]
    if standardize:
        return LinearFit(c.features[kept], weights[kept], scale, c.mean[kept, j], float(c.y_mean[j]), unit)
    intercept = float(c.y_mean[j] - c.mean[kept, j] @ weights[kept])
    return LinearFit(c.features[kept], weights[kept], np.ones(len(kept)), np.zeros(len(kept)), intercept, unit)


def _held_scores(block: Block, payload) -> list[np.ndarray]:
    fits, columns, width, weights, base, of = payload
    out = np.zeros((4, weights.shape[1]))
    for a, b, rows in block.dense(columns, width):
        error = rows @ weights + base - block.y[a:b, None]
        held = 1 - block.trains(fits, a, b)[:, of]
        y = block.y[a:b, None]
        out += np.stack([held.sum(axis=0), (held * error**2).sum(axis=0), (held * y).sum(axis=0), (held * y * y).sum(axis=0)])
    return [out]


def held_scores(blocks: Blocks | Local, c: Centred, of: Sequence[int], weights: np.ndarray) -> list[tuple[float, float]]:
    """Root mean squared error and r2 of each row of ``weights`` on the rows its fit ``of`` has left out, in one pass."""
    through = np.stack([w * c.scale[:, j] for w, j in zip(weights, of, strict=True)], axis=1)
    base = np.array([c.y_mean[j] - c.mean[:, j] @ through[:, k] for k, j in enumerate(of)])
    payload = (c.fits, c.columns, len(c.features), through, base, np.asarray(of))
    (sums,) = blocks.total(_held_scores, payload, [(4, len(of))])
    return [scores_from_sums(*s) for s in sums.T]


def scores_from_sums(n: float, errors: float, y: float, yy: float) -> tuple[float | None, float | None]:
    """rmse and r2 from the number of rows and the sums of squared errors, targets and squared targets."""
    if not n:
        return None, None
    spread = yy - y * y / n
    return float((errors / n) ** 0.5), float(1 - errors / spread) if spread > 0 else None
