"""Regressors with the objectives of the usual single-node defaults."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from textreg.operators.linear import Centred, LinearFit, centred, elastic_nets, held_scores, least_squares, linear_fit
from textreg.operators.splits import kfold_labels
from textreg.operators.trees import TreeModel, boost, feature_cuts, forest, held_errors
from textreg.plans.blocks import Blocks, Fit, Local
from textreg.plans.stage import stage_path

SEED = 42


def with_sparse_vectors(rows: DataFrame, output: str = "features") -> DataFrame:
    """Sparse rows with an ML vector column instead of the index and value lists.

    A vector column is stored as a struct in parquet, so the rows are written as that struct and
    read back under the vector type: no row passes through Python.
    """
    struct = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.col("embedding_size").cast("int").alias("size"),
        F.transform("embedding_indices", lambda i: i.cast("int")).alias("indices"),
        F.transform("embedding_values", lambda v: v.cast("double")).alias("values"),
    )
    others = [c for c in rows.columns if c not in ("embedding_indices", "embedding_values", "embedding_size", output)]
    path = stage_path(rows.sparkSession, "vectors")
    stored = rows.select(*others, struct.alias(output))
    stored.write.parquet(path)
    fields = [StructField(f.name, f.dataType) for f in stored.schema if f.name != output]
    return rows.sparkSession.read.schema(StructType([*fields, StructField(output, VectorUDT())])).parquet(path)


def with_dense_vectors(rows: DataFrame, column: str = "embedding", output: str = "features") -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn(output, F.when(F.col(column).isNotNull(), array_to_vector(F.transform(F.coalesce(column, F.array()), lambda x: x.cast("double")))))


# Feature counts kept for sparse input: linear models and trees.
LINEAR_K, TREE_K = 5000, 4000
#: Objectives of the linear models: the default weight of the penalty, squared or absolute.
SQUARED, ABSOLUTE = {"LinearRegression": 0.0, "Ridge": 1.0}, {"Lasso": 0.001}
TREES = {"RandomForest": forest, "GradientBoosting": boost}
MODELS = [*SQUARED, *ABSOLUTE, *TREES]


def is_linear(model: str) -> bool:
    return model in SQUARED or model in ABSOLUTE


def check_model(model: str, storage: str) -> None:
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; use one of {sorted(MODELS)}")
    if storage not in ("sparse", "dense"):
        raise ValueError("storage must be 'sparse' or 'dense'")


def vector_width(rows: DataFrame, column: str = "features") -> int:
    vector = F.unwrap_udt(column)
    return rows.agg(F.max(F.coalesce(vector["size"], F.size(vector["values"])))).first()[0] or 0


def linear_weights(blocks: Blocks, c: Centred, alphas: dict[str, float]) -> dict[str, np.ndarray]:
    """Weights (fit, feature) of each named linear model at its penalty, over all fits of ``c`` at once."""
    out = {}
    squared = [m for m in alphas if m in SQUARED]
    if squared:
        found = least_squares(blocks, c, [alphas[m] for m in squared])
        out = {m: found[:, k] for k, m in enumerate(squared)}
    for m in alphas:
        if m in ABSOLUTE:
            out[m] = elastic_nets(blocks, c, [(j, alphas[m], 0.0) for j in range(len(c.fits))])
    return out


def linear_job(blocks: Blocks | Local, job: tuple) -> tuple[Centred, dict[str, np.ndarray], dict[str, list]]:
    """Moments, weights and scores of held rows of each model, for a list of fits."""
    fits, width, standardize, alphas = job
    c = centred(blocks, fits, width, standardize)
    found = linear_weights(blocks, c, alphas)
    every = [(m, k) for m in alphas for k in range(len(fits))]
    scored = held_scores(blocks, c, [k for _, k in every], np.stack([found[m][k] for m, k in every]))
    return c, found, {m: scored[i * len(fits) : (i + 1) * len(fits)] for i, m in enumerate(alphas)}


def linear_scores(blocks: Blocks | Local, job: tuple) -> dict[str, list]:
    """The scores of ``linear_job`` alone."""
    return linear_job(blocks, job)[2]


def penalty(model: str, params: dict) -> float:
    unknown = set(params) - ({"alpha"} if model != "LinearRegression" else set())
    if unknown:
        raise ValueError(f"{model} has no parameter {sorted(unknown)}")
    return params.get("alpha", (SQUARED | ABSOLUTE)[model])


def fit_linear(train: DataFrame, model: str, storage: str = "dense", selected: list[int] | None = None, **params) -> LinearFit:
    """Fit ``train(features, y)``.

    Least squares minimizes ``|y - Xw|^2`` with the least norm, ridge adds ``alpha |w|^2``, the lasso minimizes ``|y - Xw|^2 / 2n + alpha |w|_1``;
    the intercept is free of penalty. Sparse input: unit rows, then the selected features. Dense input: centred and scaled by the population deviation.
    """
    check_model(model, storage)
    dense = storage == "dense"
    job = ([Fit(features=None if selected is None else tuple(selected))], vector_width(train), dense, {model: penalty(model, params)})
    with Blocks(train, [], unit=not dense) as blocks:
        ((c, weights, _),) = blocks.each(linear_job, [job])
    return linear_fit(c, 0, weights[model][0], standardize=dense, unit=not dense)


def tree_job(blocks: Blocks | Local, job: tuple) -> tuple[TreeModel, np.ndarray]:
    """A fitted tree model and the sums over the rows it has left out. ``cuts`` are those of ``feature_cuts``, for boosting."""
    model, fit, cuts, params = job
    fitted = boost(blocks, fit, cuts, **params) if model == "GradientBoosting" else forest(blocks, fit, **params)
    return fitted, held_errors(blocks, Fit(fit.label, fit.held), fitted)


def tree_scores(blocks: Blocks | Local, job: tuple) -> np.ndarray:
    """The sums of ``tree_job`` without the trees, which have about as many leaves as rows."""
    return tree_job(blocks, job)[1]


def fit_trees(train: DataFrame, model: str, storage: str = "dense", selected: list[int] | None = None, **params) -> TreeModel:
    """Fit ``train(features, y)``: a forest of exact trees on bootstraps that see every feature at every split, or trees of depth 6 boosted with
    rate 0.3. Sparse input: the selected features as they are; absent entries are zeros to a forest and take a learned side in boosting."""
    check_model(model, storage)
    cuts = feature_cuts(train, kept=selected) if model == "GradientBoosting" else None
    fit = Fit(features=None if selected is None else tuple(selected))
    with Blocks(train, []) as blocks:
        ((fitted, _),) = blocks.each(tree_job, [(model, fit, cuts, params)])
    return fitted


def fit_model(
    train: DataFrame, model: str, storage: str = "dense", selected: list[int] | None = None, **params
) -> LinearFit | TreeModel:
    check_model(model, storage)
    return (fit_linear if is_linear(model) else fit_trees)(train, model, storage, selected, **params)


def elastic_net(train: DataFrame, alpha: float, l1_ratio: float) -> LinearFit:
    """Minimizes ``|y - Xw|^2 / 2n + alpha * l1_ratio * |w|_1 + alpha * (1 - l1_ratio) / 2 * |w|^2`` over features as they are."""
    with Blocks(train, []) as blocks:
        ((c, weights, _),) = blocks.each(elastic_job, [([Fit()], vector_width(train), [(0, alpha * l1_ratio, alpha * (1 - l1_ratio))])])
    return linear_fit(c, 0, weights[0], standardize=False, unit=False)


def elastic_job(blocks: Blocks | Local, job: tuple) -> tuple[Centred, np.ndarray, list]:
    """Moments, weights and scores of held rows for (fit, l1, l2) penalties."""
    fits, width, penalties = job
    c = centred(blocks, fits, width, standardize=False)
    weights = elastic_nets(blocks, c, penalties)
    return c, weights, held_scores(blocks, c, [j for j, _, _ in penalties], weights)


def elastic_net_cv(
    train: DataFrame, l1_ratios=(0.1, 0.5, 1.0), alphas=(0.1, 1.0, 10.0), folds: int = 5, row: str = "row_index", seed: int = SEED,
) -> tuple[LinearFit, DataFrame]:
    """Grid search of the elastic net by cross-validated squared error: best model and ``l1_ratio, alpha, mse`` per point.

    Folds are those of ``kfold_labels`` on ``row``. The error is the mean over folds; of equal points the first wins, and
    the best one is fitted again on all rows. All points and folds are fitted side by side, in the same passes.
    """
    fold = kfold_labels(train.select(row), row, folds, 1, seed)[0]
    grid = list(product(map(float, l1_ratios), map(float, alphas)))
    width = vector_width(train)
    points = [(alpha * l1, alpha * (1 - l1)) for l1, alpha in grid]
    with Blocks(train.select("features", "y", fold.alias("fold")), ["fold"]) as blocks:
        if blocks.small:
            jobs = [([Fit(0, k)], width, [(0, *p) for p in points]) for k in range(folds)]
        else:
            jobs = [([Fit(0, k) for k in range(folds)], width, [(k, *p) for k in range(folds) for p in points])]
        scored = [s for _, _, scores in blocks.each(elastic_job, jobs) for s in scores]
        errors = [[scored[k * len(grid) + i][0] for k in range(folds)] for i in range(len(grid))]
        means = [float(np.mean([e**2 for e in mine if e is not None])) for mine in errors]
        ((c, best, _),) = blocks.each(elastic_job, [([Fit()], width, [(0, *points[means.index(min(means))])])])
    table = train.sparkSession.createDataFrame(
        [(*point, mse) for point, mse in zip(grid, means, strict=True)], "l1_ratio double, alpha double, mse double"
    )
    return linear_fit(c, 0, best[0], standardize=False, unit=False), table


def coefficients(model: LinearFit) -> list[tuple[int, float]]:
    """``(feature, weight)`` of a fitted linear model, features numbered in the order they were kept; -1 is the intercept."""
    return [(-1, model.intercept), *((i, float(w)) for i, w in enumerate(model.weights))]
