"""Boosted and exact trees against plain versions, in tasks and pass by pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textreg.operators import models as M
from textreg.operators import trees as T
from textreg.plans import blocks as B
from textreg.plans.blocks import Block, Blocks, Fit


def sample(n=140, d=9, seed=3):
    """Counts with many absent entries, one real-valued column with negative values, and repeated rows."""
    r = np.random.default_rng(seed)
    x = np.where(r.random((n, d)) < 0.4, r.integers(1, 5, size=(n, d)), 0).astype(float)
    x[:, 4] = r.normal(size=n).round(2)
    y = np.where(x[:, 1] > 1, 3.0, -1.0) + 0.7 * x[:, 4] + 0.3 * r.normal(size=n)
    x[20:30] = x[:10]
    return x, y


def as_rows(spark, x, y, parts=4):
    rows = []
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        kept = np.flatnonzero(a)
        rows.append((i, float(b), [int(j) for j in kept], [float(v) for v in a[kept]], x.shape[1], i % 3))
    schema = "row_index bigint, y double, embedding_indices array<bigint>, embedding_values array<double>, embedding_size int, fold int"
    return M.with_sparse_vectors(spark.createDataFrame(rows, schema)).repartition(parts)


@pytest.fixture(params=["tasks", "passes"])
def way(request, monkeypatch):
    if request.param == "passes":
        monkeypatch.setattr(B, "SENT_BYTES", -1)
        monkeypatch.setattr(B, "DIRECT", 2)
        monkeypatch.setattr(T, "NODE_ROWS", 30)


def plain_boost(x, y, trees, depth, rate=0.3, penalty=1.0):
    """Trees as nested tuples, trying every cut and both sides for absent entries."""
    base = y.mean()
    margin = np.full(len(y), base)
    out = []

    def grow(rows, left):
        g, h = (margin[rows] - y[rows]).sum(), len(rows)
        leaf = rate * -g / (h + penalty)
        best = (1e-6, None)
        for j in range(x.shape[1] if left else 0):
            col = x[rows, j]
            for absent_left in (False, True):
                for cut in np.unique(x[:, j][x[:, j] != 0]):
                    low = np.where(col != 0, col <= cut, absent_left)
                    a, b = rows[low], rows[~low]
                    if not len(a) or not len(b):
                        continue
                    ga, gb = (margin[a] - y[a]).sum(), (margin[b] - y[b]).sum()
                    gain = ga**2 / (len(a) + penalty) + gb**2 / (len(b) + penalty) - g**2 / (h + penalty)
                    if gain > best[0] + 1e-9:
                        best = (gain, (j, cut, absent_left, a, b))
        if best[1] is None:
            return leaf
        j, cut, absent_left, a, b = best[1]
        return (j, cut, absent_left, grow(a, left - 1), grow(b, left - 1))

    def value(tree, row):
        while isinstance(tree, tuple):
            j, cut, absent_left, a, b = tree
            tree = a if (row[j] <= cut if row[j] else absent_left) else b
        return tree

    for _ in range(trees):
        tree = grow(np.arange(len(y)), depth)
        out.append(tree)
        margin = margin + np.array([value(tree, row) for row in x])
    return margin


def test_boosting_against_trying_every_cut(spark, way):
    x, y = sample()
    rows = as_rows(spark, x, y)
    fitted = M.fit_model(rows, "GradientBoosting", "sparse", trees=3, depth=3)
    got = [r["prediction"] for r in fitted.transform(rows).orderBy("row_index").collect()]
    assert np.allclose(got, plain_boost(x, y, 3, 3), atol=1e-9)


def test_boosting_folds_and_renews(spark, monkeypatch):
    """Equal rows count as one with their weight, and margins renewed every two trees are those of all trees."""
    r = np.random.default_rng(5)
    x = r.integers(1, 4, size=(300, 2)).astype(float)
    y = x[:, 0] * x[:, 1] + r.normal(size=300)
    rows = as_rows(spark, x, y)
    monkeypatch.setattr(T, "RENEWED", 2)
    cuts = T.feature_cuts(rows)
    with Blocks(rows, []) as blocks:
        coded = blocks.derive(T._code(Fit(), T._Cells.of(*cuts, None)))
        sizes = coded.total(lambda part, _: [np.array([len(part.weight), part.weight.sum(), part.target.sum()])], None, [(3,)])[0]
        coded.drop()
        passes = T.boost(blocks, Fit(), cuts, trees=7, depth=3)
    assert sizes[0] <= 9 * 4 and sizes[1] == 300 and np.isclose(sizes[2], y.sum())
    got = [r["prediction"] for r in passes.transform(rows).orderBy("row_index").collect()]
    assert np.allclose(got, plain_boost(x, y, 7, 3), atol=1e-9)


def test_cuts_of_kept_features(spark):
    rows = as_rows(spark, *sample())
    feature, low = T.feature_cuts(rows)
    some, kept = T.feature_cuts(rows, kept=[7, 2])
    assert set(some) == {2, 7} and kept.tolist() == low[np.isin(feature, [2, 7])].tolist()


def test_cuts_of_many_values(spark):
    """Up to the limit all values, beyond it those that pass another share of the rows."""
    x = np.zeros((1000, 2))
    x[:, 0], x[:, 1] = np.arange(1000) // 3 + 1, np.arange(1000) % 7 + 1
    feature, low = T.feature_cuts(as_rows(spark, x, np.zeros(1000)), most=16)
    assert low[feature == 1].tolist() == [1, 2, 3, 4, 5, 6, 7]
    cuts = low[feature == 0]
    assert len(cuts) == 16 and cuts[0] == 1 and all(abs(int((x[:, 0] < c).sum()) - k * 62.5) <= 3 for k, c in enumerate(cuts))


def plain_tree(x, y, w):
    """Predictions of a tree grown to the end by trying every split."""
    out = np.zeros(len(y))

    def grow(rows):
        total = w[rows].sum()
        out_value = (w[rows] @ y[rows]) / total
        best = None
        if y[rows].min() < y[rows].max():
            for j in range(x.shape[1]):
                values = np.unique(x[rows, j])
                for a, b in zip(values[:-1], values[1:], strict=True):
                    low = x[rows, j] <= a
                    score = sum((w[r] @ y[r]) ** 2 / w[r].sum() for r in (rows[low], rows[~low]))
                    if best is None or score > best[0] * (1 + 1e-12):
                        best = (score, j, (a + b) / 2, rows[low], rows[~low])
        if best is None:
            return out_value
        return (best[1], best[2], grow(best[3]), grow(best[4]))

    tree = grow(np.flatnonzero(w > 0))
    for i, row in enumerate(x):
        at = tree
        while isinstance(at, tuple):
            at = at[2] if row[at[0]] <= at[1] else at[3]
        out[i] = at
    return out


@pytest.mark.parametrize("bootstrap", [True, False])
def test_forest_against_trying_every_split(spark, way, bootstrap):
    x, y = sample()
    rows = as_rows(spark, x, y)
    fitted = M.fit_model(rows, "RandomForest", "sparse", trees=3, bootstrap=bootstrap)
    got = [r["prediction"] for r in fitted.transform(rows).orderBy("row_index").collect()]
    weights = [T.drawn(np.arange(len(y)), t, 42) if bootstrap else np.ones(len(y)) for t in range(3)]
    assert np.allclose(got, np.mean([plain_tree(x, y, w) for w in weights], axis=0), atol=1e-9)


def test_draws_are_poisson_and_differ_between_trees():
    rows = np.arange(40_000)
    a, b = T.drawn(rows, 0, 42), T.drawn(rows, 1, 42)
    for d in (a, b):
        assert d.mean() == pytest.approx(1, abs=0.02) and (d == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)
    assert abs(np.corrcoef(a, b)[0, 1]) < 0.02


@pytest.mark.parametrize("model", ["RandomForest", "GradientBoosting"])
def test_a_fold_is_fitted_on_the_other_rows(spark, way, model):
    x, y = sample()
    rows = as_rows(spark, x, y).persist()
    cuts = T.feature_cuts(rows)
    fit = Fit(0, 1, (0, 1, 4, 5))
    with Blocks(rows, ["fold"]) as packed:
        (fitted, sums), = packed.each(M.tree_job, [(model, fit, cuts, {"trees": 3})])
    alone = rows.filter("fold != 1")
    with Blocks(alone, []) as packed:
        (same, _), = packed.each(M.tree_job, [(model, Fit(features=fit.features), cuts, {"trees": 3})])
    both = [[r["prediction"] for r in m.transform(rows).orderBy("row_index").collect()] for m in (fitted, same)]
    assert np.allclose(*both)
    held = np.arange(len(y)) % 3 == 1
    error = (np.array(both[0]) - y)[held]
    assert np.allclose(sums, [held.sum(), error @ error, y[held].sum(), y[held] @ y[held]])
    used = set(np.concatenate([t.feature for t in fitted.trees]).tolist())
    assert used <= {-1, 0, 1, 4, 5}


@pytest.mark.parametrize("model", ["RandomForest", "GradientBoosting"])
def test_trees_of_degenerate_rows(spark, way, model):
    schema = "row_index bigint, y double, embedding array<double>"
    for y, vectors in (([2.0], [[1.0]]), ([2.0] * 5, [[1.0]] * 5), ([1.0, 2.0], [[0.0], [0.0]]), ([1.0, 2.0], [[], []])):
        rows = [(i, a, v) for i, (a, v) in enumerate(zip(y, vectors, strict=True))]
        df = M.with_dense_vectors(spark.createDataFrame([*rows, (98, None, [1.0]), (99, 1.0, None)], schema))
        params = {"bootstrap": False} if model == "RandomForest" else {}
        fitted = M.fit_model(df, model, trees=2, **params)
        got = {r["row_index"]: r["prediction"] for r in fitted.transform(df).collect()}
        assert got[0] == pytest.approx(np.mean(y)) and got[99] is None


def test_best_splits_do_not_depend_on_partitions(spark):
    r = np.random.default_rng(1)
    cells = [(int(r.integers(3)), int(r.integers(4)), float(r.integers(-20, 20)), 1.0, float(r.normal())) for _ in range(600)]
    df = spark.createDataFrame(cells, "node bigint, feature bigint, value double, w double, s double")
    # A row has a value of every feature, but zeros may be left out.
    nodes = df.groupBy("node", "feature").agg(F.sum("w").alias("w"), F.sum("s").alias("s")).groupBy("node").agg(
        F.max("w").alias("all_w"), F.max("s").alias("all_s"))
    found = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(sorted(T.best_splits(df, nodes).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    for a, b in zip(*found, strict=True):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:])


def test_a_forest_moves_few_entries_of_large_nodes_and_few_nodes_at_a_time(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(6000, 3)), 4)
    y = np.round(3 * x[:, 0] + x[:, 1] ** 2 + r.normal(size=len(x)) / 10, 3)
    rows = as_rows(spark, x, y)
    monkeypatch.setattr(B, "SENT_BYTES", -1)
    monkeypatch.setattr(T, "NODE_ROWS", 2500)
    monkeypatch.setattr(T, "MOVED_ENTRIES", 3000, raising=False)
    moved, over = [], B.Blocks.over

    def counted(blocks, run, schema):
        out = over(blocks, run, schema)
        if schema.startswith("node") and "value double" in schema:
            moved.append(out.count())
        return out

    monkeypatch.setattr(B.Blocks, "over", counted)
    fitted = M.fit_model(rows, "RandomForest", "dense", trees=2)
    got = [p["prediction"] for p in fitted.transform(rows).orderBy("row_index").collect()]
    # Two roots of some 3,800 different rows of three features each.
    assert moved and sum(moved) < 6000 and max(moved) < 4500
    monkeypatch.undo()
    local = M.fit_model(rows, "RandomForest", "dense", trees=2)
    assert np.allclose(got, [p["prediction"] for p in local.transform(rows).orderBy("row_index").collect()], atol=1e-9)


def test_full_rows_grow_the_tree_of_stored_entries(monkeypatch):
    """Rows that store every feature are split feature by feature, into the very tree that entries give; others are not."""
    r = np.random.default_rng(4)
    for n, d, levels in ((1, 3, 2), (40, 1, 3), (300, 5, 4), (400, 6, 1000)):
        x = np.round(r.normal(size=(n, d)) * levels) / levels
        y = np.round(x[:, 0] * 3 + r.normal(size=n))
        block = Block(np.arange(n + 1) * d, np.tile(np.arange(d, dtype=np.int32), n), x.ravel(), y, np.zeros((n, 1), np.int32), np.arange(n))
        for weight in (np.ones(n), T.drawn(block.row, 3, 42), np.zeros(n)):
            for kept in (None, [0, d - 1]):
                block.kept.clear()
                assert T._columns(block, kept) is not None
                mine = T.exact_tree(block, weight, kept)
                block.kept.clear()
                with monkeypatch.context() as m:
                    m.setattr(T, "_columns", lambda *_: None)
                    plain = T.exact_tree(block, weight, kept)
                for c in ("feature", "threshold", "absent_left", "left", "right", "value"):
                    assert (getattr(mine, c) == getattr(plain, c)).all()
    absent = Block(np.array([0, 2, 3]), np.array([0, 1, 1], np.int32), np.ones(3), np.arange(2.0), np.zeros((2, 1), np.int32), np.arange(2))
    assert T._columns(absent, None) is None
