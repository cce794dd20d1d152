"""Feature scores, scaling and regressors against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textreg.operators import experiment as X
from textreg.operators import models as M
from textreg.operators import selection as L
from textreg.operators.linear import centred, duality_gaps, elastic_nets, held_scores
from textreg.plans import blocks
from textreg.plans.blocks import Blocks, Fit

RNG = np.random.default_rng(7)
N, D = 120, 5
FEATURES = RNG.normal(size=(N, D)) * [1, 2, 3, 4, 5] + [0, 1, 2, 3, 4]
TARGET = FEATURES @ [1.5, -1.0, 0.0, 0.25, 0.0] + RNG.normal(size=N)


@pytest.fixture(scope="module")
def dense(spark):
    rows = [(i, float(TARGET[i]), [float(x) for x in FEATURES[i]]) for i in range(N)]
    return spark.createDataFrame(rows, "row_index bigint, y double, embedding array<double>").persist()


@pytest.fixture(scope="module")
def sparse(spark):
    rows = []
    for i in range(N):
        kept = [j for j in range(D) if (i + j) % 3]
        rows.append((i, float(TARGET[i]), kept, [float(FEATURES[i][j]) for j in kept], D))
    schema = "row_index bigint, y double, embedding_indices array<bigint>, embedding_values array<float>, embedding_size int"
    return spark.createDataFrame(rows, schema).persist()


def matrix(sparse):
    out = np.zeros((N, D))
    for r in sparse.collect():
        out[r["row_index"], r["embedding_indices"]] = r["embedding_values"]
    return out


def f_scores(x, y):
    r = np.array([np.corrcoef(x[:, j], y)[0, 1] for j in range(x.shape[1])])
    return r**2 / (1 - r**2) * (len(y) - 2)


def scaled(x):
    return (x - x.mean(0)) / x.std(0)


def weights(model):
    return np.array([w for i, w in M.coefficients(model) if i >= 0])


def test_f_regression_and_selection(sparse):
    rows = L.f_regression_scores(sparse, "y").orderBy("term_index").collect()
    expected = f_scores(matrix(sparse), TARGET)
    assert np.allclose([r["f_score"] for r in rows], expected, rtol=1e-5)
    best = [r["term_index"] for r in L.select_k_best(L.f_regression_scores(sparse, "y"), 2).collect()]
    assert best == list(np.argsort(-expected)[:2])


def test_constant_feature_has_no_score(spark):
    rows = [(float(i), [0, 1], [2.0, float(i % 3)]) for i in range(9)]
    df = spark.createDataFrame(rows, "y double, embedding_indices array<bigint>, embedding_values array<double>")
    scores = {r["term_index"]: r["f_score"] for r in L.f_regression_scores(df, "y").collect()}
    assert scores[0] is None and scores[1] is not None
    assert [r["term_index"] for r in L.select_k_best(L.f_regression_scores(df, "y"), 5).collect()] == [1, 0]


def test_fold_scores_are_scores_of_the_training_part(sparse):
    folded = sparse.withColumn("fold", (F.col("row_index") % 4).cast("int"))
    x = matrix(sparse)
    for r in L.fold_f_scores(folded, "y", "fold", "embedding_indices", "embedding_values").collect():
        train = np.arange(N) % 4 != r["fold"]
        assert r["f_score"] == pytest.approx(f_scores(x[train], TARGET[train])[r["term_index"]], rel=1e-5)


def test_scaling(spark, dense, sparse):
    out = np.array([r["embedding"] for r in L.standard_scale(dense).orderBy("row_index").collect()])
    assert np.allclose(out, scaled(FEATURES))
    unit = sparse.select(L.l2_normalized("embedding_values").alias("u")).collect()
    assert np.allclose([np.linalg.norm(r["u"]) for r in unit], 1)
    edge = spark.createDataFrame([([0.0, 0.0],), ([],)], "v array<float>").select(L.l2_normalized("v").alias("u")).collect()
    assert [list(r["u"]) for r in edge] == [[0, 0], []]


def test_sparse_vectors_keep_their_entries(sparse):
    rows = M.with_sparse_vectors(sparse).collect()
    x = matrix(sparse)
    assert all(np.allclose(r["features"].toArray(), x[r["row_index"]]) for r in rows)


def test_least_squares_and_ridge(dense):
    df = M.with_dense_vectors(dense)
    x, y = scaled(FEATURES), TARGET - TARGET.mean()
    assert np.allclose(weights(M.fit_model(df, "LinearRegression")), np.linalg.solve(x.T @ x, x.T @ y), atol=1e-6)
    for alpha in (1.0, 50.0):
        closed = np.linalg.solve(x.T @ x + alpha * np.eye(D), x.T @ y)
        assert np.allclose(weights(M.fit_model(df, "Ridge", alpha=alpha)), closed, atol=1e-6)


def test_lasso_against_coordinate_descent(dense):
    x, y, alpha = scaled(FEATURES), TARGET - TARGET.mean(), 0.3
    w = np.zeros(D)
    for _ in range(500):
        for j in range(D):
            rho = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / N
            w[j] = np.sign(rho) * max(abs(rho) - alpha, 0)
    assert np.allclose(weights(M.fit_model(M.with_dense_vectors(dense), "Lasso", alpha=alpha)), w, atol=1e-4)


def test_sparse_pipeline_uses_unit_rows_and_selection(sparse):
    df = M.with_sparse_vectors(sparse)
    model = M.fit_model(df, "LinearRegression", "sparse", [0, 1, 3])
    x = matrix(sparse)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True))[:, [0, 1, 3]]
    solved = np.linalg.lstsq(np.c_[np.ones(N), x], TARGET, rcond=None)[0]
    assert np.allclose([w for _, w in M.coefficients(model)], solved, atol=1e-5)


@pytest.mark.parametrize("name", ["RandomForest", "GradientBoosting"])
@pytest.mark.parametrize("storage", ["dense", "sparse"])
def test_trees_fit(dense, sparse, name, storage):
    df = M.with_dense_vectors(dense) if storage == "dense" else M.with_sparse_vectors(sparse)
    selected = None if storage == "dense" else [0, 1, 3]
    scored = M.fit_model(df, name, storage, selected, trees=4).transform(df)
    assert X.regression_scores(scored, "y", "prediction").first()["r2"] > 0.3


def test_elastic_net_grid(dense):
    _, table = M.elastic_net_cv(M.with_dense_vectors(dense), (0.5, 1.0), (0.01, 10.0), folds=2)
    best = min(table.collect(), key=lambda r: r["mse"])
    assert table.count() == 4 and best["alpha"] == 0.01


def coordinate_descent(x, y, alpha, l1_ratio, rounds=2000):
    xc, yc = x - x.mean(0), y - y.mean()
    n, w = len(y), np.zeros(x.shape[1])
    for _ in range(rounds):
        for j in range(x.shape[1]):
            rest = yc - xc @ w + xc[:, j] * w[j]
            rho = xc[:, j] @ rest / n
            w[j] = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / (xc[:, j] @ xc[:, j] / n + alpha * (1 - l1_ratio))
    return w


@pytest.mark.parametrize(("alpha", "l1_ratio"), [(1.0, 0.1), (0.5, 0.5), (2.0, 1.0)])
def test_elastic_net_objective(spark, way, alpha, l1_ratio):
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 3)) * [1.0, 2.0, 0.5]
    y = x @ [7.0, -5.0, 3.0] + r.normal(size=200) * 2
    rows = spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y, strict=True)], "y double, embedding array<double>")
    fitted = M.elastic_net(M.with_dense_vectors(rows), alpha, l1_ratio)
    assert np.allclose(fitted.weights, coordinate_descent(x, y, alpha, l1_ratio), atol=1e-4)


def wide_rows(spark, n, d, seed):
    """More features than rows: sparse, skewed, with a copy of a column and an empty one."""
    r = np.random.default_rng(seed)
    x = np.where(r.random((n, d)) < 0.03, r.exponential(size=(n, d)), 0)
    x[:, 1], x[:, 2] = x[:, 0], 0
    y = x[:, :20] @ r.normal(size=20) + r.normal(size=n) + 3
    rows = []
    for a, b in zip(x, y, strict=True):
        kept = np.flatnonzero(a)
        rows.append((float(b), [int(j) for j in kept], [float(v) for v in a[kept]], d))
    schema = "y double, embedding_indices array<bigint>, embedding_values array<double>, embedding_size int"
    return x, y, M.with_sparse_vectors(spark.createDataFrame(rows, schema)).repartition(5)


@pytest.fixture(params=["tasks", "passes"])
def way(request, monkeypatch):
    """Small rows are fitted in tasks; the same rows pass by pass over all partitions."""
    if request.param == "passes":
        monkeypatch.setattr(blocks, "SENT_BYTES", -1)
        monkeypatch.setattr(blocks, "DIRECT", 2)
        monkeypatch.setattr(blocks, "CHUNK", 1000)


def test_more_features_than_rows(spark, way):
    """Least squares of least norm and the ridge's dual form."""
    x, y, rows = wide_rows(spark, 800 if blocks.SENT_BYTES > 0 else 100, 5000 if blocks.SENT_BYTES > 0 else 700, 1)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    xc, yc = unit - unit.mean(0), y - y.mean()
    plain = M.fit_model(rows, "LinearRegression", "sparse")
    assert np.allclose(plain.weights, np.linalg.lstsq(xc, yc, rcond=1e-10)[0][plain.features], atol=1e-5)
    assert plain.weights[0] == pytest.approx(plain.weights[1], abs=1e-8)
    ridge = M.fit_model(rows, "Ridge", "sparse", alpha=0.5)
    dual = xc.T @ np.linalg.solve(xc @ xc.T + 0.5 * np.eye(len(y)), yc)
    assert np.allclose(ridge.weights, dual[ridge.features], atol=1e-8)
    predicted = np.array([r["prediction"] for r in ridge.transform(rows).select("y", "prediction").orderBy("y").collect()])
    assert np.allclose(predicted, (xc @ dual + y.mean())[np.argsort(y)], atol=1e-7)


@pytest.mark.parametrize(("n", "d", "l1", "l2"), [(200, 5000, 0.001, 0.0), (200, 400, 0.02, 0.1), (100, 30, 1e-5, 0.0)])
def test_gap_to_the_lower_bound(spark, n, d, l1, l2):
    _, _, rows = wide_rows(spark, n, d, 2)
    with Blocks(rows, [], unit=True) as packed:
        c = centred(packed, [Fit()], d, standardize=False)
        weights = elastic_nets(packed, c, [(0, l1, l2)])
        assert duality_gaps(packed, c, [(0, l1, l2)], weights)[0] < 1e-6
        assert duality_gaps(packed, c, [(0, l1, l2)], weights * 0.9)[0] > 1e-5


def test_linear_fits_of_folds_are_fits_of_their_rows(spark, way):
    """All folds in the same passes give what each gives alone; chunks and partitions do not matter."""
    x, y, rows = wide_rows(spark, 90, 60, 3)
    rows = rows.withColumn("fold", (F.abs(F.hash("y")) % 3).cast("int")).persist()
    features = [tuple(range(0, 60, 2)), tuple(range(20, 60)), None]
    with Blocks(rows, ["fold"]) as packed:
        c = centred(packed, [Fit(0, k, f) for k, f in enumerate(features)], 60, standardize=True)
        found = M.linear_weights(packed, c, {"Ridge": 2.0, "Lasso": 0.05})
        scored = held_scores(packed, c, [0, 1, 2], found["Ridge"])
    for k, f in enumerate(features):
        train, held = rows.filter(F.col("fold") != k), rows.filter(F.col("fold") == k)
        kept = list(f) if f else list(range(60))
        for name, alpha in (("Ridge", 2.0), ("Lasso", 0.05)):
            alone = M.fit_model(train, name, "dense", selected=kept, alpha=alpha)
            assert np.allclose(alone.weights, found[name][k][np.searchsorted(c.features, kept)], atol=1e-6)
            if name == "Ridge":
                score = X.regression_scores(alone.transform(held), "y", "prediction").first()
                assert scored[k] == pytest.approx((score["rmse"], score["r2"]))


def test_linear_fits_of_degenerate_rows(spark):
    schema = "y double, embedding array<double>"
    for rows in ([(1.0, [2.0, 3.0])], [(1.0, [2.0, 3.0])] * 4, [(1.0, [0.0, 0.0]), (2.0, [0.0, 0.0])]):
        df = M.with_dense_vectors(spark.createDataFrame([*rows, (None, [1.0, 1.0]), (1.0, None)], schema))
        for name in ("LinearRegression", "Ridge", "Lasso"):
            fitted = M.fit_model(df, name)
            assert not fitted.weights.any() and fitted.intercept == pytest.approx(np.mean([y for y, _ in rows]))
            assert [r["prediction"] is None for r in fitted.transform(df).collect()] == [False] * (len(rows) + 1) + [True]


def test_unknown_model_or_storage(dense):
    with pytest.raises(ValueError, match="unknown model"):
        M.fit_model(M.with_dense_vectors(dense), "SVM")
    with pytest.raises(ValueError, match="storage"):
        M.fit_model(M.with_dense_vectors(dense), "Ridge", "columnar")


def test_experiment_scores_and_storage(spark, dense, sparse, tmp_path):
    strategies = [
        X.Strategy("bow", sparse.filter("row_index < 96"), sparse.filter("row_index >= 96"), "sparse"),
        X.Strategy("glove", dense.filter("row_index < 96"), dense.filter("row_index >= 96"), "dense"),
    ]
    scores = X.run_experiment(spark, "toy", strategies, ["Ridge", "RandomForest"], 2, 2, params={"RandomForest": {"trees": 3}}).persist()
    assert scores.filter("scenario = 'cv'").count() == 2 * 2 * 2 * 2
    assert scores.filter("scenario = 'test'").count() == 4
    assert scores.filter("r2 is null or rmse is null or r2 > 1").isEmpty()
    path = str(tmp_path / "results")
    X.save_results(scores, path)
    X.save_results(scores.filter("embedding_strategy = 'bow'"), path)
    assert X.collect_results(spark, path, "toy").count() == 4
    assert X.collect_results(spark, path, "toy", "cv").count() == 16


def test_holdout_equals_manual_ridge(spark, dense):
    train, test = dense.filter("row_index < 96"), dense.filter("row_index >= 96")
    (name, rmse, r2), = X.score_holdout(X.Strategy("d", train, test, "dense"), ["Ridge"])
    mean, std = FEATURES[:96].mean(0), FEATURES[:96].std(0)
    x, y = (FEATURES[:96] - mean) / std, TARGET[:96]
    w = np.linalg.solve(x.T @ x + np.eye(D), x.T @ (y - y.mean()))
    residual = TARGET[96:] - ((FEATURES[96:] - mean) / std @ w + y.mean())
    assert name == "Ridge" and rmse == pytest.approx(np.sqrt((residual**2).mean()), rel=1e-6)
    assert r2 == pytest.approx(1 - (residual**2).sum() / ((TARGET[96:] - TARGET[96:].mean()) ** 2).sum(), rel=1e-6)


def test_whole_grid_with_more_features_than_rows(spark):
    """All models, folds and repeats are really fitted, on fewer rows than features."""
    _, _, rows = wide_rows(spark, 50, 120, 5)
    lists = rows.select(F.unwrap_udt("features").alias("v"), "y").selectExpr(
        "cast(row_number() over (order by y, get(v.values, 0)) - 1 as bigint) as row_index", "y", "transform(v.indices, i -> cast(i as bigint)) as embedding_indices",
        "v.values as embedding_values", "v.size as embedding_size",
    ).persist()
    strategy = X.Strategy("wide", lists.filter("row_index % 5 != 0"), lists.filter("row_index % 5 = 0"), "sparse")
    params = {"RandomForest": {"trees": 4}, "GradientBoosting": {"trees": 5}}
    got = X.run_experiment(spark, "toy", [strategy], params=params).collect()
    assert len(got) == 5 * (15 + 1) and {r["model_name"] for r in got} == set(M.MODELS)
    assert all(r["rmse"] >= 0 and r["r2"] <= 1 for r in got)
    assert len({(r["model_name"], r["repeat"], r["fold"], r["scenario"]) for r in got}) == 80


def test_registered_experiment_takes_every_default_and_strategy(spark, folder, monkeypatch):
    from textreg.queries.catalog import QUERIES

    real, seen = X.run_experiment, {}

    def small(spark, dataset, strategies, *a, **k):
        seen.update(names=[s.name for s in strategies], a=a, k=k)
        return real(spark, dataset, strategies, models=["Ridge"], n_splits=2, n_repeats=1)

    monkeypatch.setattr(X, "run_experiment", small)
    got = QUERIES["run_experiment"](spark, folder).collect()
    assert not seen["a"] and not seen["k"] and len(got) == 6 * 3 and all(r["rmse"] >= 0 for r in got)
    assert seen["names"] == ["bow", "n_gram_bow", "tf_idf", "word2vec", "word_vector_mean", "encoder"]


def test_row_sum_order_takes_every_flag(spark, tmp_path):
    from textreg.queries.catalog import QUERIES

    rows = [(1, 1, "A"), (1, 2, "X"), (1, 3, "X"), (2, 1, "N")]
    spark.createDataFrame(rows, "l_suppkey bigint, l_orderkey bigint, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert list(map(tuple, QUERIES["row_sum_order"](spark, str(tmp_path)).collect())) == [(1, 3), (2, 1)]
