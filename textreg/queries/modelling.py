"""Feature scaling and selection, models, and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from textreg.operators import dense as D
from textreg.operators import experiment as X
from textreg.operators import models as M
from textreg.operators import selection as L
from textreg.operators import trees as TR
from textreg.operators import vectorize as V
from textreg.operators.splits import split_shuffled
from textreg.plans.stage import stage_path, write_stage
from textreg.queries.registry import query
from textreg.queries.text_features import FITTED, documents, word_vectors


def sparse_documents(t, method: str = "BoW"):
    """Sparse rows of all documents with ``y``, the log of their length; stored once."""
    return write_stage(V.fit_transform(documents(t), method, keep=["y"]), "sparse-documents")


def dense_vectors(t):
    """Vector rows with ``y``, the label; ``embedding`` kept beside the ML column."""
    return M.with_dense_vectors(t.embeddings.select(F.col("vec_id").alias("row_index"), F.col("label").cast("double").alias("y"), "embedding"))


@query("l2_normalize_rows", FITTED + """, lens as (select row_index, sqrt(sum(n * n)) as len from tf group by 1)
    select row_index, term_index, round(n / len, 6) as value from tf join vocab using (term) join lens using (row_index)""")
def l2_normalize_rows(t):
    rows = V.fit_transform(documents(t), "BoW").withColumn("embedding_values", L.l2_normalized("embedding_values"))
    pairs = F.explode_outer(F.arrays_zip("embedding_indices", "embedding_values")).alias("e")
    return rows.select("row_index", pairs).filter(F.col("e").isNotNull()).select(
        "row_index", F.col("e.embedding_indices").alias("term_index"), F.round("e.embedding_values", 6).alias("value")
    )


SCORES = FITTED + """, y as (select doc_id as row_index, ln(1.0 + n_chars) - (select avg(ln(1.0 + n_chars)) from documents) as yc from documents),
    whole as (select count(*) as n, sum(yc * yc) as syy from y),
    sums as (select term_index, sum(n) as sx, sum(n * n) as sxx, sum(n * yc) as sxy from tf join vocab using (term) join y using (row_index) group by 1),
    scored as (select term_index, sxy * sxy / ((sxx - sx * sx / n) * syy) as r2, n from sums, whole where sxx - sx * sx / n > sxx * 1e-12),
    scores as (select term_index, round(r2, 6) as r2, round(r2 / (1 - r2) * (n - 2), 4) as f_score from scored)"""


@query("f_regression_scores", SCORES + " select * from scores")
def f_regression_scores(t):
    scores = L.f_regression_scores(sparse_documents(t), "y")
    return scores.select("term_index", F.round("r2", 6).alias("r2"), F.round("f_score", 4).alias("f_score")).filter(F.col("r2").isNotNull())


@query("select_k_best", SCORES + " select term_index, f_score from scores order by f_score desc, term_index limit 5000")
def select_k_best(t):
    scores = L.f_regression_scores(sparse_documents(t), "y").withColumn("f_score", F.round("f_score", 4))
    return L.select_k_best(scores, M.LINEAR_K).select("term_index", "f_score")


@query("standard_scale", """
    with e as (select vec_id, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) as dim from embeddings),
    s as (select dim, avg(x) as m, stddev_pop(x) as sd from e group by 1)
    select vec_id, cast(dim - 1 as integer) as dim, round((x - m) / sd, 5) + 0.0 as value from e join s using (dim)""")
def standard_scale(t):
    scaled = L.standard_scale(t.embeddings.select("vec_id", "embedding"))
    return scaled.select("vec_id", F.posexplode_outer("embedding").alias("dim", "value")).withColumn("value", F.round("value", 5) + 0.0)


# The normal equations of all dimensions, scaled and centred, as one list per dimension with its right side at the end.
NORMAL = """with recursive e as (select vec_id, label, cast(unnest(embedding) as double) as v, generate_subscripts(embedding, 1) as dim from embeddings),
    s as (select dim, avg(v) as m, stddev_pop(v) as sd from e group by 1), ym as (select avg(label) as ym, count(*) as n from embeddings),
    x as (select vec_id, dim, (v - m) / sd as x, label - ym as y from e join s using (dim), ym),
    g as (select a.dim as i, b.dim as j, sum(a.x * b.x) as g from x a join x b using (vec_id) group by 1, 2),
    r as (select dim as i, sum(x * y) as b from x group by 1),
    m as materialized (select i, list(g order by j) as row, any_value(b) as b from g join r using (i) group by 1),"""


def _solved(alpha: float) -> str:
    """Gauss-Jordan elimination, one column per step."""
    return NORMAL + f"""
    a as (select 1 as k, (select list(list_append(list_transform(row, lambda v, j: v + case when j = i then {alpha} else 0 end), b) order by i) from m) as a
      union all
      select k + 1, list_transform(a, lambda row, i: case when i = k then list_transform(row, lambda v: v / a[k][k])
          else list_transform(list_zip(row, a[k]), lambda p: p[1] - row[k] / a[k][k] * p[2]) end) from a where k <= len(a)),
    w as (select unnest(a) as row, generate_subscripts(a, 1) as i from a where k = len(a) + 1)
    select cast(i - 1 as integer) as feature, round(row[len(row)], 4) + 0.0 as weight from w
    union all select -1, round(ym, 4) + 0.0 from ym"""


# Coordinate descent, one coordinate per step.
DESCENT = NORMAL + """
    p as materialized (select list(row order by i) as g, list(b order by i) as b, (select n from ym) as n from m),
    w as (select 0 as t, list_transform(b, lambda v: cast(0 as double)) as w, g, b, n from p
      union all
      select t + 1, list_transform(w, lambda v, i: case when i = t % len(b) + 1 then
            sign((b[i] - list_dot_product(g[i], w)) / n + v) * greatest(abs((b[i] - list_dot_product(g[i], w)) / n + v) - 0.001, 0) else v end), g, b, n
      from w where t < 40 * len(b)),
    f as (select unnest(w) as v, generate_subscripts(w, 1) as i from w where t = 40 * len(b))
    select cast(i - 1 as integer) as feature, round(v, 4) + 0.0 as weight from f union all select -1, round(ym, 4) + 0.0 from ym"""


def _weights(t, model: str):
    fitted = M.fit_model(dense_vectors(t), model, "dense")
    weights = t.spark.createDataFrame(M.coefficients(fitted), "feature int, weight double")
    return weights.withColumn("weight", F.round("weight", 4) + 0.0)


@query("linear_regression", _solved(0))
def linear_regression(t):
    return _weights(t, "LinearRegression")


@query("ridge_regression", _solved(1))
def ridge_regression(t):
    return _weights(t, "Ridge")


@query("lasso_regression", DESCENT)
def lasso_regression(t):
    return _weights(t, "Lasso")


@query("elastic_net_cv")
def elastic_net_cv(t):
    return M.elastic_net_cv(dense_vectors(t))[1]


def _predictions(t, model: str, **params):
    rows = dense_vectors(t)
    return M.fit_model(rows, model, "dense", **params).transform(rows).select("row_index", "y", "prediction")


@query("random_forest")
def random_forest(t):
    return _predictions(t, "RandomForest")


@query("gradient_boosting")
def gradient_boosting(t):
    return _predictions(t, "GradientBoosting")


# ---- fits with closed forms: one feature, or a feature with few values ----

ONE = """with d as (select cast(embedding[1] as double) as x, cast(label as double) as y, vec_id as i from embeddings),
    s as (select count(*) as n, avg(y) as ym, covar_pop(x, y) / stddev_pop(x) as c from d)"""


def _one_feature(t):
    """The first vector component against the label."""
    rows = t.embeddings.select(
        F.col("vec_id").alias("row_index"), F.col("label").cast("double").alias("y"), F.array(F.col("embedding")[0]).alias("embedding")
    )
    return M.with_dense_vectors(rows)


def _rounded_weights(t, model: str):
    fitted = M.fit_model(_one_feature(t), model, "dense")
    weights = t.spark.createDataFrame(M.coefficients(fitted), "feature int, weight double")
    return weights.withColumn("weight", F.round("weight", 4) + 0.0)


def _closed_form(weight: str) -> str:
    return f"""{ONE} select -1 as feature, round(ym, 4) + 0.0 as weight from s
        union all select 0, round({weight}, 4) + 0.0 from s"""


@query("linear_regression_one_feature", _closed_form("c"))
def linear_regression_one_feature(t):
    return _rounded_weights(t, "LinearRegression")


@query("ridge_regression_one_feature", _closed_form("n * c / (n + 1)"))
def ridge_regression_one_feature(t):
    return _rounded_weights(t, "Ridge")


@query("lasso_regression_one_feature", _closed_form("sign(c) * greatest(abs(c) - 0.001, 0)"))
def lasso_regression_one_feature(t):
    return _rounded_weights(t, "Lasso")


@query("elastic_net_cv_one_feature", ONE + """,
    r as (select *, row_number() over (order by md5('42:0:' || i)) - 1 as k, (select n from s) as n from d),
    f as (select x, y, cast(case when k < (n % 5) * (n // 5 + 1) then k // (n // 5 + 1) else n % 5 + (k - (n % 5) * (n // 5 + 1)) // (n // 5) end as integer) as fold from r),
    m as (select held.fold, avg(f.x) as xm, avg(f.y) as ym, covar_pop(f.x, f.y) as xy, var_pop(f.x) as xx
      from f, (select unnest([0, 1, 2, 3, 4]) as fold) held where f.fold <> held.fold group by 1),
    w as (select m.*, l1_ratio, alpha, sign(xy) * greatest(abs(xy) - alpha * l1_ratio, 0) / (xx + alpha * (1 - l1_ratio)) as w
      from m, (select unnest([0.1, 0.5, 1.0]) as l1_ratio), (select unnest([0.001, 0.01, 0.1]) as alpha)),
    e as (select l1_ratio, alpha, f.fold, avg((y - ym - w * (x - xm)) ** 2) as mse from f join w using (fold) group by 1, 2, 3)
    select cast(l1_ratio as double) as l1_ratio, cast(alpha as double) as alpha, round(avg(mse), 4) as mse from e group by 1, 2""")
def elastic_net_cv_one_feature(t):
    table = M.elastic_net_cv(_one_feature(t), alphas=(0.001, 0.01, 0.1))[1]
    return table.withColumn("mse", F.round("mse", 4))


def _components(t, *vector):
    """Rows with a vector of the given components of the stored one and ``y``, the label."""
    rows = t.embeddings.select(
        F.col("vec_id").alias("row_index"), F.col("label").cast("double").alias("y"), F.array(*[F.col("embedding")[i] for i in vector]).alias("embedding")
    )
    return M.with_dense_vectors(rows)


def _equal_columns(t, model: str):
    """The same component twice: neither fit may prefer one."""
    weights = t.spark.createDataFrame(M.coefficients(M.fit_model(_components(t, 0, 0), model, "dense")), "feature int, weight double")
    return weights.withColumn("weight", F.round("weight", 4) + 0.0)


def _halves(weight: str) -> str:
    return f"{ONE} select -1 as feature, round(ym, 4) + 0.0 as weight from s union all select f, round({weight}, 4) + 0.0 from s, (select unnest([0, 1]) as f)"


@query("linear_regression_equal_columns", _halves("c / 2"))
def linear_regression_equal_columns(t):
    return _equal_columns(t, "LinearRegression")


@query("ridge_regression_equal_columns", _halves("n * c / (2 * n + 1)"))
def ridge_regression_equal_columns(t):
    return _equal_columns(t, "Ridge")


# Two features have nine patterns of signs; the right one solves its equations and satisfies the conditions of the others.
@query("elastic_net_cv_two_features", ONE + """,
    d2 as (select cast(embedding[1] as double) as x1, cast(embedding[2] as double) as x2, cast(label as double) as y, vec_id as i from embeddings),
    r as (select *, row_number() over (order by md5('42:0:' || i)) - 1 as k, (select n from s) as n from d2),
    f as (select x1, x2, y, cast(case when k < (n % 5) * (n // 5 + 1) then k // (n // 5 + 1) else n % 5 + (k - (n % 5) * (n // 5 + 1)) // (n // 5) end as integer) as fold from r),
    m as (select held.fold, avg(x1) as m1, avg(x2) as m2, avg(y) as ym, var_pop(x1) as g11, var_pop(x2) as g22, covar_pop(x1, x2) as g12,
        covar_pop(x1, y) as b1, covar_pop(x2, y) as b2
      from f, (select unnest([0, 1, 2, 3, 4]) as fold) held where f.fold <> held.fold group by 1),
    p as (select m.*, l1_ratio, alpha, alpha * l1_ratio as l1, alpha * (1 - l1_ratio) as l2, s1, s2
      from m, (select unnest([0.1, 0.5, 1.0]) as l1_ratio), (select unnest([0.001, 0.01, 0.1]) as alpha),
        (select unnest([-1, 0, 1]) as s1), (select unnest([-1, 0, 1]) as s2)),
    q as (select *, case when s1 = 0 then 0 when s2 = 0 then (b1 - l1 * s1) / (g11 + l2)
        else ((g22 + l2) * (b1 - l1 * s1) - g12 * (b2 - l1 * s2)) / ((g11 + l2) * (g22 + l2) - g12 * g12) end as w1,
      case when s2 = 0 then 0 when s1 = 0 then (b2 - l1 * s2) / (g22 + l2)
        else ((g11 + l2) * (b2 - l1 * s2) - g12 * (b1 - l1 * s1)) / ((g11 + l2) * (g22 + l2) - g12 * g12) end as w2 from p),
    w as (select * from q where sign(w1) = s1 and sign(w2) = s2
      and (s1 <> 0 or abs(b1 - g12 * w2) <= l1) and (s2 <> 0 or abs(b2 - g12 * w1) <= l1)),
    e as (select l1_ratio, alpha, f.fold, avg((y - ym - w1 * (x1 - m1) - w2 * (x2 - m2)) ** 2) as mse from f join w using (fold) group by 1, 2, 3)
    select cast(l1_ratio as double) as l1_ratio, cast(alpha as double) as alpha, round(avg(mse), 4) as mse from e group by 1, 2""")
def elastic_net_cv_two_features(t):
    table = M.elastic_net_cv(_components(t, 0, 1), alphas=(0.001, 0.01, 0.1))[1]
    return table.withColumn("mse", F.round("mse", 4))


# Least squares of two features, of vectors scaled by deviation and of vectors at length 1.
PLANE = """select {storage} as storage, f as feature, round(case f when 0 then (g22 * b1 - g12 * b2) / (g11 * g22 - g12 * g12) * {one}
      else (g11 * b2 - g12 * b1) / (g11 * g22 - g12 * g12) * {two} end, 4) + 0.0 as weight from {moments}, (select unnest([0, 1]) as f)"""
MOMENTS = "(select var_pop(a) as g11, var_pop(b) as g22, covar_pop(a, b) as g12, covar_pop(a, y) as b1, covar_pop(b, y) as b2 from {rows})"


@query("sparse_dense_pipeline", "with d as (select cast(embedding[1] as double) as a, cast(embedding[2] as double) as b, cast(label as double) as y from embeddings),\n"
    "u as (select a / sqrt(a * a + b * b) as a, b / sqrt(a * a + b * b) as b, y from d)\n"
    + PLANE.format(storage="'dense'", one="sqrt(g11)", two="sqrt(g22)", moments=MOMENTS.format(rows="d"))
    + "\nunion all\n" + PLANE.format(storage="'sparse'", one=1, two=1, moments=MOMENTS.format(rows="u")))
def sparse_dense_pipeline(t):
    rows = _components(t, 0, 1)
    found = [(s, i, w) for s in ("dense", "sparse") for i, w in M.coefficients(M.fit_model(rows, "LinearRegression", s)) if i >= 0]
    return t.spark.createDataFrame(found, "storage string, feature int, weight double").withColumn("weight", F.round("weight", 4) + 0.0)


GROUP_MEANS = """
    select o_orderkey as row_index, round(avg(o_totalprice) over (partition by o_orderkey % 7), 2) as prediction from orders"""


def _group_means(t, model: str, **params):
    """A feature with seven values: a tree that sees all rows predicts the mean of each, and a hundred boosted ones come as close."""
    rows = M.with_dense_vectors(t.orders.select(
        F.col("o_orderkey").alias("row_index"), F.col("o_totalprice").alias("y"), F.array(F.col("o_orderkey") % 7).alias("embedding")
    ))
    fitted = M.fit_model(rows, model, "dense", **params)
    return fitted.transform(rows).select("row_index", F.round("prediction", 2).alias("prediction"))


@query("random_forest_group_means", GROUP_MEANS)
def random_forest_group_means(t):
    return _group_means(t, "RandomForest", trees=5, bootstrap=False)


@query("gradient_boosting_group_means", GROUP_MEANS)
def gradient_boosting_group_means(t):
    return _group_means(t, "GradientBoosting", trees=100)


# Every round takes 0.3 of -G / (H + 1) off what is left to the mean of a value. The means lie far enough apart for every split to gain.
@query("gradient_boosting_ten_rounds", """
    with recursive o as (select o_orderkey % 7 as k, o_totalprice / 1000 + 1000 * (o_orderkey % 7 - 3) ** 3 as y from orders),
    v as (select k, count(*) as n, avg(y) as mean from o group by 1),
    b as (select 0 as round, k, (select avg(y) from o) as margin from v
      union all select round + 1, b.k, margin - 0.3 * n * (margin - mean) / (n + 1) from b join v on b.k = v.k where round < 10)
    select k as seventh, round(margin, 2) as prediction from b where round = 10""")
def gradient_boosting_ten_rounds(t):
    seventh = F.col("o_orderkey") % 7
    rows = t.orders.select((F.col("o_totalprice") / 1000 + 1000 * (seventh - 3) ** 3).alias("y"), F.array(seventh).alias("embedding"))
    fitted = M.fit_model(M.with_dense_vectors(rows), "GradientBoosting", "dense", trees=10)
    each = M.with_dense_vectors(t.orders.select((F.col("o_orderkey") % 7).alias("seventh")).distinct().withColumn("embedding", F.array("seventh")))
    return fitted.transform(each).select("seventh", F.round("prediction", 2).alias("prediction"))


_SPLIT = """
    {name} as (select node, feature, v, lead(v) over (partition by node, feature order by v) as after,
        sum(w) over (partition by node, feature order by v) as left_w, sum(s) over (partition by node, feature order by v) as left_s, all_w, all_s
      from (select node, feature, v, count(*) as w, sum(y) as s, any_value(all_w) as all_w, any_value(all_s) as all_s
        from (select *, count(*) over (partition by node, feature) as all_w, sum(y) over (partition by node, feature) as all_s from {rows}) group by 1, 2, 3)),
    {name}_best as (select *, left_s ** 2 / left_w + (all_s - left_s) ** 2 / (all_w - left_w) - all_s ** 2 / all_w as gain from {name} where after is not null
      qualify row_number() over (partition by node order by cast(printf('%.11e', gain) as double) desc, feature, v) = 1)"""


@query("exact_tree_splits", f"""
    with o as (select o_orderkey, o_totalprice as x0, o_custkey as x1, cast(epoch(cast(o_orderdate as timestamp)) / 86400 as double) as y from orders),
    top as (select 0 as node, feature, v, y from (select o_orderkey, y, unnest([x0, x1]) as v, unnest([0, 1]) as feature from o)),{_SPLIT.format(name="one", rows="top")},
    below as (select case when case b.feature when 0 then x0 else x1 end <= b.v then 1 else 2 end as node, c.feature, c.v, o.y
      from o, one_best b, lateral (select unnest([x0, x1]) as v, unnest([0, 1]) as feature) c),{_SPLIT.format(name="two", rows="below")}
    select cast(node as bigint) as node, cast(feature as bigint) as feature, cast(v as double) as value, cast(after as double) as after, cast(left_w as bigint) as left_n,
      round(gain / 1000, 2) as gain from (select * from one_best union all select * from two_best)""")
def exact_tree_splits(t):
    """The first split of a tree over two features with thousands of values, and those of both its children."""
    rows = t.orders.select(
        F.col("o_totalprice").cast("double").alias("x0"), F.col("o_custkey").cast("double").alias("x1"), F.unix_date(F.to_date("o_orderdate")).cast("double").alias("y")
    )
    value = F.posexplode(F.array("x0", "x1")).alias("feature", "value")

    def splits(at):
        placed = write_stage(rows.select(at.cast("bigint").alias("node"), "y", "x0", "x1"), "placed")
        cells = placed.select("node", "y", value).select("node", F.col("feature").cast("bigint").alias("feature"), "value", F.lit(1.0).alias("w"), F.col("y").alias("s"))
        return TR.best_splits(cells, placed.groupBy("node").agg(F.count("*").cast("double").alias("all_w"), F.sum("y").alias("all_s")))

    first = write_stage(splits(F.lit(0)), "first-split")
    b = first.first()
    second = splits(F.when(F.col(f"x{b['feature']}") <= b["value"], 1).otherwise(2))
    return first.unionByName(second).select(
        "node", "feature", "value", "after", F.col("left_w").cast("bigint").alias("left_n"), F.round(F.col("gain") / 1000, 2).alias("gain")
    )


@query("run_experiment")
def run_experiment(t):
    """All models, folds and repeats over every strategy that the tables can build."""
    docs = documents(t)
    y = docs.select("row_index", "y")
    pooled = write_stage(D.word_vector_mean(docs, word_vectors(t)).select("row_index", "embedding").join(y, "row_index"), "pooled-documents")
    texts = t.documents.select(F.col("doc_id").alias("row_index"), "text")
    encoded = write_stage(
        D.encode_texts(texts, "text", D.hashing_encoder(32), 32).select("row_index", "embedding").join(y, "row_index"), "encoded-documents"
    )
    rows = [
        ("bow", sparse_documents(t, "BoW"), "sparse"), ("n_gram_bow", sparse_documents(t, "n-gram+BoW"), "sparse"),
        ("tf_idf", sparse_documents(t, "TF-IDF"), "sparse"), ("word2vec", dense_vectors(t).drop("features"), "dense"),
        ("word_vector_mean", pooled, "dense"), ("encoder", encoded, "dense"),
    ]
    strategies = []
    for name, found, storage in rows:
        split = split_shuffled(found, "row_index")
        strategies.append(X.Strategy(name, split.filter("set = 'train'").drop("set"), split.filter("set = 'test'").drop("set"), storage))
    return X.run_experiment(t.spark, "documents", strategies)


@query("collect_results", """
    select l_returnflag as dataset_name, l_linestatus as embedding_strategy, cast(l_suppkey as varchar) as model_name,
      round(avg(l_quantity), 6) as rmse, round(avg(l_discount), 6) as r2, 'test' as scenario from lineitem where l_returnflag = 'A' group by 1, 2, 3""")
def collect_results(t):
    scores = t.lineitem.groupBy(
        F.col("l_returnflag").alias("dataset_name"), F.col("l_linestatus").alias("embedding_strategy"), F.col("l_suppkey").cast("string").alias("model_name"),
    ).agg(F.lit(None).cast("int").alias("repeat"), F.lit(None).cast("int").alias("fold"), F.avg("l_quantity").alias("rmse"), F.avg("l_discount").alias("r2"))
    path = stage_path(t.spark, "results")
    X.save_results(scores.withColumn("scenario", F.lit("test")), path)
    stored = X.collect_results(t.spark, path, "A")
    return stored.select("dataset_name", "embedding_strategy", "model_name", F.round("rmse", 6).alias("rmse"), F.round("r2", 6).alias("r2"), "scenario")
