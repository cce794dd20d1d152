"""The paths taken only by large or skewed data, forced on small data and compared with plain Spark."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from textreg.operators.aggregates import boxplot_summary, ordered_concat
from textreg.operators.splits import fold_sizes, repeated_kfold, split_shuffled, train_size
from textreg.operators.vectorize import fit_vocabulary
from textreg.plans.cuts import hash_cuts, hash_key
from textreg.plans.ordering import add_row_index, running_count, shift_features
from textreg.plans.quantiles import _quantiles_by_rank, group_quantiles
from textreg.plans.skew import EACH_ROW, fits_broadcast, lookup_join
from textreg.plans.stage import shared_root, write_stage


@pytest.fixture(scope="module")
def skewed(spark):
    """3000 rows; key 0 owns more than a third."""
    key = F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 40)
    return spark.range(3000).select("id", key.cast("int").alias("k"), (F.col("id") * 7919 % 1000).alias("v"))


def test_row_index_is_contiguous_and_ordered(skewed):
    rows = add_row_index(skewed, ["v", "id"]).orderBy("row_index").collect()
    assert [r["row_index"] for r in rows] == list(range(3000))
    assert [(r["v"], r["id"]) for r in rows] == sorted((r["v"], r["id"]) for r in rows)


def test_row_index_descending_and_empty(spark, skewed):
    rows = add_row_index(skewed, [F.desc("v"), "id"], start=1).orderBy("row_index").collect()
    assert rows[0]["v"] == 999 and rows[0]["row_index"] == 1 and rows[-1]["v"] == 0
    assert add_row_index(skewed.filter("false"), "id").count() == 0


def test_row_index_plan_has_no_single_task_window(skewed):
    plan = add_row_index(skewed, ["v", "id"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan


@pytest.mark.parametrize("block", [7, 100, 10_000])
def test_shift_over_blocks(skewed, block):
    indexed = add_row_index(skewed, "id")
    moved = shift_features(indexed, {"n1": ("v", 1), "p3": ("v", -3)}, block_rows=block)
    w = Window.orderBy("row_index")
    plain = indexed.withColumns({"n1": F.lead("v", 1).over(w), "p3": F.lag("v", 3).over(w)})
    assert moved.exceptAll(plain).isEmpty() and moved.count() == 3000


def test_running_count_split_equals_window(skewed):
    rows = skewed.withColumn("x", F.when(F.col("v") % 3 > 0, F.col("v")))
    small = running_count(rows, "k", ["v", "id"], "x", "c")
    split = running_count(rows, "k", ["v", "id"], "x", "c", max_group_rows=10, block_rows=50)
    assert split.columns == small.columns
    assert small.exceptAll(split).isEmpty() and split.count() == 3000


def test_quantiles_by_rank_equal_percentile(skewed):
    counts = skewed.groupBy("k", "v").agg(F.count("*").alias("n"))
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    mine = {r["k"]: (r["q1"], r["median"], r["q3"]) for r in _quantiles_by_rank(counts, "k", "v", probs, 64).collect()}
    plain = skewed.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, probs.values()))).alias("q")).collect()
    assert mine == {r["k"]: tuple(r["q"]) for r in plain}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, skewed, how):
    right = spark.range(0, 40, 2).select(F.col("id").cast("int").alias("k"), (F.col("id") + 1).alias("w"))
    salted = lookup_join(skewed, right, "k", how, spread_by="id", max_broadcast_rows=0, hot_share=20, salts=8)
    plain = skewed.join(right, "k", how)
    assert "BroadcastHashJoin" in skewed.join(F.broadcast(right), "k")._jdf.queryExecution().toString()
    assert salted.columns == plain.columns
    assert salted.exceptAll(plain).isEmpty() and plain.exceptAll(salted).isEmpty()


def test_broadcast_bound_is_measured(spark):
    wide = spark.range(100).select(F.repeat(F.lit("x"), 1000).alias("s"))
    assert fits_broadcast(wide) and not fits_broadcast(wide, max_bytes=10_000) and not fits_broadcast(wide, max_rows=99)


def test_hash_cuts_refine_large_buckets(skewed):
    key = hash_key("1", "id")
    keys = sorted(r[0] for r in skewed.select(key).collect())
    ranks = [0, 1, 700, 2999, 3000]
    expected = [*(keys[r] for r in ranks[:4]), None]
    assert hash_cuts(skewed, key, ranks) == expected
    assert hash_cuts(skewed, key, ranks, digits=1, max_bucket_rows=3) == expected


def test_split_and_folds(skewed):
    halves = {r["set"]: r["count"] for r in split_shuffled(skewed, "id").groupBy("set").count().collect()}
    assert halves == {"train": 2400, "test": 600}
    folds = repeated_kfold(skewed.filter("id < 2998"), "id", 5, 3)
    sizes = folds.groupBy("repeat", "fold").count().collect()
    assert len(sizes) == 15
    for repeat in range(3):
        assert [r["count"] for r in sorted(sizes) if r["repeat"] == repeat] == fold_sizes(2998, 5)
    assert folds.groupBy("id", "repeat").count().filter("count > 1").isEmpty()


def test_split_sizes_of_the_known_datasets():
    assert train_size(927) == 741 and train_size(242) == 193


def test_splitting_adds_no_shuffle(skewed):
    for df in (split_shuffled(skewed, "id"), repeated_kfold(skewed, "id")):
        assert "Exchange" not in df._jdf.queryExecution().toString()


def test_ordered_concat_over_chunks(spark):
    rows = spark.range(50).select((F.col("id") % 2).alias("k"), (49 - F.col("id")).alias("o"), F.col("id").cast("string").alias("s"))
    whole = {r["k"]: r["s"] for r in ordered_concat(rows, ["k"], "o", "s", sep="\n\n", chunk=5).collect()}
    assert whole[0] == "\n\n".join(str(i) for i in range(48, -1, -2))


def test_numpy_agrees_with_interpolation(skewed):
    values = [r["v"] for r in skewed.filter("k = 0").select("v").collect()]
    counts = skewed.filter("k = 0").groupBy("k", "v").agg(F.count("*").alias("n"))
    q = _quantiles_by_rank(counts, "k", "v", {"p": 0.37}, 16).first()["p"]
    assert q == pytest.approx(np.quantile(values, 0.37))


def test_stages_go_to_the_shared_folder(spark, skewed):
    from types import SimpleNamespace

    stored = write_stage(skewed, "trial")
    folder = spark.conf.get("spark.checkpoint.dir", None)
    assert stored.exceptAll(skewed).isEmpty() and stored.count() == 3000
    assert folder is None or all(f.split(":", 1)[1].lstrip("/").startswith(folder.strip("/")) for f in stored.inputFiles())
    with_master = lambda m: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: m if k == "spark.master" else d))
    unset = with_master("local[2]")
    assert shared_root(unset) == shared_root(unset)
    with pytest.raises(ValueError, match="checkpoint"):
        shared_root(with_master("yarn"))


def test_quantiles_keep_a_null_group_on_both_paths(spark):
    rows = [("a", 1.0), ("a", 3.0), (None, 5.0), (None, 7.0), (None, 7.0), ("b", None), *(("hot", float(i % 50)) for i in range(400))]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"q1": 0.25, "median": 0.5}
    small = {tuple(r) for r in group_quantiles(df, "k", "v", probs).collect()}
    large = {tuple(r) for r in group_quantiles(df, "k", "v", probs, max_group_values=1, block_rows=7).collect()}
    assert small == large and {r[0] for r in small} == {"a", None, "hot"}
    box = {r["k"]: (r["median"], r["n_outliers"]) for r in boxplot_summary(df, "k", "v").collect()}
    assert box[None] == (7.0, 0)
    assert box["a"] == (2.0, 0)


def test_splits_refuse_null_and_repeated_ids(spark):
    with pytest.raises(ValueError, match="null"):
        hash_cuts(spark.createDataFrame([(1,), (None,)], "i bigint"), hash_key("s", "i"), [1])
    with pytest.raises(ValueError, match="repeat"):
        hash_cuts(spark.createDataFrame([(1,)] * 10, "i bigint"), hash_key("s", "i"), [5])


def test_vocabulary_takes_text_ids(spark):
    docs = spark.createDataFrame([("d2", ["b", "a"]), ("d1", ["c", "b"])], "row_index string, tokens array<string>")
    fitted = fit_vocabulary(docs)
    assert {(r["term"], r["term_index"], r["df"]) for r in fitted.terms.collect()} == {("c", 0, 1), ("b", 1, 2), ("a", 2, 1)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_with_null_and_hot_keys(spark, how):
    left = spark.createDataFrame(
        [(i, None if i % 3 == 0 else 7 if i % 3 == 1 else i % 20, "same") for i in range(600)], "i bigint, k bigint, t string"
    )
    right = spark.createDataFrame([(k, f"r{k}") for k in range(0, 20, 2)] + [(7, "hot"), (None, "null")], "k bigint, r string")
    got = lookup_join(left, right, "k", how, spread_by="i", max_broadcast_rows=0)
    plain = left.join(right, "k", how)
    assert sorted(map(str, got.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_rows_that_repeat_whole_are_split(spark):
    """A third of the rows are equal: they are dealt over the pieces all the same, and none is lost or doubled."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), F.lit("same").alias("x"))
    right = spark.createDataFrame([(k, k * 10) for k in range(60)], "k bigint, v bigint")
    joined = lookup_join(df, right, "k", "left", spread_by=EACH_ROW, max_broadcast_rows=0, hot_share=20)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, df.join(right, "k", "left").collect()))
    plan = joined._jdf.queryExecution().toString()
    assert "__number" in plan and joined.columns == ["k", "x", "v"]


def test_sizes_are_measured_by_type(spark):
    df = spark.createDataFrame([("é" * 10, [1.0] * 5, ["ab", None], (1, "x"))], "a string, b array<double>, c array<string>, d struct<p:int,q:string>")
    bytes_of = 20 + 16 + 5 * 8 + 16 + (2 + 16 + 16) + 16 + 8 + 8 + 1 + 16
    assert fits_broadcast(df, max_bytes=bytes_of) and not fits_broadcast(df, max_bytes=bytes_of - 1)
    assert fits_broadcast(df.limit(0), max_rows=0, max_bytes=0)
