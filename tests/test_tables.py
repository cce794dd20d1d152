"""Cross-tabulations of any width, ranks within groups, and stored embeddings as strategies."""

import random

import pytest
from pyspark.sql import functions as F

from textreg.operators import reshape as R
from textreg.plans import datasets
from textreg.plans.ordering import page_ranks, top_per_group


def test_sparse_crosstab_is_the_pivot(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", "c", None]), r.choice(["u", "v", "w"]), r.choice([0.0, 1.5, -2.0, None])) for _ in range(80)] + [("only zeros", "u", 0.0)]
    df = spark.createDataFrame(rows, "x string, y string, cell double")
    for how in ("sum", "mean"):
        wide = {row["x"]: row.asDict() for row in R.crosstab(df, "x", "y", "cell", how).collect()}
        table = R.sparse_crosstab(df, "x", "y", "cell", how)
        names = {c["column_index"]: c["y"] for c in table.columns.collect()}
        assert sorted(names.items()) == [(0, "u"), (1, "v"), (2, "w")]
        got = table.rows.collect()
        assert len(got) == len(wide)
        for row in got:
            cells = {names[i]: v for i, v in zip(row["column_indices"], row["column_values"], strict=True)}
            assert 0 not in cells.values() and row["n_columns"] == 3
            assert {**dict.fromkeys("uvw", 0), **cells} == pytest.approx({k: v for k, v in wide[row["x"]].items() if k != "x"})


def test_a_million_columns(spark):
    df = spark.range(1_000_000).select((F.col("id") % 1000).alias("x"), F.concat(F.lit("c"), F.col("id")).alias("y"))
    table = R.sparse_flags(df, "x", "y")
    assert table.columns.count() == 1_000_000
    facts = table.rows.agg(F.count("*"), F.min(F.size("column_indices")), F.max(F.size("column_indices")), F.max("n_columns"), F.max(F.array_max("column_values")))
    assert tuple(facts.first()) == (1000, 1000, 1000, 1_000_000, 1)
    with pytest.raises(ValueError, match="sparse_crosstab"):
        R.pivot_flags(df, "x", "y")


def test_null_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None), ("a", "u"), (None, None)], "x string, y string")
    table = R.sparse_flags(df, "x", "y")
    assert [(c["column_index"], c["y"]) for c in table.columns.orderBy("column_index").collect()] == [(0, None), (1, "u")]
    assert {r["x"]: r["column_indices"] for r in table.rows.collect()} == {"a": [0, 1], None: [0]}
    assert R.sparse_flags(df.limit(0), "x", "y").rows.isEmpty()
    with pytest.raises(ValueError, match="how"):
        R.sparse_crosstab(df, "x", "y", F.lit(1), "median")


def test_sparse_realty_table_has_the_flags_of_the_wide_one(spark):
    numbers = ["price", "iptu", "condominium", "totalArea", "usefulArea", "pictures", "bedroom", "bathroom", "garage", "years"]
    ads = spark.createDataFrame([(str(k), *["1,5"] * 10, "t", f"title {k}", "d", "a") for k in range(1, 5)],
                                ", ".join(f"`{c}` string" for c in ["id", *numbers, "type", "title", "description", "address"]))
    features = spark.createDataFrame([("1", "Área", "Pool (big)"), ("1", "Area", "Gym"), ("3", "Area", "Gym"), ("x", "Area", "Gym")], "realty string, name string, word string")
    wide = {r["id_realty"]: r.asDict() for r in datasets.realty_table(ads, features).collect()}
    rows, flags = datasets.realty_table_sparse(ads, features)
    names = {f["column_index"]: f["flag"] for f in flags.collect()}
    for r in rows.collect():
        assert {names[i] for i in r["flags"]} == {k for k, v in wide[r["id_realty"]].items() if k.startswith("fg_has_") and v == 1}


def test_ranks_within_groups(spark):
    rows = [(g, k, (k * 7) % 10) for g in ("a", "b", None) for k in range(25)]
    df = spark.createDataFrame(rows, "g string, id int, x int")
    top = {(r["g"], r["rank"]): r["id"] for r in top_per_group(df, "g", [F.desc("x"), "id"], 3).collect()}
    order = sorted(range(25), key=lambda k: (-((k * 7) % 10), k))
    assert top == {(g, i + 1): order[i] for g in ("a", "b", None) for i in range(3)}
    pages = page_ranks(df.filter("g IS NOT NULL"), "g", ["x", "id"], "id", per_page=4).collect()
    order = sorted(range(25), key=lambda k: ((k * 7) % 10, k))
    assert {(r["g"], r["id"]): (r["nr_page"], r["nr_order"]) for r in pages} == {(g, k): (i // 4 + 1, i + 1) for g in "ab" for i, k in enumerate(order)}
    for bad in (lambda: top_per_group(df, "g", ["x"], 0), lambda: page_ranks(df, "g", ["x"], "id", 0)):
        with pytest.raises(ValueError, match=">= 1"):
            bad()
