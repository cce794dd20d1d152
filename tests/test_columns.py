"""Column functions on edge cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from textreg.functions import numeric as N
from textreg.functions import text as T
from textreg.functions.html import extract_html
from textreg.operators import quality as Q
from textreg.operators import reshape as R
from textreg.operators import shaping as S


def values(spark, texts, build):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["v"] for r in df.select("i", build("t").alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(("build", "cases"), [
    (T.strip_accents, {"Ação É ñ ü": "Acao E n u", "é": "e", "ß 漢": "ß 漢", None: None}),
    (T.title_key, {"A B - C / D": "a_b", "É / x - y": "e_/_x", "a \\ b": "a", "a | b": "a", "": None, None: None, "x-y": "x-y"}),
    (T.normalize_feature_name, {" Área  (m²) Útil (x) ": "area_util", "Área m² útil": "area_m2_util", "1º\u00a0andar – “A”": '1o_andar_-_"a"', "Größe": "grosse", None: None}),
    (T.strip_lower, {"\t Ab \n": "ab"}),
    (lambda c: T.replace_first(c, r"and\s+", ""), {"and a and b": "a and b", "none": "none", "": "", None: None}),
    (lambda c: T.replace_first(c, " & ", ", ", literal=True), {"a & b & c": "a, b & c"}),
    (lambda c: T.replace_first(c, "(x)", "", literal=True), {"a(x)(x)": "a(x)"}),
    (T.to_titlecase, {"foo-bar BAZ q": "Foo-Bar Baz Q"}),
    (T.extract_digits_number, {"Rows 123": 123, "12 345": 12345, "1,2 x": None, '"7"': 7, "none": None}),
    (T.strip_tag_prefix, {"[PDF] [x] t": "[x] t", "t [a]": "t [a]"}),
    (T.last_year_in_text, {"1999, 2023-1": "2023", "12023": "", "": ""}),
    (T.first_integer, {"a12b3": 12, "x": 0}),
    (T.view_count, {"1.234.567 views": 1234567, "many": 0, "": 0}),
    (T.local_date, {"2016-06-08T01:00:00Z": datetime.date(2016, 6, 7), "2016-06-08T03:00:00Z": datetime.date(2016, 6, 8)}),
    (T.dayfirst_date, {"03/02/2020": datetime.date(2020, 2, 3), "2020": None}),
    (T.method_slug, {" N-gram + BoW!": "n_gram_bow"}),
    (T.category_from_filename, {"a_b_Dense Embeddings.csv": "Dense Embeddings", "x.csv": "x"}),
    (N.decimal_comma_to_double, {"12,5": 12.5, "1.234,56": 0.0, None: 0.0, "7": 7.0}),
    (N.cast_fill, {"5": 5, "n/a": 0, None: 0}),
])
def test_scalars(spark, build, cases):
    assert values(spark, list(cases), build) == list(cases.values())


def test_payload(spark):
    long = "a" * 6000 + "b" * 5000
    out = values(spark, ["", " x\n\n y", long, "c" * 10_000], T.encoder_payload)
    assert out == [" ", " x y", "b" * 5000, "c" * 10_000]


def test_targets(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (-3.0,), (2.5,)], "y double")
    assert [r[0] for r in df.select(N.sanitize_target("y")).collect()] == [0, 0, 0, 0, 2.5]
    assert df.filter("y = -3").select(N.model_target("y", "minutes")).first()[0] == -3.0
    with pytest.raises(ValueError, match="unknown dataset"):
        N.model_target("y", "films")


def test_verdicts(spark):
    cases = {
        '{"results": {"a": true, "b": false}}': None, '{"results": {"a": true}}': "wrong number of criteria",
        '{"results": {"a": true, "b": "yes"}}': "not boolean", '{"results": {"a": true, "b": null}}': "not boolean",
        '{"results": [1]}': "wrong number of criteria", '{"x": 1}': "missing results", "{oops": "not valid JSON", "": "not valid JSON",
        '{"results": {"a": "true", "b": false}}': "not boolean", '{"results": {"a": true, "b": false}} done': "not valid JSON",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    rows = df.select("i", T.verdicts("t", 2).alias("j")).select("i", F.col("j.verdicts").alias("v"), F.col("j.error").alias("e")).orderBy("i").collect()
    assert [r["e"] for r in rows] == list(cases.values())
    assert rows[0]["v"] == {"a": True, "b": False} and all(r["v"] is None for r in rows[1:])


PAGE = """<html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><a href="/a">First</a><a>no target</a><a href="/b"> Se<b>cond</b> </a></nav><p>outside</p><!-- note -->
<article><h1>H</h1><p>one<br/>two<p>three <i>four</i></p></article><a href="/c">far</a></body></html>"""


def test_html_in_pieces(spark):
    df = spark.createDataFrame([(k, PAGE * (k % 3) if k % 4 else None) for k in range(40)], "id bigint, html string").coalesce(1)
    whole = sorted(extract_html(df, "id", "html").collect())
    assert len(whole) == 40 and sorted(extract_html(df, "id", "html", piece_bytes=1).collect()) == whole
    assert sorted(extract_html(df, "id", "html", piece_bytes=len(PAGE) * 3).collect()) == whole


def test_html_cut_references(spark):
    page = '<title>a&amp;b &amp</title><nav><a href="/q?a=1&copy=2">x &ampy; &#65; &#65 &lt;</a></nav>'
    row = extract_html(spark.createDataFrame([(1, page)], "id bigint, html string"), "id", "html").first()
    assert row["text"] == "a&b &amp x &ampy; A &#65 <"
    assert [tuple(x) for x in row["links"]] == [(1, "/q?a=1&copy=2", "x &ampy; A &#65 <")]


def test_html(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "plain"), (3, None)], "id bigint, html string")
    rows = {r["id"]: r for r in extract_html(df, "id", "html").collect()}
    assert rows[1]["text"] == "T & t First no target Se cond outside H one two three four far"
    assert rows[1]["paragraphs"] == ["one\ntwo", "three four"]
    assert [tuple(x) for x in rows[1]["links"]] == [(1, "/a", "First"), (2, "/b", "Second")]
    assert rows[2]["text"] == "plain" and rows[2]["paragraphs"] == [] and rows[3]["links"] == []
    exploded = R.explode_paragraphs(extract_html(df, "id", "html").select("id", "paragraphs"), "paragraphs")
    assert exploded.filter("id = 2").collect()[0]["paragraphs"] is None and exploded.count() == 4


def test_steps_and_classes(spark):
    df = spark.createDataFrame([(True, True, False), (False, True, True), (True, False, False), (True, True, True), (None, True, False)],
                               "a boolean, b boolean, x boolean")
    step = S.first_failing_step([("a", "IC I"), ("b", "IC II")], [("x", "EC I")])
    ok = S.all_criteria(["a", "b"], ["x"])
    rows = df.select(step.alias("s"), ok.alias("ok")).collect()
    assert [r["s"] for r in rows] == ["Included", "IC I", "IC II", "EC I", "Included"]
    assert [r["ok"] for r in rows] == [True, False, False, False, False]
    assert values(spark, ["p", "q", "z", None], lambda c: S.class_of(c, {"one": ["p", "q"], "two": ["q", "r"]})) == ["one", "one", None, None]


def test_split_explode_and_protect(spark):
    df = spark.createDataFrame([(1, " a, b ,c "), (2, None), (3, "")], "i int, t string")
    assert sorted((r["i"], r["t"]) for r in R.split_explode(df, "t").filter("t is not null").collect()) == [
        (1, "a"), (1, "b"), (1, "c"), (3, "")]
    assert R.split_explode(df, "t").filter("i = 2").collect()[0]["t"] is None
    kept = R.protect_then_split(spark.createDataFrame([("X, Deep (A, B, & C), Y & Z",)], "t string"), "t", "(A, B, & C)")
    assert [r["t"] for r in kept.collect()] == ["X", "Deep (A, B & C)", "Y, Z"]


def test_pivots(spark):
    df = spark.createDataFrame([(1, "u"), (1, "u"), (2, "v"), (3, None)], "i int, k string")
    assert sorted(tuple(r) for r in R.pivot_flags(df.filter("k is not null"), "i", "k").collect()) == [(1, 1, 0), (2, 0, 1)]
    table = R.crosstab(df.withColumn("n", F.lit(2)).replace(3, None, ["i"]), "i", "k", "n", values=["u", "v"])
    assert sorted((r["i"] or -1, r["u"], r["v"]) for r in table.collect()) == [(-1, 0, 0), (1, 4, 0), (2, 0, 2)]
    assert not table.filter("i is null").isEmpty()
    with pytest.raises(ValueError, match="how"):
        R.crosstab(df, "i", "k", "i", "max")


def test_quality(spark):
    base = spark.range(4).select(F.col("id").alias("row_index"), (F.col("id") * 2.0).alias("y"))
    Q.assert_alignment(base, base, "y")
    for broken in (base.filter("row_index < 3"), base.withColumn("y", F.col("y") + 1), base.union(base.limit(1))):
        with pytest.raises(ValueError, match="line up"):
            Q.assert_alignment(base, broken, "y")
    with pytest.raises(ValueError, match="line up"):
        Q.assert_alignment(base.withColumn("row_index", F.col("row_index") + 1), base.withColumn("row_index", F.col("row_index") + 1), "y")
    with pytest.raises(ValueError, match="lacks the columns: z"):
        Q.validate_columns(base, ["y", "z"])
    with pytest.raises(ValueError, match="unknown split"):
        Q.validate_selection(["dev"], ["train", "test"], "split")
    assert Q.validate_selection([], ["train"], "split") == ["train"]
    with pytest.raises(ValueError, match="batch_size"):
        Q.validate_positive(batch_size=0)
