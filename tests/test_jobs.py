"""Whole flows on small fixtures: datasets, embedding jobs, review tables, files."""

import json
import math

import pytest
from pyspark.sql import functions as F

from textreg.operators import aggregates as A
from textreg.operators.dense import encode_texts, hashing_encoder
from textreg.operators.shaping import ARTICLE_LAYOUT, to_article_layout, union_article_sources
from textreg.plans import datasets, review
from textreg.operators.experiment import collect_results
from textreg.plans.embedding_job import (
    EmbeddingMethods, TextDataset, load_strategy, run_embeddings, run_stored_experiment, store_split,
)
from textreg.sources import files as IO
from textreg.streaming.incremental import new_keys, read_partitioned, upsert_partition


def test_realty_table(spark):
    columns = [*datasets.REALTY_NUMBERS, *datasets.REALTY_COUNTS, *datasets.REALTY_TEXTS]
    ads = spark.createDataFrame([("1", *["10,5"] * 5, *["3"] * 5, *["t"] * 4), ("2", *[None] * 10, *[None] * 4)],
                                "id string, " + ", ".join(f"{c} string" for c in columns))
    features = spark.createDataFrame([("1", "Área (m²)", "Piscina"), ("1", "Área (m²)", "Piscina"), ("9", "x", "y")],
                                     "realty string, name string, word string")
    rows = {r["id_realty"]: r for r in datasets.realty_table(ads, features).collect()}
    assert rows[1]["vl_price"] == 10.5 and rows[1]["n_garages"] == 3 and rows[1]["fg_has_area_piscina"] == 1
    assert rows[2]["vl_price"] == 0 and rows[2]["fg_has_area_piscina"] == 0 and rows[2]["nm_title"] is None
    assert set(rows) == {1, 2} and rows[1]["fg_has_x_y"] == 0


def test_minutes_table(spark):
    minutes = spark.createDataFrame([
        ("2020-01-01T03:00:00Z", "before", "x"), ("2020-02-03T03:00:00Z", "a", "text a"), ("2020-03-04T03:00:00Z", "b", "text b"),
        ("2020-04-05T03:00:00Z", "no text", None), ("2020-05-06T03:00:00Z", "no rate", "text"), ("2020-06-07T03:00:00Z", "last", "text"),
    ], "DataReferencia string, Titulo string, Texto string")
    rates = spark.createDataFrame([("03/02/2020", "4.25"), ("04/03/2020", "3.75"), ("05/04/2020", "3.0"), ("07/06/2020", "2.25"), ("08/06/2020", None)],
                                  "data string, valor string")
    rows = datasets.minutes_table(minutes, rates).orderBy("sequencia").collect()
    assert [(r["sequencia"], r["titulo"], r["selic_atual"], r["selic_next"], r["selic_next_var"]) for r in rows] == [
        (0, "a", 4.25, 3.75, -0.5), (1, "b", 3.75, 3.0, -0.75)]


def test_lyrics_and_streams(spark):
    songs = spark.createDataFrame([
        ("forro", 1, "Canção - Ao Vivo", "Zé", "l1", (["p1", "p2", "p3"], 10)), ("forro", 2, "Vazia", "Ana", "l2", ([], 5)),
    ], "genre string, index long, title string, artist string, link string, data struct<lyrics:array<string>,n_views:bigint>")
    paragraphs = datasets.lyric_paragraphs(songs)
    assert sorted((r["index"], r["paragraph"], r["lyrics"] or "") for r in paragraphs.collect()) == [
        (1, 1, "p1"), (1, 2, "p2"), (1, 3, "p3"), (2, 0, "")]
    whole = datasets.whole_lyrics(paragraphs.filter("lyrics is not null"))
    assert whole.first()["lyrics"] == "p1\n\np2\n\np3"
    history = spark.sql("""select * from values ('s1', 'CANCAO', 'zé', date'2020-01-01', 0L), ('s1', 'CANCAO', 'zé', date'2020-02-01', 7L),
        ('s1', 'CANCAO', 'zé', date'2020-08-01', 99L), ('s1', 'CANCAO', 'zé', date'2020-08-01', 99L), ('s2', 'other', 'x', date'2020-08-01', 1L)
        as t(songstats_id, nome_musica, nome_artista, data_mensal, streams_total_min)""")
    rows = datasets.song_streams(whole, history).collect()
    assert [(r["title"], r["streams_total_min"]) for r in rows] == [("Canção - Ao Vivo", 99)]


@pytest.fixture(scope="module")
def sheet(spark):
    rows = [
        ("A01", "Health, Finance", "T1, T2", "Linear, Deep (Sequential, Recurrent, & Attention)", "BoW, TF-IDF", "Documents, Sentence (Lemmatized Word)",
         "RMSE, R2", "open-source data, fast", "Brazil, USA", "English, and Portuguese", "1000; 10", 0.5),
        ("A02", "Health", "T3", "Linear", "BoW", "Document", None, "Fast", "Brazil", "English", "90 rows", 0.2),
        ("A03", None, "T1", "Linear", "BoW", "Document", "RMSE", "Fast", "USA", "English", "5", 0.1),
    ]
    names = ["article", "domain", "target", "model_class", "embedding", "strategy", "metric", "advantage", "nationality", "language", "size", "gain"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n == 'gain' else 'string'}" for n in names))
    return df.withColumnsRenamed({**{k: v for k, v in review.COLUMNS.items() if k in names}, "article": review.CODE})


def test_review_tables(spark, sheet):
    df = review.coded_articles(sheet)
    counts = lambda field, **kw: {r[field]: r["len"] for r in review.publications_by(df, field, **kw).collect()}
    assert counts("domain") == {"Health": 2, "Finance": 1}
    assert counts("metric") == {"RMSE": 2, "R2": 1}
    assert counts("advantage") == {"Open-Source Data": 1, "Fast": 2}
    assert counts("strategy") == {"Document": 2, "Sentence": 1}
    assert counts("target", classes={"Count": ["T1", "T2"], "Ordinal": ["T2", "T3"]}) == {"Count": 1, "Ordinal": 1}
    assert set(counts("model_class")) == {"Linear", "Deep (Sequential, Recurrent & Attention)"}
    heat = {r["domain"]: (r["BoW"], r["TF-IDF"]) for r in review.publications_heatmap(df, "domain", "embedding").collect()}
    assert heat == {"Health": (2, 1), "Finance": (1, 1)}
    lang = {r["nationality"]: (r["English"], r["Portuguese"]) for r in review.nationality_language(df).collect()}
    assert lang == {"Brazil": (2, 1), "USA": (1, 1)}
    box, order = review.log_size_by(df, "embedding")
    assert order.first()["embedding"] == "TF-IDF"
    a01 = (math.log(1000) + math.log(10)) / 2
    assert {r["embedding"]: round(r["median"], 6) for r in box.collect()} == {
        "TF-IDF": round(a01, 6), "BoW": round((a01 + math.log(90)) / 2, 6)}
    gain = {r["embedding"]: r["median"] for r in review.gain_by(df, "embedding")[0].collect()}
    assert gain == {"BoW": 35.0, "TF-IDF": 50.0}
    eff = {r["embedding"]: r["relative_efficiency"] for r in review.efficiency_by(df, "embedding").collect()}
    assert eff == {"TF-IDF": 0.5, "BoW": 0.36}
    cells = {r["model_class"]: r["BoW"] for r in review.efficiency_heatmap(df, "model_class", "embedding").collect()}
    assert cells["Linear"] == pytest.approx(0.36)
    assert {r["domain"]: round(r["BoW"], 6) for r in review.gain_heatmap(df, "domain", "embedding").collect()} == {"Health": 0.35, "Finance": 0.5}


def test_embedding_job(spark, tmp_path):
    root = str(tmp_path)
    texts = ["red fox jumps", "blue fox", "green bird sings loud", "the", "red bird"] * 2
    df = spark.createDataFrame([(i, t, None if i == 3 else "note", float(i)) for i, t in enumerate(texts)], "id long, title string, body string, y double")
    data = TextDataset("toy", "y", ["title", "body"])
    store_split(df, data, root, "id")
    sizes = {s: spark.read.parquet(f"{root}/db/{s}/toy/rows").count() for s in ("train", "test")}
    assert sizes == {"train": 8, "test": 2}
    targets = IO.read_enumerated_text(spark, f"{root}/db/test/toy/targets").orderBy("row_index").collect()
    assert [r["row_index"] for r in targets] == [0, 1]
    vectors = spark.createDataFrame([("red", [1.0, 0.0]), ("note", [0.0, 1.0])], "term string, vec array<float>")
    methods = EmbeddingMethods({"Word2Vec": vectors}, {"Hashing": lambda d, c: encode_texts(d, c, hashing_encoder(8), 8)})
    with pytest.raises(FileNotFoundError, match="train"):
        run_embeddings(spark, root, [data], methods, ["test"], ["BoW"])
    out = run_embeddings(spark, root, [data], methods, ["test", "train"])
    assert set(out) == {(s, "toy", m) for s in ("train", "test") for m in ("BoW", "n-gram+BoW", "TF-IDF", "Word2Vec", "Hashing")}
    for (split, _, method), rows in out.items():
        first = rows.orderBy("row_index").first()
        assert rows.count() == sizes[split] and first["embedding_method"] == method
        assert first["embedding_storage"] == ("dense" if method in ("Word2Vec", "Hashing") else "sparse")
    width = {r["embedding_size"] for s in ("train", "test") for r in out[s, "toy", "TF-IDF"].collect()}
    assert len(width) == 1
    with pytest.raises(ValueError, match="unknown method"):
        run_embeddings(spark, root, [data], methods, chosen=["LSA"])


def test_methods_of_the_same_terms_share_a_fit(spark, tmp_path, monkeypatch):
    from textreg.operators.vectorize import FittedVocabulary
    from textreg.plans import embedding_job

    fits, real = [], embedding_job.fit_vocabulary
    monkeypatch.setattr(embedding_job, "fit_vocabulary", lambda docs, method, n: (fits.append(method), real(docs, method, n))[1])
    data, root = TextDataset("d", "y", ["text"]), str(tmp_path)
    store_split(spark.createDataFrame([(k, float(k), f"red word{k % 3} blue") for k in range(20)], "id bigint, y double, text string"), data, root, "id")
    run_embeddings(spark, root, [data], EmbeddingMethods({}, {}), ["train"], ["BoW", "TF-IDF"])
    assert fits == ["BoW"]
    a, b = (FittedVocabulary.load(spark, f"{root}/state/d__{name}") for name in ("bow", "tf_idf"))
    assert (a.method, b.method) == ("BoW", "TF-IDF") and sorted(a.terms.collect()) == sorted(b.terms.collect())


def test_sorted_split(spark, tmp_path):
    df = spark.range(10).select("id", (100 - F.col("id")).alias("when"), F.col("id").cast("double").alias("y"), F.lit("t").alias("t"))
    store_split(df, TextDataset("s", "y", ["t"]), str(tmp_path), "id", sort_by="when")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/db/train/s/targets").collect()]
    assert sorted(lines, key=lambda x: int(x.split(".")[0])) == [f"{i}. {10.0 - i}" for i in range(1, 9)]


def test_files(spark, tmp_path):
    for name, body in {"a_General.csv": "", "a_Dense.csv": '"x, ""y""",2023\nz,2020\n'}.items():
        (tmp_path / name).write_text("title,year\n" + body)
    rows = IO.read_csv_files(spark, [str(tmp_path / n) for n in ("a_General.csv", "a_Dense.csv")], "title string, year int").collect()
    assert sorted((r["title"], r["year"]) for r in rows) == [('x, "y"', 2023), ("z", 2020)]
    assert all(r["filename"].endswith("a_Dense.csv") for r in rows)
    (tmp_path / "s.json").write_text(json.dumps([{"category": "c", "search_strings": ["p", "q"]}, {"category": "d", "search_strings": []}]))
    found = IO.read_search_strings(spark, str(tmp_path / "s.json")).collect()
    assert sorted((r[0], r[1] or "") for r in found) == [("c", "p"), ("c", "q"), ("d", "")]
    (tmp_path / "ads.csv").write_bytes("id;preço\n1;é,5\n".encode("latin-1"))
    assert IO.read_csv_dialect(spark, str(tmp_path / "ads.csv")).collect() == [("1", "é,5")]
    assert IO.write_csv_unless_empty(spark.range(0), str(tmp_path / "none")) is False and not (tmp_path / "none").exists()
    assert IO.write_csv_unless_empty(spark.range(2), str(tmp_path / "two")) is True


def test_articles_group_over_categories(spark):
    first = spark.createDataFrame([("t1", 2023, 4, "u", None, "c1"), ("t1", 2023, 4, "u", None, "c2"), ("t1", 2023, 4, "u", None, "c2")],
                                  "t string, y int, n int, u string, p string, c string")
    second = spark.createDataFrame([("t2", 2024)], "t string, y int")
    both = union_article_sources(
        to_article_layout(first, {"title": "t", "year": "y", "citations": "n", "link": "u", "pdf_link": "p", "category": "c"}, "one"),
        to_article_layout(second, {"title": "t", "year": "y"}, "two"),
    )
    assert dict(both.dtypes) == ARTICLE_LAYOUT
    grouped = {r["title"]: r for r in A.collect_categories(both, "category").withColumn("list", A.category_list("categories")).collect()}
    assert grouped["t1"]["list"] == ["c1", "c2", "c2"] and grouped["t2"]["citations"] == -1 and len(grouped) == 2


def test_incremental_loading(spark, tmp_path):
    path, schema = str(tmp_path / "songs"), "id bigint, v bigint, genre string"
    start = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], schema)
    upsert_partition(start, path, "genre")
    upsert_partition(spark.createDataFrame([(3, 3, "b")], schema), path, "genre")
    assert sorted(tuple(r) for r in read_partitioned(spark, path, schema).collect()) == [(1, 1, "a"), (3, 3, "b")]
    fresh = new_keys(spark.createDataFrame([(5, 5, "c"), (6, 6, "a")], schema), read_partitioned(spark, path, schema), "genre")
    assert [r["genre"] for r in fresh.collect()] == ["c"]


def test_funnel_and_terms(spark):
    df = spark.range(10).withColumn("y", F.when(F.col("id") > 1, 2020 + F.col("id")))
    rows = A.funnel_counts(df, {"recent": F.col("y") >= 2023, "odd": F.col("id") % 2 == 1}).orderBy("step").collect()
    assert [(r["stage"], r["n"]) for r in rows] == [("input", 10), ("recent", 7), ("odd", 4)]
    text = spark.createDataFrame([("The cats and a cat, CATS!",)], "t string")
    base = spark.createDataFrame([("cats", "cat")], "word string, base string")
    assert [tuple(r) for r in A.term_frequencies(A.word_counts(text, "t", ["the", "and", "a"]), base).collect()] == [("cat", 3)]


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_stored_embeddings_become_an_experiment(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(30).select("id", F.concat(F.lit("word"), F.col("id") % 4, F.lit(" other")).alias("title"), (F.col("id") % 4 - 1.0).alias("y"))
    data = TextDataset("toy", "y", ["title"])
    store_split(df, data, root, "id")
    run_embeddings(spark, root, [data], EmbeddingMethods({}, {"Hashing": lambda d, c: encode_texts(d, c, hashing_encoder(8), 8)}), chosen=["TF-IDF", "Hashing"])
    for method, storage in (("TF-IDF", "sparse"), ("Hashing", "dense")):
        strategy = load_strategy(spark, root, data, method, "music")
        assert strategy.storage == storage and (strategy.train.count(), strategy.test.count()) == (24, 6)
        for split, rows in (("train", strategy.train), ("test", strategy.test)):
            stored = {r["row_index"]: r["y"] for r in rows.collect()}
            want = {r["row_index"]: math.log1p(max(r["target"], 0)) for r in IO.read_enumerated_text(spark, f"{root}/db/{split}/toy/targets").collect()}
            assert stored == pytest.approx(want)
    raw = load_strategy(spark, root, data, "TF-IDF", "minutes")
    assert raw.train.agg(F.min("y")).first()[0] == -1.0
    scores = run_stored_experiment(spark, root, data, ["TF-IDF"], "music", results=f"{root}/results", models=["Ridge"], n_splits=2, n_repeats=1)
    assert scores.count() == 3 and collect_results(spark, f"{root}/results", "toy").count() == 1
    spark.createDataFrame([("1. 5",)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/db/test/toy/targets")
    with pytest.raises(ValueError, match="do not line up"):
        load_strategy(spark, root, data, "TF-IDF", "music")


def test_article_flow_of_known_size(spark, tmp_path):
    """Eight files of 225 records, two of them empty: 172 from 2023 on, 87 articles, 44 of them in several categories."""
    sizes = [70, 26, 24, 11, 56, 38, 0, 0]
    files = [[] for _ in sizes]
    room = lambda k: sizes[k] - len(files[k])
    articles = [(f"several {k}", 3 if k < 41 else 2) for k in range(44)] + [(f"once {k}", 1) for k in range(43)]
    for title, copies in articles:
        for k in sorted(range(8), key=lambda k: -room(k))[:copies]:
            files[k].append((title, 2023 + len(title) % 3))
    for k in range(8):
        files[k] += [(f"old {k} {i}", 2022 - i % 5) for i in range(room(k))]
    paths = []
    for k, rows in enumerate(files):
        paths.append(str(tmp_path / f"articles_c{k}.csv"))
        with open(paths[-1], "w") as f:
            f.write("title,year,url\n" + "".join(f"{t},{y},http://x/{t}\n" for t, y in rows))
    found = IO.read_csv_files(spark, paths, "title string, year int, url string")
    assert found.count() == 225 and sum(len(f) == 0 for f in files) == 2
    category = F.regexp_extract("filename", r"([^_]+)\.csv$", 1)
    recent = found.filter("year >= 2023").select("title", "year", "url", category.alias("category"))
    assert recent.count() == 172
    grouped = A.collect_categories(recent, "category").withColumn("n", F.size("categories"))
    assert grouped.count() == 87 and grouped.filter("n > 1").count() == 44
