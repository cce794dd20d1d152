"""Tokens, vocabularies and pooled vectors on small texts with known results."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textreg.functions import tokens as K
from textreg.functions.stopwords import ENGLISH, stop_words
from textreg.operators import dense as D
from textreg.operators import vectorize as V
from textreg.operators.reshape import sparse_rows_to_triplets, triplets_to_sparse_rows


def docs(spark, texts):
    """Lower-cased, split at blanks."""
    rows = [(i, t.lower().split()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "row_index bigint, tokens array<string>")


def rows_of(df):
    return [
        (list(r["embedding_indices"]), [round(v, 6) for v in r["embedding_values"]])
        for r in df.orderBy("row_index").collect()
    ]


def test_bag_of_words(spark):
    d = docs(spark, ["Cheap garden house", "Garden terrace house"])
    fitted = V.fit_vocabulary(d, "bow")
    vocabulary = {r["term"]: r["term_index"] for r in fitted.terms.collect()}
    assert vocabulary == {"cheap": 0, "garden": 1, "house": 2, "terrace": 3} and fitted.size == 4
    assert rows_of(V.transform_documents(d, fitted)) == [([0, 1, 2], [1, 1, 1]), ([1, 2, 3], [1, 1, 1])]


def test_tf_idf(spark):
    d = docs(spark, ["rate falls again", "rate again rises"])
    weight = round(math.log(3 / 2) + 1, 6)
    result = rows_of(V.fit_transform(d, "TF-IDF"))
    assert result == [([0, 1, 2], [1, pytest.approx(weight, abs=1e-6), 1]), ([0, 2, 3], [1, 1, pytest.approx(weight, abs=1e-6)])]


def test_ngram_vocabulary_comes_after_the_tokens(spark):
    d = docs(spark, ["a b a", "b"])
    terms = {r["term"]: r["term_index"] for r in V.fit_vocabulary(d, "ngram+BoW").terms.collect()}
    assert terms == {"a": 0, "b": 1, "a b": 2, "b a": 3}


def test_unknown_terms_drop_and_empty_documents_stay(spark):
    fitted = V.fit_vocabulary(docs(spark, ["x y", ""]))
    out = V.transform_documents(docs(spark, ["y z y", "", "z"]), fitted)
    assert rows_of(out) == [([1], [2]), ([], []), ([], [])]
    assert {r["embedding_size"] for r in out.collect()} == {2}


def test_struct_and_packed_order_agree(spark):
    d = docs(spark, ["b a", "c a b"])
    far = d.withColumn("row_index", F.col("row_index") + (1 << 45))
    pick = lambda f: {r["term"]: (r["term_index"], r["df"]) for r in f.terms.collect()}
    assert pick(V.fit_vocabulary(d)) == pick(V.fit_vocabulary(far)) == {"b": (0, 2), "a": (1, 2), "c": (2, 1)}


def test_state_round_trip_and_missing_state(spark, tmp_path):
    fitted = V.fit_vocabulary(docs(spark, ["p q", "q"]), "tfidf")
    fitted.save(str(tmp_path / "state"))
    loaded = V.FittedVocabulary.load(spark, str(tmp_path / "state"))
    assert (loaded.method, loaded.n_documents, loaded.size) == ("TF-IDF", 2, 2)
    assert sorted(loaded.terms.collect()) == sorted(fitted.terms.collect())
    with pytest.raises(FileNotFoundError, match="train"):
        V.FittedVocabulary.load(spark, str(tmp_path / "nothing"))


def test_method_names():
    assert [V.method_name(m) for m in (" BoW", "n-gram + bow", "TF IDF")] == ["BoW", "n-gram+BoW", "TF-IDF"]
    with pytest.raises(ValueError, match="unknown method"):
        V.method_name("LSA")


def test_embed_dispatch(spark):
    d = docs(spark, ["a b", "c"])
    vectors = spark.createDataFrame([("a", [1.0, 0.0])], "term string, vec array<float>")
    assert V.embed(d, "bow").count() == 2
    assert [list(r["embedding"]) for r in V.embed(d, "GloVe", vectors=vectors).orderBy("row_index").collect()] == [[1, 0], [0, 0]]
    assert V.embed(d, "RoBERTa", encoder=lambda x: x.limit(1)).count() == 1
    for method in ("word2vec", "encoder", "other"):
        with pytest.raises(ValueError):
            V.embed(d, method)


@pytest.mark.parametrize(("texts", "vectors", "expected"), [
    (["blue river", "other words"], {"blue": [2, 0, 0], "river": [0, 0, 4]}, [[1, 0, 2], [0, 0, 0]]),
    (["slow song", "no match"], {"slow": [1, -1, 3, 0.5], "song": [3, 1, 1, 1.5]},
     [[2, 0, 2, 1], [0, 0, 0, 0]]),
    (["blue blue river", ""], {"blue": [3, 0], "river": [0, 3]}, [[2, 1], [0, 0]]),
])
def test_word_vector_mean(spark, texts, vectors, expected):
    table = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "term string, vec array<float>")
    out = D.word_vector_mean(docs(spark, texts), table).orderBy("row_index").collect()
    assert np.allclose([r["embedding"] for r in out], expected, atol=1e-6)


def test_masked_mean_with_empty_mask(spark):
    rows = [(0, [1.0, 2.0], 1), (0, [3.0, 6.0], 0), (1, [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "r int, v array<float>, m int")
    out = {r["r"]: list(r["embedding"]) for r in D.masked_mean_pool(df, "r", "v", "m").collect()}
    assert out == {0: [1, 2], 1: [0, 0]}


def test_sparse_round_trip(spark):
    d = docs(spark, ["a b a", "", "c"])
    rows = V.fit_transform(d, "BoW")
    again = triplets_to_sparse_rows(sparse_rows_to_triplets(rows), d, 3)
    assert rows_of(again) == rows_of(rows)


def test_encoder_batches_and_failures(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["one two", None, "boom", "three"])], "i int, t string")
    encoded = {r["i"]: r["embedding"] for r in D.encode_texts(df, "t", D.hashing_encoder(16), 16, batch_size=2).collect()}
    assert len(encoded) == 4 and not any(encoded[1]) and np.linalg.norm(encoded[0]) == pytest.approx(1)

    def failing():
        def encode(texts):
            if "boom" in texts:
                raise RuntimeError("no answer")
            return np.ones((len(texts), 3))

        return encode

    out = D.encode_texts(df, "t", failing, 3, batch_size=1, zeros_on_error=True).collect()
    assert {r["i"]: list(r["embedding"]) for r in out} == {0: [1] * 3, 1: [1] * 3, 2: [0] * 3, 3: [1] * 3}
    with pytest.raises(Exception, match="no answer"):
        D.encode_texts(df, "t", failing, 3, batch_size=1).collect()
    with pytest.raises(ValueError, match="batch_size"):
        D.encode_texts(df, "t", failing, 3, batch_size=0)
    assert D.encode_texts(df.limit(0), "t", failing, 3).count() == 0


def test_tokenizing(spark):
    df = spark.createDataFrame([("Don't stop! É 3.5% já.\tOk? yes",)], "t string")
    row = df.select(
        K.tokenize_words("t").alias("w"), K.tokenize_sentences("t").alias("s"), K.ngrams(K.tokenize_words("t"), 3).alias("g"),
        K.tokenize_by_strategy("t", " Sentence ").alias("k"), K.truncate_tokens(K.tokenize_words("t"), 2).alias("two"),
        K.ngrams(F.array(F.lit("x")), 2).alias("none"),
    ).first()
    assert row["w"] == ["don", "'", "t", "stop", "!", "é", "3", ".", "5", "%", "já", ".", "ok", "?", "yes"]
    assert row["s"] == ["Don't stop!", "É 3.5% já.", "Ok?", "yes"]
    assert row["g"][0] == "don ' t" and len(row["g"]) == 13 and row["none"] == [] and row["two"] == ["don", "'"]
    assert row["k"] == ["'", "stop", "!", "é", "3", ".", "5", "%", "já", ".", "ok", "?", "yes"]
    for bad in (lambda: K.tokenize_by_strategy("t", "page"), lambda: K.ngrams("t", 1), lambda: K.truncate_tokens("t", 0)):
        with pytest.raises(ValueError):
            bad()


def test_stop_words(spark):
    assert len(ENGLISH) == len(set(ENGLISH)) and stop_words("English") is ENGLISH
    assert "não" in stop_words("portuguese")


@pytest.mark.parametrize("n", [None, 2, 3])
def test_terms_of_a_piece_against_counting(n, monkeypatch):
    texts = [["a", "b", "a", "b", "c"], [], ["b"], None, ["c", "a", "b", "a", "c", "a", "b"], ["a"] * 5]
    blank = [["a b", "c", "a", "b c", "a b"], ["a", "b", "c", "a", "b"], ["x", None, "y", "x", "y"]]
    for lists in (texts, blank):
        terms, term, doc, place, count = V._terms(pa.array(lists, pa.list_(pa.string())), n)
        names = terms.to_pylist()
        got = {(names[t], int(d)): (int(p), int(c)) for t, d, p, c in zip(term, doc, place, count, strict=True)}
        want = {}
        for d, tokens in enumerate(lists):
            tokens = tokens or []
            grams = [" ".join(w for w in tokens[i : i + n] if w is not None) for i in range(len(tokens) - n + 1)] if n else []
            for p, w in enumerate([*tokens, *grams]):
                if w is not None:
                    first, k = want.get((w, d), (p, 0))
                    want[w, d] = first, k + 1
        assert got == want and len(names) == len(set(names)) == len({w for w, _ in want}) and list(term) == sorted(term)


def test_a_term_meets_the_vocabulary_once_for_many_documents(spark, monkeypatch):
    d = docs(spark, ["a b a", "b", "", "c a b", "z"] * 40).coalesce(1)
    fitted = V.fit_vocabulary(d.filter("row_index % 5 < 4"))
    joined, real = [], V.lookup_join
    monkeypatch.setattr(V, "lookup_join", lambda left, *a, **k: (joined.append(left.count()), real(left, *a, **k))[1])
    entries = [tuple(r) for r in V.weighted_terms(d, fitted).collect() if r["term_index"] is not None]
    # Four terms and the list of all documents, not 240 pairs.
    assert joined == [5]
    by = {0: {(0, 2.0), (1, 1.0)}, 1: {(1, 1.0)}, 2: set(), 3: {(0, 1.0), (1, 1.0), (2, 1.0)}, 4: set()}
    assert sorted(entries) == sorted((i, t, v) for i in range(200) for t, v in by[i % 5])
