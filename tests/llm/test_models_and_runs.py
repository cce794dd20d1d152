"""Toxicity networks, hard negatives and periodic runs, against plain versions and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import periodic_runs_of
from pyspark.sql import functions as F

from textreg.llm import hard_negatives, periodic, text_cnn, toxicity
from textreg.llm.hard_negatives import mine_hard_negatives
from textreg.llm.periodic import find_runs, periodic_runs
from textreg.llm.queries import QUERIES
from textreg.llm.toxicity import cutoffs, held_out, score_toxicity
from textreg.llm.wavelet import WaveletMatrix

CLASH = "doc_id bigint, text string, id int, kind string, start int, runs int, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, 3, "en") for i, t in rows], CLASH)


# ---- periodic runs ----


def test_wavelet_matrix_against_sorting():
    r = np.random.default_rng(3)
    for n in (1, 2, 7, 64, 300):
        values = r.permutation(n)
        tree = WaveletMatrix(values)
        lo = r.integers(0, n + 1, 200)
        hi = np.minimum(lo + r.integers(0, n + 1, 200), n)
        limit = r.integers(0, n + 1, 200)
        below = tree.below(lo, hi, limit)
        assert below.tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(lo, hi, limit, strict=True)]
        some = np.flatnonzero(below < hi - lo)
        found = tree.smallest(lo[some], hi[some], below[some])
        assert found.tolist() == [int(min(v for v in values[lo[k] : hi[k]] if v >= limit[k])) for k in some]


def _sequences(r, n_docs):
    for _ in range(n_docs):
        n, letters = r.choice([0, 1, 5, 20, 60, 150]), r.choice([1, 2, 2, 3, 10])
        words = [r.randrange(letters) for _ in range(n)]
        if n > 8 and r.random() < 0.6:
            a = r.randrange(n)
            p = r.randrange(1, max(2, (n - a) // 2 + 1))
            for i in range(a, n):
                words[i] = words[a + (i - a) % p]
        yield words


def test_runs_against_scanning_every_period():
    r = random.Random(1)
    for _ in range(300):
        docs = list(_sequences(r, r.randrange(1, 5)))
        least = r.choice([2, 3, 5, 12, 12])
        starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        words = np.array([k * 100 + x for k, d in enumerate(docs) for x in d], np.int64)
        got = list(zip(*[x.tolist() for x in find_runs(words, starts, least)], strict=True))
        assert got == [(s + int(starts[k]), e + int(starts[k]), q) for k, d in enumerate(docs) for s, e, q in periodic_runs_of(d, least)]


def test_runs_of_equal_and_long_periods():
    n = 30_000
    ends = np.array([0, n])
    assert [x.tolist() for x in find_runs(np.zeros(n, np.int64), ends, 12)] == [[0], [n], [1]]
    assert [x.tolist() for x in find_runs(np.arange(n) % 14_000, ends, 12)] == [[0], [n], [14_000]]
    assert [x.tolist() for x in find_runs(np.arange(n) % 15_001, ends, 12)] == [[], [], []]


@pytest.mark.parametrize("batch_bytes, candidates", [(1 << 20, 1 << 19), (40, 3)])
def test_runs_of_documents(spark, monkeypatch, batch_bytes, candidates):
    monkeypatch.setattr(periodic, "BATCH_BYTES", batch_bytes)
    monkeypatch.setattr(periodic, "CANDIDATES", candidates)
    long = " ".join(f"w{k}" for k in range(4000))
    rows = [
        (1, "x " + "a b c " * 5 + "y"), (2, None), (3, ""), (4, " \t\n"), (5, "a b " * 5), (6, " ä\x1cé  \n" * 12), (None, "z " * 12),
        (1, "a\x0bb c"), (7, long), (8, f"{long} {long}"),
    ]
    got = periodic_runs(frame(spark, rows)).collect()
    by_text = {(r["doc_id"], r["n_words"]): ([tuple(x) for x in r["runs"]], r["collapsed"]) for r in got}
    assert len(got) == len(rows) and by_text == {
        (1, 17): ([(1, 15, 3)], "x a b c y"), (2, 0): ([], ""), (3, 0): ([], ""), (4, 0): ([], ""),
        (5, 10): ([], "a b a b a b a b a b"), (6, 12): ([(0, 12, 1)], "ä\x1cé"), (None, 12): ([(0, 12, 1)], "z"),
        (1, 3): ([], "a b c"), (7, 4000): ([], long), (8, 8000): ([(0, 8000, 4000)], long),
    }
    assert periodic_runs(frame(spark, [])).columns == ["doc_id", "n_words", "runs", "collapsed"] and periodic_runs(frame(spark, [])).isEmpty()
    with pytest.raises(ValueError, match="min_words"):
        periodic_runs(frame(spark, []), min_words=1)


def test_registered_runs_against_scanning(spark, folder):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    n_planted = 0
    for row in QUERIES["op13_periodic_runs"](spark, folder).collect():
        words = [w.decode() for w in (texts[row["doc_id"]] or "").encode().split()]
        h, n = zlib.crc32(str(row["doc_id"]).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            n_planted += 1
        runs = [(s, e - s, q) for s, e, q in periodic_runs_of(words, 12)]
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        want = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (len(runs), *want)
        assert row["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs))
        assert row["collapsed_sha256"] == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    assert n_planted


# ---- hard negatives ----

VECTORS = "vec_id bigint, label int, embedding array<float>, id int, number int, kind int, anchor int"


def _vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS)


def _mined(rows, n_positives, n_negatives):
    ok = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    quantized = [[int(np.floor(256 * float(np.float32(x)))) for x in r[2]] for r in ok]
    out = []
    for a, anchor in enumerate(ok):
        if anchor[0] % 10:
            continue
        score = [sum(x * y for x, y in zip(quantized[a], q, strict=False)) for q in quantized]
        order = sorted((k for k in range(len(ok)) if k != a), key=lambda k: (-score[k], ok[k][0]))
        for p in [k for k in order if ok[k][1] == anchor[1]][:n_positives]:
            fits = [k for k in order if ok[k][1] != anchor[1] and 30 * score[p] <= 100 * score[k] <= 90 * score[p]][:n_negatives]
            out += [(anchor[0], ok[p][0], i + 1, ok[k][0], score[p], score[k]) for i, k in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("pass_bytes, block", [(16 << 20, 1 << 21), (200, 1 << 11)])
def test_hard_negatives_against_sorting_all_pairs(spark, monkeypatch, pass_bytes, block):
    monkeypatch.setattr(hard_negatives, "PASS_BYTES", pass_bytes)
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    r = random.Random(7)
    rows = [(k, r.randrange(3), [r.choice([-0.5, 0.0, 0.01, 0.3, r.uniform(-1, 1)]) for _ in range(4)]) for k in range(120)]
    rows += [(200, 1, [0.5, 0.5, 0.5, 0.5])] * 3 + [(k, 2, [0.3, 0.3, 0.3, 0.3]) for k in range(300, 340)]
    rows += [
        (None, 1, [1.0] * 4), (401, None, [1.0] * 4), (402, 1, None), (403, 1, [1.0, None, 1.0, 1.0]), (404, 1, [1.0, float("nan"), 0.0, 0.0]),
        (405, 1, [float("inf"), 0.0, 0.0, 0.0]), (410, 1, []), (411, 2, []), (420, 1, [0.5] * 7), (421, 2, [0.4]),
    ]
    got = mine_hard_negatives(_vectors(spark, rows).repartition(5), F.col("vec_id") % 10 == 0, n_positives=3, n_negatives=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(x) for x in got.collect()) == _mined(rows, 3, 4)


def test_hard_negatives_without_rows_or_anchors(spark):
    for rows in ([], [(1, 1, [1.0])], [(None, 1, [1.0])]):
        assert mine_hard_negatives(_vectors(spark, rows), F.col("vec_id") % 10 == 0).isEmpty()
    assert mine_hard_negatives(_vectors(spark, [(10, 1, [1.0]), (11, 2, [1.0])]), F.col("vec_id") % 10 == 0).isEmpty()


# ---- toxicity ----


def test_gradients_against_differences(monkeypatch):
    monkeypatch.setattr(text_cnn, "BUCKETS", 50)
    texts = text_cnn.cut(pa.array(["a bad, word here", "", "some other words are Here", "bad", None]))
    y, weight = np.array([1, 0, 0, 1, 0.0]), np.array([1, 2, 1, 0.5, 1])
    model = text_cnn.fresh(4)
    for name in ("table", "bias", "out", "out_bias"):
        setattr(model, name, getattr(model, name).astype(np.float64) + (0.1 if name == "bias" else 0))
    model.banks = [b.astype(np.float64) for b in model.banks]
    parts = text_cnn.parts_of(texts.distinct)

    def loss():
        return text_cnn.gradients(model, texts.ids, texts.starts, parts, y, weight)[0]

    _, ((rows, values), *dense) = text_cnn.gradients(model, texts.ids, texts.starts, parts, y, weight)
    table = np.zeros_like(model.table)
    table[rows] = values
    for array, grad in zip([model.table, *model.banks, model.bias, model.out, model.out_bias], [table, *dense], strict=True):
        r = np.random.default_rng(0)
        places = np.flatnonzero(np.abs(grad).ravel() > 1e-4)
        for at in r.choice(places, min(12, len(places)), replace=False):
            kept, step = array.flat[at], 1e-3
            array.flat[at] = kept + step
            up = loss()
            array.flat[at] = kept - step
            down = loss()
            array.flat[at] = kept
            assert (up - down) / (2 * step) == pytest.approx(np.ravel(grad)[at], rel=0.05, abs=2e-4)


@pytest.mark.parametrize("stretch", [1 << 15, 3])
def test_pooling_against_every_window(monkeypatch, stretch):
    monkeypatch.setattr(text_cnn, "STRETCH", stretch)
    texts = text_cnn.cut(pa.array(["one two three four five", None, "six", " ", "one one seven"]))
    model = text_cnn.fresh(1)
    vectors = model.vectors(text_cnn.parts_of(texts.distinct))
    pooled, where = model.pool(texts.ids, texts.starts, vectors, places=True)
    for t in range(5):
        ids = texts.ids[texts.starts[t] : texts.starts[t + 1]]
        padded = np.concatenate([vectors[ids], np.zeros((2, text_cnn.DIM))])
        at = 0
        for w, bank in zip(text_cnn.WIDTHS, model.banks, strict=True):
            for f in range(text_cnn.FILTERS):
                every = [sum(padded[i + k] @ bank[k][:, f] for k in range(w)) for i in range(len(ids))]
                assert pooled[t, at] == pytest.approx(max(every) if every else 0, abs=1e-5)
                if every:
                    assert every[where[t, at] - texts.starts[t]] == pytest.approx(max(every), abs=1e-5)
                at += 1


def test_learned_words_are_found_in_whole_texts(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 8))) for _ in range(300)]
    rows, marks = [], []
    for k in range(900):
        text = [r.choice(words) for _ in range(r.choice([5, 30, 200]))]
        if k % 3 == 0:
            text.insert(r.randrange(len(text) + 1), r.choice(["Zornix", "zornling,", "quibble"]))
        rows.append((k, " ".join(text)))
        marks.append((k, 0, int(k % 3 == 0)))
    rows += [(1001, None), (1002, ""), (None, "zornix " * 3), (1003, "ab " * 60_000 + "quibble"), (1003, "ab cd")]
    marks += [(None, 1, 1), (5000, 0, 1), (1, 0, None), (1, 0, 0)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    got = score_toxicity(frame(spark, rows), labels, steps=250).collect()
    assert len(got) == len(rows)
    by_id = {}
    for x in got:
        by_id.setdefault(x["doc_id"], []).append(x)
    for k in range(900):
        assert by_id[k][0]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2)
    held = [k for k in range(900) if by_id[k][0]["held_out"]]
    assert np.mean([by_id[k][0]["predicted"] == (k % 3 == 0) for k in held]) > 0.97
    assert np.mean([by_id[k][0]["toxic"] == (k % 3 == 0) for k in held]) > 0.97
    assert by_id[None][0]["predicted"] == 1 and not by_id[None][0]["held_out"]
    assert by_id[1001][0]["score"] == by_id[1002][0]["score"] and 0 <= by_id[1002][0]["score"] < 0.3
    assert sorted(x["predicted"] for x in by_id[1003]) == [0, 1]


def test_held_out_labels_are_not_read(spark):
    rows = [(k, f"word{k % 7} {'bad' if k % 2 else 'good'}") for k in range(200)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id bigint, toxic int")
    turned = labels.withColumn("toxic", F.when(held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda of: sorted((x["doc_id"], x["score"], x["threshold"]) for x in score_toxicity(frame(spark, rows), of, steps=40).collect())
    assert score(labels) == score(turned)


def test_networks_do_not_pass_through_the_driver(spark, monkeypatch):
    def refused(stored):
        raise AssertionError("the driver holds a network")

    rows = [(k, f"word{k % 7} {'bad' if k % 2 else 'good'}") for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    monkeypatch.setattr(text_cnn, "from_bytes", refused)
    assert score_toxicity(frame(spark, rows), labels, steps=20).filter("score > 0").count() == 60


def test_toxicity_without_labels_or_documents(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = score_toxicity(frame(spark, [(1, "a"), (2, None)]), none).collect()
    assert [(x["score"], x["predicted"], x["threshold"], x["toxic"]) for x in got] == [(0.0, 0, 0.3, False)] * 2
    one = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    assert score_toxicity(frame(spark, []), one).isEmpty()
    assert len(score_toxicity(frame(spark, [(1, "a"), (2, "b")]), one, steps=5).collect()) == 2


def test_cutoffs_against_trying_all(spark):
    r = random.Random(4)
    rows = [(lang, int(r.random() < 0.3), round(r.random(), 3)) for lang in ("en", "de", None) for _ in range(60)] + [("fr", 0, 0.5)]
    got = {x["lang"]: x["threshold"] for x in cutoffs(spark.createDataFrame(rows, "lang string, y int, score double")).collect()}

    def f1(mine, c):
        hits = sum(y for y, s in mine if s >= c)
        return 2 * hits / (sum(s >= c for _, s in mine) + sum(y for y, _ in mine))

    assert set(got) == {"en", "de", None}
    for lang, c in got.items():
        mine = [(y, s) for at, y, s in rows if at == lang]
        assert c == max((k / toxicity.STEPS for k in range(100)), key=lambda t: (f1(mine, t), t))
