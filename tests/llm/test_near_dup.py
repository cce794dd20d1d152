import random

import pytest
from brute import components_of, shingles

from textreg.llm import near_dup
from textreg.llm.components import components

SCHEMA = "doc_id bigint, text string, n int, key string, root int"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)
    return {(r["doc_id"]): (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(df, **more).collect()}


def expected(rows, width, percent):
    root = components_of(rows, width, percent)
    return {i: (len(shingles(t, width)), root[i], root[i] == i) for i, t in rows}


def crowd(n, words, seed, swaps):
    r = random.Random(seed)
    base = [f"w{r.randrange(900)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(r.randrange(swaps)):
            copy[r.randrange(words)] = f"z{r.randrange(10**6)}"
        yield " ".join(copy)


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [
        (1, "One two\tthree four"), (2, "one TWO three  four"), (3, None), (4, ""), (5, " \n "), (6, "one"), (7, "ONE"),
        (8, "É b c"), (9, "é b c"), (10, long), (11, long + " tail"), (-5, "one two three four"),
    ]
    assert run(spark, rows, width=3, percent=85) == expected(rows, 3, 85)


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, None)], "doc_id bigint, text string")
    rows = sorted(map(tuple, near_dup.near_duplicates(df, width=3).collect()), key=str)
    assert rows == sorted([(None, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (None, 0, None, True)], key=str)
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("leaf, depth", [(512, 8), (6, 3)])
def test_crowds_of_near_copies(spark, monkeypatch, leaf, depth):
    """Small leaves force chunks, pivots, deeper branching and the exact comparison at the last level."""
    monkeypatch.setattr(near_dup, "LEAF", leaf)
    monkeypatch.setattr(near_dup, "MAX_DEPTH", depth)
    texts = [*crowd(120, 60, 1, 9), *crowd(40, 200, 2, 24), *(t for k in range(20) for t in crowd(2, 80, 10 + k, 8))]
    rows = list(enumerate(texts))
    assert run(spark, rows, width=3, percent=85) == expected(rows, 3, 85)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    assert got == {i: 0 for i in range(1, 61)} | {100 + k: 100 for k in range(1, 40)}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_more_trees_for_more_recall():
    assert near_dup.trees_for(0.9, 0.8) < near_dup.trees_for(0.99999, 0.8)


def test_recall_holds_at_every_depth():
    for similarity in (0.8, 0.85, 0.95):
        trees = near_dup.trees_for(0.99999, similarity)
        deep = near_dup.deep_trees_for(0.99999, similarity, trees)
        meets = near_dup._meets(similarity, near_dup.MAX_DEPTH)
        assert (1 - meets) ** deep <= 1e-5 and deep >= near_dup.trees_for(0.99999, similarity, near_dup.MAX_DEPTH)
    assert near_dup.deep_trees_for(0.99999, 1.0, 4) == 4


def test_planted_pairs_in_a_crowd_that_branches(spark, monkeypatch):
    """2,600 distinct documents of similarity 0.5; their nodes branch to the last level, where pairs have lost common nodes."""
    monkeypatch.setattr(near_dup, "LEAF", 32)
    monkeypatch.setattr(near_dup, "COPIES", 0)
    r = random.Random(4)
    core = [f"c{k}" for k in range(100)]
    rows, pairs = [], 200
    for i in range(2600 - pairs):
        own = [f"d{i}_{k}" for k in range(50)]
        rows.append((i, " ".join(core + own)))
        if i < pairs:
            # 138 of 162 shingles shared: just over the threshold.
            rows.append((10_000 + i, " ".join(core + own[:38] + [f"e{i}_{k}" for k in range(12)])))
    r.shuffle(rows)
    got = run(spark, rows, width=1, percent=85, recall=0.9, first_trees=1)
    assert sum(got[10_000 + i][1] == i for i in range(pairs)) >= 0.9 * pairs
    assert all(got[i][1] == i for i, _ in rows if i < 10_000)
