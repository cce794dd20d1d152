"""The stages against plain versions, each on its own input."""

import corpus_pipeline
from brute import components_of, without_repeated_lines

from textreg.llm.batches import stage
from textreg.llm.queries import QUERIES


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = [docs]
    for name, step in corpus_pipeline.STAGES:
        seen.append(stage(step(spark, seen[-1], folder), name))
    rows = [[(r["doc_id"], r["text"]) for r in df.collect()] for df in seen]
    judged = QUERIES["op4_quality_rules"](spark, folder)
    assert sorted(i for i, _ in rows[1]) == sorted(r["doc_id"] for r in judged.filter("kept").collect())
    lines = without_repeated_lines(rows[1], 1)
    assert sorted(rows[2]) == sorted((i, t) for i, (_, gone, t) in lines.items() if not gone or t.split())
    root = components_of(rows[2], 5, 80)
    assert sorted(i for i, _ in rows[3]) == sorted(i for i, r in root.items() if i == r)
    assert {i for i, _ in rows[4]} <= {i for i, _ in rows[3]} and sorted(rows[5]) == sorted(rows[4])
    assert all(df.columns == corpus_pipeline.COLUMNS for df in seen[1:5])


def test_nulls_and_clashing_columns(spark, folder):
    words = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame(
        [(1, words, None, None, None), (1, words, None, None, None), (None, words + " x", "en", "s", 1), (2, None, "en", "s", 1),
         (3, "", "en", "s", 0)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    )
    now = docs
    for name, step in corpus_pipeline.STAGES:
        now = stage(step(spark, now, folder), name)
    assert {r["doc_id"] for r in now.collect()} == {1, None}
    empty = docs.limit(0)
    for name, step in corpus_pipeline.STAGES:
        empty = stage(step(spark, empty, folder), name)
    assert empty.count() == 0


def test_clean_rows_stay_beside_contaminated_ones_and_near_copies(spark, folder):
    """One contaminated row without an id, or under a repeated one, takes no other row along; nor does a near copy."""
    item = spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").first()["text"]
    prose = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcde"}
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(None, item), (None, prose["a"]), (None, prose["b"]), (7, item), (7, prose["c"]), (8, prose["d"]), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontamination_stage(spark, docs, folder).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[1] != item], key=str)

    rows = [
        (1, prose["a"]), (2, prose["a"] + " x"), (2, prose["b"]), (3, prose["c"]), (3, prose["c"] + " x"), (4, prose["d"]),
        (4, prose["d"]), (None, prose["a"]), (5, prose["e"]), (6, prose["e"] + " x"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], schema)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, folder).collect()]
    assert len([i for i, _ in kept if i == 3]) == 1
    assert sorted((r for r in kept if r[0] != 3), key=str) == sorted(
        [r for r in rows if r[0] not in (3, 6) and r != (2, prose["a"] + " x")], key=str
    )
