"""Word-vector files in both layouts and any number of ranges."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textreg.sources.vectors import read_vectors, write_vectors

RNG = np.random.default_rng(1)
TERMS = [f"t{k}é" * (1 + k % 3) for k in range(400)]
VECTORS = RNG.normal(size=(400, 9)).astype(np.float32)


def stored(tmp_path, layout, line_end=b""):
    path = tmp_path / f"vectors.{layout}"
    with open(path, "wb") as f:
        if layout == "binary":
            f.write(b"400 9\n" + b"".join(t.encode() + b" " + v.tobytes() + line_end for t, v in zip(TERMS, VECTORS, strict=True)))
        else:
            f.write("".join(f"{t} {' '.join(map(repr, map(float, v)))}\n" for t, v in zip(TERMS, VECTORS, strict=True)).encode())
    return str(path)


def check(rows):
    got = {r["term"]: r["vec"] for r in rows}
    assert len(rows) == len(TERMS) == len(got) and all(np.allclose(got[t], v) for t, v in zip(TERMS, VECTORS, strict=True))


@pytest.mark.parametrize("range_bytes", [1 << 20, 5000, 300])
@pytest.mark.parametrize(("layout", "line_end"), [("binary", b""), ("binary", b"\n"), ("text", b"")])
def test_any_number_of_ranges(spark, tmp_path, layout, line_end, range_bytes):
    path = stored(tmp_path, layout, line_end)
    check(read_vectors(spark, path, layout, range_bytes).collect())


def test_terms_are_filtered_while_reading(spark, tmp_path):
    for layout in ("binary", "text"):
        found = read_vectors(spark, stored(tmp_path, layout), layout, 700)
        some = found.filter(F.col("term").isin([*TERMS[:100], "no such term"]))
        assert sorted(r["term"] for r in some.collect()) == sorted(TERMS[:100])
        assert found.filter(F.col("term") == TERMS[5]).count() == 1
        plan = some._jdf.queryExecution().executedPlan().toString()
        assert " IN (" not in plan


def test_folders_counts_and_broken_files(spark, tmp_path):
    rows = spark.createDataFrame([(t, [float(x) for x in v]) for t, v in zip(TERMS, VECTORS, strict=True)], "term string, vec array<float>")
    write_vectors(rows.repartition(3), str(tmp_path / "folder"))
    check(read_vectors(spark, str(tmp_path / "folder"), range_bytes=2000).collect())
    (tmp_path / "counted").write_text("2 3\na 1 2 3\n\nb 4 5 6")
    assert sorted((r["term"], r["vec"]) for r in read_vectors(spark, str(tmp_path / "counted"), range_bytes=4).collect()) == [("a", [1, 2, 3]), ("b", [4, 5, 6])]
    (tmp_path / "broken").write_bytes(b"2 3\na " + b"\x01" * 5)
    with pytest.raises(Exception, match="no record at byte"):
        read_vectors(spark, str(tmp_path / "broken"), "binary").collect()
    with pytest.raises(Exception, match="two counts"):
        read_vectors(spark, str(tmp_path / "folder"), "binary").collect()


def test_word_vectors_are_added_where_the_tokens_lie(spark):
    """No term of a document becomes a row. Rows of one name are pooled as one, a term given twice counts twice, lists and vectors may be null."""
    from textreg.operators.dense import word_vector_mean

    vectors = [("a", [1.0, 2.0]), ("b", [3.0, None]), ("b", [5.0, 1.0]), ("c", None), (None, [9.0, 9.0])]
    docs = [(1, ["a", "b", "x"]), (1, ["a"]), (2, ["x", None, "c"]), (3, []), (None, ["a", "a"]), (4, None)]
    table = spark.createDataFrame(vectors, "term string, vec array<float>")
    out = word_vector_mean(spark.createDataFrame(docs, "row_index bigint, tokens array<string>"), table)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    want = {1: [(1 + 3 + 5 + 1) / 4, (2 + 0 + 1 + 2) / 4], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [0.0, 0.0], None: [1.0, 2.0]}
    assert {r["row_index"]: r["embedding"] for r in out.collect()} == want and out.count() == 5


def test_hashing_encoder_counts_every_token():
    import hashlib

    from textreg.operators.dense import hashing_encoder

    texts = ["One two, two; THREE.", "", "  ", "word " * 50 + "x_1 é!"]
    for size, most in ((8, None), (5, 3)):
        got = hashing_encoder(size, most)()(texts)
        for text, row in zip(texts, got, strict=True):
            want = [0.0] * size
            for token in re.findall(r"\w+|[^\w\s]", text.lower())[:most]:
                digest = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "big")
                want[digest % size] += 1 if digest >> 63 else -1
            length = sum(x * x for x in want) ** 0.5 or 1
            assert all(abs(x - y / length) < 1e-6 for x, y in zip(row, want, strict=True))
