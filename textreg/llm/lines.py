"""Repeated runs of lines across a corpus, by a suffix order over line ids built with distributed prefix doubling."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textreg.llm.batches import stage
from textreg.llm.quality import WORD
from textreg.plans.ordering import add_row_index

_AT = ["id", "copy", "pos"]


def _ranked(rows: DataFrame, keys: list[str], length: int) -> DataFrame:
    """Rows whose ``keys`` occur twice or more, with the key's rank in sorted order and its first place.

    Equal keys are one LCP interval of the suffix order, ``length`` lines deep. Counts are reduced before the
    shuffle; rows with a key of their own are unique suffixes and leave the doubling.
    """
    intervals = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(F.struct(*_AT)).alias("first"))
    ranks = add_row_index(intervals.filter("n > 1").select(*keys, "first"), keys, "rank")
    kept = rows.join(ranks, keys).select(*_AT, "rank", F.lit(length).alias("length"), "first")
    return stage(kept, f"lines-{length}")


def _extended(left: DataFrame, right: DataFrame, step: int, length: int) -> DataFrame:
    after = right.select("id", "copy", (F.col("pos") - step).alias("pos"), F.col("rank").alias("next"))
    return _ranked(left.select(*_AT, F.col("rank").alias("here")).join(after, _AT), ["here", "next"], length)


def repeated_lines(lines: DataFrame, min_lines: int) -> DataFrame:
    """``(id, copy, pos, a, b)`` lines to the starts of later copies: ``(id, copy, pos, length, first)``.

    ``length`` is the deepest level (a power of two, or ``min_lines``) at which an earlier copy exists, ``first`` the
    first place of that interval.
    """
    level, length = _ranked(lines, ["a", "b"], 1), 1
    while 2 * length <= min_lines:
        level, length = _extended(level, level, length, 2 * length), 2 * length
    if length < min_lines:
        # Two overlapping windows of a power of two make one of min_lines.
        level, length = _extended(level, level, min_lines - length, min_lines), min_lines
    later = []
    while True:
        later.append(level.filter(F.struct(*_AT) != F.col("first")).select(*_AT, "length", "first"))
        if level.isEmpty():
            break
        level, length = _extended(level, level, length, 2 * length), 2 * length
    found = later[0]
    for x in later[1:]:
        found = found.unionByName(x)
    return found.groupBy(*_AT).agg(F.max(F.struct("length", "first")).alias("m")).select(*_AT, "m.length", "m.first")


def _rebuild(min_lines: int):
    has_word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, text, starts in zip(*[c.to_pylist() for c in batch.columns[:3]], strict=True):
                lines = text.split("\n") if text is not None else []
                full = [i for i, x in enumerate(lines) if has_word.search(x)]
                runs: list[dict] = []
                for s in sorted(starts or [], key=lambda s: s["pos"]):
                    a, b = s["pos"], s["pos"] + min_lines
                    source = (s["id"], s["at"] - a)
                    if runs and a <= runs[-1]["stop"] and source == runs[-1]["source"]:
                        runs[-1]["stop"] = max(b, runs[-1]["stop"])
                    else:
                        runs.append({"start": a, "stop": b, "source": source})
                gone = {full[p] for r in runs for p in range(r["start"], r["stop"])}
                out.append({
                    "id": id_, "n_lines": len(full), "n_removed": len(gone),
                    "kept_text": None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone),
                    "runs": [
                        {"start": full[r["start"]], "end": full[r["stop"] - 1] + 1, "from_id": r["source"][0]} for r in runs
                    ],
                })
            made = pa.RecordBatch.from_pylist(out, schema=_OUT)
            yield pa.RecordBatch.from_arrays([*made.columns, *batch.columns[3:]], names=[*_OUT.names, *batch.schema.names[3:]])

    return run


_OUT = pa.schema([
    ("id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
    ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("from_id", pa.int64())]))),
])
_TYPES = (
    "id bigint, n_lines bigint, n_removed bigint, kept_text string, runs array<struct<start:int,end:int,from_id:bigint>>"
)


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 1, carry: Sequence[str] = (),
) -> DataFrame:
    """Delete the later copies of every maximal run of at least ``min_lines`` lines that repeats in the corpus.

    Returns one row per document: ``id_col``, ``n_lines`` (lines with a word), ``n_removed``, ``kept_text`` and ``runs``
    (line ranges ``[start, end)`` deleted, with a document that has the earlier copy).

    A document is the sequence of its lines with a word; other lines are skipped and stay. Lines are equal as
    whole strings. Order is by id, then by place, so the first copy stays. Lines get 128-bit ids; each round of prefix
    doubling keeps only suffixes that still share a rank, so the table shrinks to the repeated lines at once and
    the number of rounds is the logarithm of the longest repeated run. A line that very many documents share is
    reduced before the shuffle and split by Spark's skew join.

    Null texts stay null and have no lines; empty ones stay empty. Rows without an id are passed on unchanged. Rows
    that share id and text count as one document and get the same result. Other columns are ignored, but for those
    in ``carry``, which come back as fields of a struct ``carried``.
    """
    carried = F.struct(*carry) if carry else F.lit(None)
    docs = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), carried.alias("carried")
    )
    docs = docs.withColumn("copy", F.xxhash64("text"))
    full = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    lines = (
        docs.filter("id IS NOT NULL AND text IS NOT NULL").select("id", "copy", F.posexplode(full).alias("pos", "line"))
        .select(*_AT, F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b")).distinct()
    )
    later = repeated_lines(stage(lines, "lines"), min_lines)
    marked = later.groupBy("id", "copy").agg(
        F.collect_list(F.struct("pos", F.col("first.id").alias("id"), F.col("first.pos").alias("at"))).alias("starts")
    )
    rebuilt = docs.join(marked, ["id", "copy"], "left").select("id", "text", "starts", *(["carried"] if carry else []))
    types = _TYPES + (f", carried {docs.schema['carried'].dataType.simpleString()}" if carry else "")
    cleaned = rebuilt.mapInArrow(_rebuild(min_lines), types)
    return cleaned.withColumnRenamed("id", id_col)
