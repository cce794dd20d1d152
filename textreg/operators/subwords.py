"""Sub-word ids by byte-pair merges, cut to the budget of an encoder, with its marks and mask."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textreg.operators.quality import validate_positive
from textreg.plans.skew import lookup_join
from textreg.plans.stage import write_stage

# Fixed value: how byte-level vocabularies of this family cut text into words before they merge bytes.
WORD = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.cache
def read_ranks(path: str) -> dict[bytes, int]:
    """Sub-word to rank, which is its id too, from lines of base64 and rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in (line.split() for line in lines if line.strip())}


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: of all neighbours whose join has a rank, those of the least rank are joined first, from left to right.

    Candidate joins wait in a heap; one that an earlier join has changed is skipped when it comes up.
    """
    n = len(word)
    ends = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n

    def candidate(start: int) -> None:
        middle = ends[start]
        if middle < n:
            rank = ranks.get(word[start : ends[middle]])
            if rank is not None:
                heapq.heappush(waiting, (rank, start, middle, ends[middle]))

    waiting: list[tuple[int, int, int, int]] = []
    for start in range(n):
        candidate(start)
    while waiting:
        _, start, middle, end = heapq.heappop(waiting)
        if not alive[start] or ends[start] != middle or not alive[middle] or ends[middle] != end:
            continue
        ends[start], alive[middle] = end, False
        if end < n:
            before[end] = start
        candidate(start)
        if before[start] >= 0:
            candidate(before[start])
    return [ranks[word[s : ends[s]]] for s in range(n) if alive[s]]


def _merge(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for batch in batches:
            ids = [merge_bytes(w.encode("utf-8"), ranks) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def subword_table(words: DataFrame, vocabulary: str) -> DataFrame:
    """``word, ids`` of every distinct word. The vocabulary, a file of bounded size, is sent to the tasks."""
    ranks = read_ranks(vocabulary)
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"{vocabulary} has no sub-words for {len(missing)} bytes")
    shared = words.sparkSession.sparkContext.broadcast(ranks)
    return words.select("word").distinct().mapInArrow(_merge(shared), "word string, ids array<int>")


def encode_subwords(
    docs: DataFrame, vocabulary: str, text: str = "text", row: str = "row_index", max_length: int = 512, begin: int | None = None, end: int | None = None,
    pad: int | None = None,
) -> DataFrame:
    """``row, ids, mask, truncated``: at most ``max_length`` sub-word ids per text, its first ones, between the marks ``begin`` and ``end``.

    With ``pad`` all lists are filled up to ``max_length``; ``mask`` is 1 for ids and marks and 0 for padding. Words are merged once each, however often
    they occur, and joined back. A word has at least one sub-word, so no more words than the budget can matter: only these are
    joined. Null and empty texts have marks only.
    """
    marks = [m for m in (begin, end) if m is not None]
    validate_positive(max_length=max_length - len(marks))
    budget = max_length - len(marks)
    words = F.regexp_extract_all(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    cut = docs.select(row, words.alias("words")).select(row, F.slice("words", 1, budget).alias("words"), (F.size("words") > budget).alias("more"))
    cut = write_stage(cut, "words")
    placed = cut.select(row, "more", F.posexplode_outer("words").alias("pos", "word"))
    table = write_stage(subword_table(placed.filter("word IS NOT NULL"), vocabulary), "subwords")
    found = lookup_join(placed, table, "word", "left", spread_by=[row, "pos"], stored=True)
    listed = found.groupBy(row, "more").agg(F.array_sort(F.collect_list(F.when(F.col("ids").isNotNull(), F.struct("pos", "ids")))).alias("w"))
    every = F.flatten("w.ids")
    literal = lambda m: F.array(*[F.lit(x) for x in m]).cast("array<int>")
    ids = F.concat(literal([begin] if begin is not None else []), F.slice("every", 1, budget), literal([end] if end is not None else []))
    filled = listed.select(row, "more", every.alias("every")).select(row, ids.alias("ids"), (F.col("more") | (F.size("every") > budget)).alias("truncated"))
    room = F.lit(max_length) - F.size("ids") if pad is not None else F.lit(0)
    fill = lambda value: F.array_repeat(F.lit(value), room).cast("array<int>")
    return filled.select(
        row, F.concat("ids", fill(pad or 0)).alias("ids"), F.concat(F.array_repeat(F.lit(1), F.size("ids")), fill(0)).alias("mask"), "truncated"
    )


def masked_rows(encoded: DataFrame, vectors: DataFrame, row: str = "row_index") -> DataFrame:
    """``row, pos, vec, mask`` of the ids of ``encode_subwords`` with their ``vectors(id, vec)``: the input of ``masked_mean_pool``."""
    entry: Column = F.posexplode(F.arrays_zip(F.col("ids").alias("id"), F.col("mask").alias("mask"))).alias("pos", "e")
    places = encoded.select(row, entry).select(row, "pos", "e.id", "e.mask")
    return lookup_join(places, vectors.select("id", "vec"), "id", "left", spread_by=[row, "pos"])
