"""Periodic runs in word sequences, found by internal pattern matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textreg.llm.wavelet import WaveletMatrix, factor_ranks

#: Bytes of text whose suffixes are ordered together; a longer text is a batch of its own. Candidates extended together.
BATCH_BYTES = 1 << 20
CANDIDATES = 1 << 19

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])
_OUT_TYPES = "id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def _common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the words at i and j (behind i) agree to the right, and before them to the left."""
    right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        rank = levels[k]
        right += (rank[i + right] == rank[j + right]).astype(np.int64) << k
        a = i - left - (1 << k)
        same = rank[np.maximum(a, 0)] == rank[np.maximum(a + j - i, 0)]
        left += ((a >= 0) & same).astype(np.int64) << k
    return right, left


def _occurrences(
    tree: WaveletMatrix, rank_of: np.ndarray, position_of: np.ndarray, block: np.ndarray, lo: np.ndarray, size: np.ndarray,
    start: int, end: int, part: int,
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (block, occurrence ``start`` to ``end`` words behind it).

    A window is searched in parts of ``part`` starts, the length of the block: its occurrences in a part are an arithmetic progression, so
    the first, the second and the number of them name all.
    """
    n = len(rank_of) - 1
    hi = lo + size
    before = tree.below(lo, hi, rank_of[np.minimum(block + start, n)])
    for at in range(start, end, part):
        upto = tree.below(lo, hi, rank_of[np.minimum(block + min(at + part, end), n)])
        count = upto - before
        some = np.flatnonzero(count)
        if len(some):
            first = position_of[tree.smallest(lo[some], hi[some], before[some])]
            step = np.ones(len(some), np.int64)
            more = np.flatnonzero(count[some] > 1)
            if len(more):
                these = some[more]
                step[more] = position_of[tree.smallest(lo[these], hi[these], before[these] + 1)] - first[more]
            times = count[some]
            bounds = np.cumsum(times)
            for a in range(0, int(bounds[-1]), CANDIDATES):
                k = np.arange(a, min(a + CANDIDATES, int(bounds[-1])))
                of = np.searchsorted(bounds, k, side="right")
                yield block[some[of]], first[of] + (k - bounds[of] + times[of]) * step[of]
        before = upto


def find_runs(words: np.ndarray, starts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of every run, by start and period, in sequences of numbers laid end to end.

    ``starts`` holds the sequences' first positions and the end of the last; the same word has another number in another sequence. A run
    of period q and at least max(min_words, 2q) words contains a dyadic block whose next copy, q words on, lies in the run too:
    blocks of b words, at every multiple of b, serve the periods from 2b - 1 to 4b - 2, and the smallest blocks, half as far apart, all
    shorter ones. The occurrences of a block behind it, within these distances, are range successors in the suffix
    order; each is a candidate period, extended to both sides by comparing ranks. Of runs of equal extent the smallest period counts.
    """
    none = np.zeros(0, np.int64)
    n = len(words)
    if not n:
        return none, none, none
    ends = np.repeat(starts[1:], np.diff(starts))
    order, levels = factor_ranks(words, ends)
    least = 0
    while (2 << least) + (1 << least) - 1 <= (min_words + 1) // 2:
        least += 1
    if least >= len(levels):
        return none, none, none
    shared = np.bincount(levels[least][:n], minlength=n)[levels[least][order]] > 1
    if not shared.any():
        return none, none, none
    slot_of = np.concatenate([[0], np.cumsum(shared)])
    position_of = np.sort(order[shared]).astype(np.int64)
    there = np.zeros(n + 1, np.int64)
    there[position_of + 1] = 1
    rank_of = np.cumsum(there)
    tree = WaveletMatrix(rank_of[order[shared]])
    found = []
    for level in range(least, len(levels)):
        b = 1 << level
        stride, start = (max(1, b // 2), 1) if level == least else (b, 2 * b - 1)
        rank = levels[level]
        block = np.arange(0, n, stride)
        size = np.bincount(rank[:n], minlength=n)[rank[block]]
        block, size = block[size > 1], size[size > 1]
        if not len(block):
            continue
        for i, j in _occurrences(tree, rank_of, position_of, block, slot_of[rank[block]], size, start, 4 * b - 1, b):
            right, left = _common(levels, i, j)
            s, e, q = i - left, j + right, j - i
            long = e - s >= np.maximum(min_words, 2 * q)
            if long.any():
                found.append(_smallest(s[long], e[long], q[long]))
    if not found:
        return none, none, none
    s, e, q = _smallest(*map(np.concatenate, zip(*found, strict=True)))
    by = np.lexsort((q, s))
    return s[by], e[by], q[by]


def _smallest(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((q, e, s))
    s, e, q = s[by], e[by], q[by]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
    return s[first], e[first], q[first]


def _rows(ids: pa.Array, texts: pa.Array, min_words: int) -> pa.RecordBatch:
    split = pc.ascii_split_whitespace(texts)
    flat, offsets = split.flatten(), split.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0)
    starts = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[offsets - offsets[0]].astype(np.int64)
    flat = flat.filter(full)
    coded = flat.dictionary_encode()
    n_docs = len(ids)
    doc = np.repeat(np.arange(n_docs), np.diff(starts))
    s, e, q = find_runs(doc * np.int64(len(coded.dictionary) + 1) + coded.indices.to_numpy(), starts, min_words)
    of = np.searchsorted(starts, s, side="right") - 1
    runs = pa.StructArray.from_arrays([pa.array(s - starts[of]), pa.array(e - s), pa.array(q)], fields=list(_RUN))
    bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n_docs))]), pa.int32())
    change = np.zeros(len(flat) + 1, np.int64)
    np.add.at(change, s + q, 1)
    np.add.at(change, e, -1)
    kept = np.cumsum(change)[:-1] == 0
    kept_bounds = np.concatenate([[0], np.cumsum(kept)])[starts]
    lists = pa.ListArray.from_arrays(pa.array(kept_bounds, pa.int32()), flat.filter(pa.array(kept)))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.diff(starts)), pa.ListArray.from_arrays(bounds, runs), pc.binary_join(lists, " ")], schema=_OUT
    )


def _search(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            bytes_before = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                done = bytes_before[at - 1] if at else 0
                upto = max(at + 1, int(np.searchsorted(bytes_before, done + BATCH_BYTES, side="right")))
                yield _rows(batch.column(0).slice(at, upto - at), texts.slice(at, upto - at), min_words)
                at = upto

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 12) -> DataFrame:
    """Find the periodic runs of each text: ``id_col``, ``n_words``, ``runs``, ``collapsed``, one row per document.

    Words are runs of characters other than ASCII white space. A run is a stretch of words with smallest period q, at least
    ``min_words`` and 2q words long, that no word beside it extends; ``runs`` lists (start, length, period) by start, then period.
    ``collapsed`` is the text without the words that a run has after its first q, joined by blanks.

    Documents are read once and do not move: each task orders the suffixes of some documents together and holds those of about a
    megabyte of text, or of one longer document. Work is n log n in the words of a document, also where all are equal.

    Null and empty texts have no words, no runs and an empty ``collapsed``. One row out per row in, whatever the ids; an empty table gives none.
    Other columns are ignored, whatever their names.
    """
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    read = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(_search(min_words), _OUT_TYPES).withColumnRenamed("id", id_col)
