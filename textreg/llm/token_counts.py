"""Tokens per document by a unigram model: forward scores once per prefix that pre-tokens share in a trie."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textreg.llm.pieces import (
    BYTE_SCORE, DEFAULT_MODEL, DIGITS, UNIT_CHARS, cut_pattern, ends_of_pieces, units, vocabulary, words,
)

#: Pre-tokens whose counts a task keeps between batches.
KEPT = 400_000

_BYTE = round(BYTE_SCORE * 10**DIGITS)


def prefix_counts(pre_tokens: set[str], ends: dict[str, int | bool]) -> dict[str, int]:
    """Tokens of the best segmentation of each pre-token.

    Sorted pre-tokens are the depth-first walk of their trie: the stack holds, for each node on the path, the best score and
    the number of tokens of the best segmentation of its prefix, so a shared prefix is scored once. A terminal node
    stores its count. Of equal scores the longer last piece wins.
    """
    out: dict[str, int] = {}
    best, count = [0], [0]
    path = ""
    get = ends.get
    for word in sorted(pre_tokens):
        shared = 0
        for a, b in zip(path, word, strict=False):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            last = word[end - 1]
            top, n = None, 0
            if type(get(last)) is not int:
                size = len(last.encode("utf-8", "surrogatepass"))
                top, n = best[end - 1] + size * _BYTE, count[end - 1] + size
            start = end - 1
            while start >= 0:
                s = get(word[start:end])
                if s is None:
                    break
                if s is not True and (top is None or best[start] + s >= top):
                    top, n = best[start] + s, count[start] + 1
                start -= 1
            best.append(top)
            count.append(n)
        path = word
        out[word] = count[-1]
    return out


_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])


def _count(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, cut = shared.value
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                split = [words(t.as_py()) for t in part.column(1)]
                new = set().union(*split).difference(known)
                if len(known) + len(new) > KEPT:
                    known = {}
                    new = set().union(*split)
                parts = units(new, cut)
                counts = prefix_counts({u for us in parts.values() for u in us}, ends)
                known.update((w, sum(map(counts.__getitem__, us))) for w, us in parts.items())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), pa.array([len(u) for u in split], pa.int64()),
                        pa.array([sum(map(known.__getitem__, u)) for u in split], pa.int64()),
                    ],
                    schema=_OUT,
                )
                for w in new:
                    if len(w) > UNIT_CHARS:
                        del known[w]

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL) -> DataFrame:
    """Count the tokens of each document: ``id_col``, ``n_words``, ``n_tokens``.

    Documents are read once and not shuffled: each task keeps the distinct pre-tokens it met in a trie, forgets them
    when ``KEPT`` are held, and adds up terminal counts per document. The vocabulary is sent to the tasks; it is a file of
    bounded size. The rules of segmentation are those of the encoder, so the counts equal the lengths of its results.

    Null and empty texts have no tokens. Repeated rows, null ids and other columns need no care: one row out per row in.
    """
    scores = {p: round(s * 10**DIGITS) for _, p, s, byte in vocabulary(model) if byte < 0}
    shared = docs.sparkSession.sparkContext.broadcast((ends_of_pieces(scores), cut_pattern(scores)))
    read = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return read.mapInArrow(_count(shared), "id bigint, n_words bigint, n_tokens bigint").withColumnRenamed("id", id_col)
