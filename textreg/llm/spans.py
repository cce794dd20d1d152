"""Repeated passages across a corpus: sliding runs of sentences, hashed and joined globally."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A span is the shortest run of sentences with this many sentences and words.
SENTENCES = 3
WORDS = 15
#: A longer sentence is cut at commas and the like, and after words picked by their hash.
LONG_SENTENCE = 12

_SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|$)\s*")
_CLAUSE = re.compile(r"[^,;:]*(?:[,;:]+|$)\s*")
_WORD = re.compile(r"\S+\s*")
_CUT_EVERY = 4
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_BACK = np.array([pow(int(x), -1, 1 << 64) for x in _STEP], np.uint64)


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """``(start, end, words)`` of the sentences, end to end over the text. Runs without a word join the one before."""
    out: list[tuple[int, int, list[str]]] = []

    def add(a: int, b: int, words: list[str]) -> None:
        if words or not out:
            out.append((a, b, words))
        else:
            out[-1] = (out[-1][0], b, out[-1][2])

    for m in _SENTENCE.finditer(text):
        a, b = m.span()
        if a == b:
            continue
        words = m.group().lower().split()
        if len(words) <= LONG_SENTENCE:
            add(a, b, words)
            continue
        for c in _CLAUSE.finditer(text, a, b):
            if c.start() == c.end():
                continue
            part = c.group().lower().split()
            if len(part) <= LONG_SENTENCE:
                add(*c.span(), part)
                continue
            at, held = c.start(), []
            for w in _WORD.finditer(text, c.start(), c.end()):
                word = w.group().rstrip().lower()
                held.append(word)
                if xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) % _CUT_EVERY == 0:
                    add(at, w.end(), held)
                    at, held = w.end(), []
            if at < c.end():
                add(at, c.end(), held)
    return out


def spans(units: list[tuple[int, int, list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths in sentences and 128-bit hashes of the spans: the shortest run from each sentence on."""
    n = len(units)
    if n < SENTENCES:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((2, 0), np.uint64)
    counts = np.concatenate([[0], np.cumsum([len(w) for *_, w in units])])
    start = np.arange(n)
    stop = np.maximum(start + SENTENCES, np.searchsorted(counts, counts[:-1] + WORDS))
    start, stop = start[stop <= n], stop[stop <= n]
    digests = [xxhash.xxh3_128_intdigest(" ".join(w).encode("utf-8", "surrogatepass")) for *_, w in units]
    low, high = [d & 0xFFFFFFFFFFFFFFFF for d in digests], [d >> 64 for d in digests]
    out = []
    for half, step, back in zip((low, high), _STEP, _BACK, strict=True):
        up = np.cumprod(np.full(n, step, np.uint64))
        down = np.cumprod(np.full(n, back, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.array(half, np.uint64) * up)])
        out.append((sums[stop] - sums[start]) * down[start])
    return start, stop - start, np.stack(out)


#: Documents whose equal spans a task folds at a time.
FOLDED = 4000
#: A place is the number of the first sentence times this, plus the sentences of the span (at most ``WORDS`` + 1); that of a
#: document's own row is below 0. Random columns come first and small numbers last, which is how rows compress best on their way.
_WIDE = 256
_WHERE = pa.struct([("copy", pa.int64()), ("id", pa.int64()), ("place", pa.int64())])
_SPAN_TYPES = "copy bigint, a bigint, b bigint, id bigint, place bigint, more array<struct<copy:bigint,id:bigint,place:bigint>>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per hash and ``FOLDED`` documents: the first place by id, copy and position, and the later ones as a list."""
    for batch in batches:
        for at in range(0, batch.num_rows, FOLDED):
            part = sorted(zip(*[c.to_pylist() for c in batch.slice(at, FOLDED).columns], strict=True), key=lambda row: row[:2])
            rows, copies, places, keys = [], [], [], []
            for id_, copy, text in part:
                units = sentences(text)
                start, size, key = spans(units)
                rows.append(np.full(len(start) + 1, id_, np.int64))
                copies.append(np.full(len(start) + 1, copy, np.int64))
                # A last row, under a key of the document's own, tells the number of sentences.
                places.append(np.append(start * _WIDE + size, -1 - sum(bool(w) for *_, w in units)))
                keys.append(np.concatenate([key.view(np.int64), [[copy], [id_]]], axis=1))
            key = np.concatenate(keys, axis=1)
            order = np.lexsort((key[1], key[0]))
            key = key[:, order]
            same = np.concatenate([[False], (key[:, 1:] == key[:, :-1]).all(axis=0)])
            head, tail = order[~same], order[same]
            where = [np.concatenate(x) for x in (copies, rows, places)]
            later = pa.StructArray.from_arrays([pa.array(x[tail]) for x in where], fields=list(_WHERE))
            n_later = np.diff(np.append(np.flatnonzero(~same), len(order))) - 1
            ends = np.concatenate([[0], np.cumsum(n_later)])
            more = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), later, mask=pa.array(n_later == 0))
            # Rows leave in the order of the documents: neighbours share id and copy, which compress away.
            told = np.argsort(head)
            a, b = key[:, ~same][:, told]
            copy, id_, place = (x[head[told]] for x in where)
            yield pa.RecordBatch.from_arrays(
                [*map(pa.array, (copy, a, b, id_, place)), more.take(pa.array(told))], names=["copy", "a", "b", "id", "place", "more"]
            )


_OUT = pa.schema([
    ("id", pa.int64()), ("n_sentences", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()),
    ("first_ids", pa.list_(pa.int64())),
])


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            out = []
            for id_, text, found in zip(*[c.to_pylist() for c in batch.slice(at, 1000).columns], strict=True):
                later = [s for s in found or [] if s["pos"] >= 0]
                counted = next((s["size"] for s in found or [] if s["pos"] < 0), None)
                units = sentences(text) if text and (later or counted is None) else []
                gone = {p for s in later for p in range(s["pos"], s["pos"] + s["size"])}
                out.append({
                    "id": id_, "n_sentences": sum(bool(w) for *_, w in units) if counted is None else counted, "n_removed": len(gone),
                    "kept_text": text if not gone else "".join(text[a:b] for i, (a, b, _) in enumerate(units) if i not in gone),
                    "first_ids": sorted({s["first"] for s in later}),
                })
            yield pa.RecordBatch.from_pylist(out, schema=_OUT)


def dedup_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove sentences covered by any span of consecutive sentences that occurs earlier in the corpus.

    Returns one row per document: ``id_col``, ``n_sentences``, ``n_removed``, ``kept_text`` and ``first_ids`` (documents
    that keep the first copies).

    A sentence ends at ``.``, ``!``, ``?`` or a line break. One of more than ``LONG_SENTENCE`` words is cut at commas,
    colons and semicolons, and parts still longer after words chosen by their own hash, so a passage falls into
    the same parts wherever it stands. A span is the shortest run from each sentence on with ``SENTENCES`` sentences
    and ``WORDS`` words, compared by a 128-bit hash of its words in lower case. Order is by id, then by place: the first
    occurrence stays, within a document as well.

    Spans move once, by their hash, and meet their first copy there. A task folds the equal spans of ``FOLDED`` documents
    to one row before, so a passage in very many documents is few rows. Null texts stay null, empty ones
    empty. Rows without an id are passed on unchanged. Rows that share id and text count as one document. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("copy", F.xxhash64("text"))
    read = docs.filter("id IS NOT NULL AND text IS NOT NULL").select("id", "copy", "text")
    every = read.mapInArrow(_spans, _SPAN_TYPES)
    equal = Window.partitionBy("a", "b")
    met = every.withColumns({"n": F.count("*").over(equal), "first": F.min(F.struct("id", "copy", "place")).over(equal)})
    counts = F.col("place") < 0
    own = F.array(F.struct("copy", "id", "place"))
    places = F.when(F.col("more").isNull(), own).otherwise(F.concat(own, "more"))
    later = F.filter(places, lambda s: F.struct(s["id"], s["copy"], s["place"]) != F.col("first"))
    spots = met.filter(counts | (F.col("n") > 1) | F.col("more").isNotNull()).select(
        F.explode(F.when(counts, own).otherwise(later)).alias("s"), F.when(~counts, F.col("first.id")).alias("first")
    )
    found = F.struct(
        F.when(F.col("first").isNull(), -1).otherwise(F.floor(F.col("s.place") / _WIDE)).cast("int").alias("pos"),
        F.when(F.col("first").isNull(), -1 - F.col("s.place")).otherwise(F.col("s.place") % _WIDE).cast("int").alias("size"), "first",
    )
    marked = spots.select("s.id", "s.copy", found.alias("found")).groupBy("id", "copy").agg(F.collect_set("found").alias("found"))
    cleaned = docs.join(marked, ["id", "copy"], "left").select("id", "text", "found").mapInArrow(
        _rebuild, "id bigint, n_sentences bigint, n_removed bigint, kept_text string, first_ids array<bigint>"
    )
    return cleaned.withColumnRenamed("id", id_col)
