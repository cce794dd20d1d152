"""Benchmark passages in training documents, found with an FM-index per shard of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textreg.llm.batches import stage
from textreg.llm.fm_index import FMIndex

WINDOW = 13
#: Words of one shard's index, and bytes of benchmark text that one pass searches for.
SHARD_WORDS = 1_000_000
PASS_BYTES = 16 << 20

# Letters, digits and every byte of a character beyond ASCII; A-Z become a-z, anything else a blank.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Phrases:
    """The windows of a block of benchmark items: a vocabulary, distinct windows, and the items of each."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if ids else 0):
                windows.setdefault(tuple(ids[k : k + size]), set()).add(item)
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), window), np.int64)
        for k, w in enumerate(windows):
            self.words[k, : len(w)] = w
        self.items = [sorted(x) for x in windows.values()]
        self.shortest = int(self.lengths.min(initial=window))


def _shard(texts: list[list[bytes]], phrases: Phrases) -> tuple[list[set[int]], list[list[list[int]]]]:
    """Items and merged word spans ``[start, end)`` of each text of a shard.

    A window has benchmark words only, so runs of such words that are shorter than the shortest window are left
    out of the index.
    """
    kept, doc_of, word_of = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    get = phrases.vocabulary.get
    for d, words in enumerate(texts):
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a >= phrases.shortest:
                kept += [ids[a:b], np.zeros(1, np.int64)]
                doc_of.append(np.full(b - a + 1, d))
                word_of.append(np.arange(a, b + 1))
    items: list[set[int]] = [set() for _ in texts]
    spans: list[list[list[int]]] = [[] for _ in texts]
    if len(kept) == 1:
        return items, spans
    index = FMIndex(np.concatenate(kept))
    docs, places = np.concatenate(doc_of), np.concatenate(word_of)
    lo, hi = index.search(phrases.words, phrases.lengths)
    found = np.flatnonzero(hi > lo)
    counts = (hi - lo)[found]
    phrase = np.repeat(found, counts)
    rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo[found], counts)
    at = index.locate(rows)
    for d, p in set(zip(docs[at].tolist(), phrase.tolist(), strict=True)):
        items[d].update(phrases.items[p])
    order = np.lexsort((places[at], docs[at]))
    starts = places[at][order].tolist()
    ends = (places[at] + phrases.lengths[phrase])[order].tolist()
    for d, a, b in zip(docs[at][order].tolist(), starts, ends, strict=True):
        if spans[d] and a <= spans[d][-1][1]:
            spans[d][-1][1] = max(spans[d][-1][1], b)
        else:
            spans[d].append([a, b])
    return items, spans


def _cut(words: list[bytes], window: int) -> Iterator[tuple[int, list[bytes]]]:
    """Parts of at most a shard, which share ``window - 1`` words with their neighbours."""
    step = SHARD_WORDS - window + 1
    for at in range(0, max(1, len(words) - window + 1), step):
        yield at, words[at : at + SHARD_WORDS]


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_STATE = pa.schema([
    ("id", pa.int64()), ("text_hash", pa.int64()), ("text", pa.string()), ("items", pa.list_(pa.int64())), ("spans", _SPANS),
])
_OUT = pa.schema([
    ("id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
    ("items", pa.list_(pa.int64())), ("spans", _SPANS),
])
_STATE_TYPES = "id bigint, text_hash bigint, text string, items array<bigint>, spans array<struct<start:int,end:int>>"
_TYPES = "id bigint, text_hash bigint, n_words bigint, n_hit bigint, items array<bigint>, spans array<struct<start:int,end:int>>"


def _search(shared, window: int, last: bool):
    """One pass for one block of phrases. Rows carry what earlier passes found; the last pass turns words into characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        for batch in batches:
            rows, parts, held = [], [], 0
            for k in range(batch.num_rows):
                row = {name: batch.column(c)[k].as_py() for c, name in enumerate(_STATE.names)}
                words = words_of(row["text"])
                row["n_words"] = len(words)
                rows.append(row)
                for at, part in _cut(words, window):
                    parts.append((len(rows) - 1, at, part))
                    held += len(part)
                    if held >= SHARD_WORDS:
                        _add_found(rows, parts, phrases)
                        parts, held = [], 0
                if len(rows) >= 2000:
                    _add_found(rows, parts, phrases)
                    yield _rows_out(rows, last)
                    rows, parts, held = [], [], 0
            if rows:
                _add_found(rows, parts, phrases)
                yield _rows_out(rows, last)

    return run


def _add_found(rows: list[dict], parts: list[tuple[int, int, list[bytes]]], phrases: Phrases) -> None:
    for (row, at, _), got, where in zip(parts, *_shard([p for _, _, p in parts], phrases), strict=True):
        if got:
            rows[row]["items"] = sorted(got.union(rows[row]["items"]))
            more = [[a + at, b + at] for a, b in where]
            rows[row]["spans"] = [
                {"start": a, "end": b} for a, b in _merge([[x["start"], x["end"]] for x in rows[row]["spans"]] + more)
            ]


def _rows_out(rows: list[dict], last: bool) -> pa.RecordBatch:
    if not last:
        return pa.RecordBatch.from_pylist(rows, schema=_STATE)
    for row in rows:
        spans = row["spans"]
        row["n_hit"] = sum(x["end"] - x["start"] for x in spans)
        places = [m.span() for m in _WORD.finditer(row["text"])] if spans else []
        row["spans"] = [{"start": places[x["start"]][0], "end": places[x["end"] - 1][1]} for x in spans]
    return pa.RecordBatch.from_pylist(rows, schema=_OUT)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    percent: int = 5,
) -> DataFrame:
    """Occurrences of benchmark windows in documents.

    Returns one row per document: ``id_col``, ``text_hash`` (xxhash64 of the text, an empty one for null, which tells rows
    of one id apart), ``n_words``, ``n_hit`` (words inside any occurrence), ``items`` (sorted
    ids of the items with occurring windows), ``spans`` (merged removal spans as character offsets ``[start, end)``)
    and ``contaminated`` (``n_hit > 0`` and at least ``percent`` of the words are hit).

    A window is ``window`` consecutive words of an item, or the whole item if it is shorter. Documents are
    read once and never shuffled; a shard is about a million words of one task, a longer text is cut
    into overlapping parts. Items are searched in blocks of at most ``PASS_BYTES`` of text, one pass over
    the documents each, and only a block's phrases are sent to the tasks.

    Null and empty texts have no words and are never hit, nor do such items have windows; items without an id are
    left out. Repeated rows give repeated rows, a null id stays null. Other columns are ignored. Without documents
    the result is empty, without items nothing is hit.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(
        F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).cast("string").alias("text")
    ).filter("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // (PASS_BYTES // 2)) or 1
    found = docs.select(
        "id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text", F.array().cast("array<bigint>").alias("items"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
    )
    for k in range(blocks):
        block = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        shared = spark.sparkContext.broadcast(Phrases([(r["item"], r["text"]) for r in block.toLocalIterator()], window))
        last = k == blocks - 1
        found = found.mapInArrow(_search(shared, window, last), _TYPES if last else _STATE_TYPES)
        if not last:
            found = stage(found, "searched")
    return found.select(
        F.col("id").alias(id_col), "text_hash", "n_words", "n_hit", "items", "spans",
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))).alias("contaminated"),
    )
