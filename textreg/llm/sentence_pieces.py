"""SentencePiece encoding as a lattice over the distinct units of a task's documents, and decoding."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textreg.llm.pieces import (
    BLANK, BYTE_SCORE, DEFAULT_MODEL, DIGITS, UNIT_CHARS, best_pieces, cut_pattern, ends_of_pieces, vocabulary, words,
)

#: Bytes of text of the documents that a task segments together, and words whose ids it keeps for the next ones.
PART_BYTES = 1 << 20
KNOWN_WORDS = 300_000
#: Ids of the documents that a task spells together.
DECODED_IDS = 1 << 18
#: Blocks of documents per split of the input files, and bytes of text of a block of rows that come from no file.
BLOCKS = 1
BLOCK_BYTES = 24 << 20
#: Multiplier of the hash of the edges of a trie, and its slots per edge at least.
_FACTOR, _ROOM = np.uint64(0x9E3779B97F4A7C15), 6


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``length[k]`` numbers from ``start[k]`` on, for each k."""
    upto = np.cumsum(length)
    return np.repeat(start - (upto - length), length) + np.arange(int(upto[-1]) if len(upto) else 0)


@dataclass(frozen=True)
class PieceTrie:
    """The piece table by its beginnings: node 0 is the empty one, ``piece`` and ``micro`` the id (or -1) and score in millionths of what a node spells.

    An edge is the number ``node * codes + character``, its child lies in an open table under the edge's hash. ``code`` numbers the characters of
    the pieces by code point; others are 0 and on no edge.
    """

    code: np.ndarray
    codes: int
    edges: np.ndarray
    child: np.ndarray
    piece: np.ndarray
    micro: np.ndarray
    longest: int

    @staticmethod
    def of(pieces: dict[str, tuple[int, int]]) -> PieceTrie:
        """From ``piece`` to ``id, micro``."""
        letters = sorted({c for p in pieces for c in p})
        code = np.zeros(0x110000, np.int32)
        code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        codes, nodes, edge = len(letters) + 1, {"": 0}, {}
        for p in pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    edge[nodes[p[: k - 1]] * codes + int(code[ord(p[k - 1])])] = nodes[p[:k]]
        size = 1 << (max(len(edge), 1) * _ROOM).bit_length()
        edges, child = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        for e, slot in zip(edge, _slot(np.array(list(edge), np.int64), size).tolist(), strict=True):
            while edges[slot] >= 0:
                slot = (slot + 1) % size
            edges[slot], child[slot] = e, edge[e]
        piece, micro = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes), np.int64)
        for p, (i, score) in pieces.items():
            piece[nodes[p]], micro[nodes[p]] = i, score
        return PieceTrie(code, codes, edges, child, piece, micro, max(map(len, pieces), default=0))

    def step(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node after each node and character, or -1."""
        edge = node.astype(np.int64) * self.codes + code
        slot = _slot(edge, len(self.edges))
        here = self.edges[slot]
        out = np.where(here == edge, self.child[slot], -1)
        left = np.flatnonzero((here != edge) & (here >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.edges)
            here = self.edges[slot[left]]
            same = here == edge[left]
            out[left[same]] = self.child[slot[left[same]]]
            left = left[~same & (here >= 0)]
        return out


def _slot(edge: np.ndarray, size: int) -> np.ndarray:
    return ((edge.astype(np.uint64) * _FACTOR) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def lattice(distinct: list[str], trie: PieceTrie, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best segmentation of each unit: all ids in a row, and their number per unit.

    Every substring that is a piece is an edge of its unit's lattice: substrings meet the piece table along its beginnings, from all units
    with a character at a place at once. Places are taken from left to right, so that all edges to a place are known before those from it; each
    end keeps the best score, of equal ones that with the longer last piece. Every character also has an edge of byte pieces. A unit is at
    most a few hundred characters, and so is its lattice.
    """
    length = np.fromiter(map(len, distinct), np.int64, len(distinct))
    # By place, then unit, the long ones first: those with a character at a place lie side by side.
    order = np.argsort(-length, kind="stable")
    points = np.frombuffer("".join(distinct).encode("utf-32-le"), np.uint32)
    first, length = (np.cumsum(length) - length)[order], length[order]
    live = np.searchsorted(-length, -np.arange(1, int(length.max(initial=0)) + 1), side="right")
    base = np.concatenate([[0], np.cumsum(live)])
    chars = np.concatenate([points[:0], *(points[first[:m] + i] for i, m in enumerate(live))])
    code = trie.code[chars]
    by_bytes = _utf8_sizes(chars) * round(BYTE_SCORE * 10**DIGITS)
    score, back, last = np.full(len(chars), -(1 << 62)), np.zeros(len(chars), np.int32), np.full(len(chars), -1, np.int32)
    for i, m in enumerate(live.tolist()):
        before = score[base[i - 1] : base[i - 1] + m] if i else np.zeros(m, np.int64)
        unit, node = np.arange(m), np.zeros(m, np.int64)
        for k in range(i, min(i + trie.longest, len(live))):
            some = np.searchsorted(unit, live[k])
            unit, at = unit[:some], base[k] + unit[:some]
            node = trie.step(node[:some], code[at])
            met = np.flatnonzero(node >= 0)
            if not len(met):
                break
            unit, node, at = unit[met], node[met], at[met]
            piece = trie.piece[node]
            whole = np.flatnonzero(piece >= 0)
            reached, to = before[unit[whole]] + trie.micro[node[whole]], at[whole]
            better = reached > score[to]
            to = to[better]
            score[to], back[to], last[to] = reached[better], i, piece[whole[better]]
        here = np.arange(base[i], base[i] + m)
        reached = before + by_bytes[here]
        better = reached > score[here]
        here = here[better]
        score[here], back[here], last[here] = reached[better], i, -1
    ends, steps = np.flatnonzero(length > 0), []
    upto = length[ends]
    while len(ends):
        at = base[upto - 1] + ends
        steps.append((ends, at))
        upto = back[at]
        ends, upto = ends[upto > 0], upto[upto > 0]
    count = np.zeros(len(distinct), np.int64)
    for unit, _ in steps:
        count[order[unit]] += 1
    after = np.cumsum(count)
    places = np.zeros(int(count.sum()), np.int64)
    for k, (unit, at) in enumerate(steps):
        places[after[order[unit]] - 1 - k] = at
    return _with_bytes(last[places], chars[places], count, byte_ids)


def _utf8_sizes(points: np.ndarray) -> np.ndarray:
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


def _with_bytes(ids: np.ndarray, chars: np.ndarray, count: np.ndarray, byte_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of -1 as the byte pieces of their character."""
    some = np.flatnonzero(ids < 0)
    if not len(some):
        return ids, count
    each, of = np.unique(chars[some], return_inverse=True)
    spelled = [chr(c).encode() for c in each.tolist()]
    size = np.array([len(s) for s in spelled])
    width = np.ones(len(ids), np.int64)
    width[some] = size[of]
    out = np.repeat(ids, width)
    flat = byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    out[_ranges((np.cumsum(width) - width)[some], size[of])] = flat[_ranges((np.cumsum(size) - size)[of], size[of])]
    return out, np.bincount(np.repeat(np.arange(len(count)), count), weights=width, minlength=len(count)).astype(np.int64)


class _Words:
    """Words met so far, by number, with their ids in flat arrays."""

    def __init__(self, tables, by_suffix):
        self.trie, self.byte_ids, self.cut, spelled = tables
        self.by_suffix = by_suffix
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.size = np.array([len(s) for s in spelled])
        self.first = np.cumsum(self.size) - self.size
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.chars = 0
        self.ids, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def units(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, and their number per unit, held to the bytes of the units."""
        length = np.fromiter(map(len, distinct), np.int64, len(distinct))
        long = np.flatnonzero(length > UNIT_CHARS).tolist()
        ids, count = lattice([u if len(u) <= UNIT_CHARS else "" for u in distinct] if long else distinct, self.trie, self.byte_ids)
        if long:
            between = np.split(ids, (np.cumsum(count) - count)[long])
            apart = [np.array(best_pieces(distinct[k], *self.by_suffix.value), np.int32) for k in long]
            ids = np.concatenate([between[0], *(x for pair in zip(apart, between[1:], strict=True) for x in pair)])
            count[long] = [len(x) for x in apart]
        whole = "".join(distinct)
        size = self.size[ids]
        lengths = np.bincount(np.repeat(np.arange(len(count)), count), weights=size, minlength=len(count))
        points = np.concatenate([[0], np.cumsum(_utf8_sizes(np.frombuffer(whole.encode("utf-32-le"), np.uint32)))])
        wanted = np.diff(points[np.concatenate([[0], np.cumsum(length)])])
        text = np.frombuffer(whole.encode(), np.uint8)
        wrong = np.flatnonzero(lengths != wanted)
        if not len(wrong):
            different = np.flatnonzero(self.spelled[_ranges(self.first[ids], size)] != text)
            wrong = np.searchsorted(np.cumsum(wanted), different, side="right")
        if len(wrong):
            raise ValueError(f"the lattice has no segmentation of {distinct[int(wrong[0])]!r}")
        return ids, count

    def add(self, new: list[str]) -> None:
        if not new:
            return
        parts = [self.cut.split(w) for w in new]
        distinct: dict[str, int] = {}
        of = np.array([distinct.setdefault(u, len(distinct)) for us in parts for u in us])
        ids, count = self.units(list(distinct))
        first = np.cumsum(count) - count
        n_units = np.fromiter(map(len, parts), np.int64, len(parts))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.chars += sum(map(len, new))
        self.ids = np.concatenate([self.ids, ids[_ranges(first[of], count[of])]])
        self.count = np.concatenate([self.count, np.add.reduceat(count[of], np.cumsum(n_units) - n_units)])

    def segmented(self, texts: pa.Array) -> tuple[list[int], pa.ListArray]:
        """Number of words and ids of each text."""
        split = [words(t.as_py()) for t in texts]
        if len(self.number) > KNOWN_WORDS or self.chars > 16 * KNOWN_WORDS:
            self.forget()
        self.add(list(set().union(*split).difference(self.number)))
        n_words = [len(s) for s in split]
        number = self.number
        met = np.fromiter((number[w] for s in split for w in s), np.int64, sum(n_words))
        count = self.count[met]
        ids = self.ids[_ranges((np.cumsum(self.count) - self.count)[met], count)]
        offsets = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(n_words)]).astype(np.int64)]
        return n_words, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))


_OUT = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("pieces", pa.list_(pa.int32()))])
_OUT_TYPES = "id bigint, text string, n_words bigint, pieces array<int>"


def _segment(tables, by_suffix):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(tables.value, by_suffix)
        for batch in batches:
            upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))])
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + PART_BYTES, side="right")) - 1)
                part = batch.slice(a, b - a)
                n_words, pieces = known.segmented(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n_words, pa.int64()), pieces], schema=_OUT)
                a = b

    return run


def _spelled(model: str) -> dict[int, bytes]:
    return {i: bytes([byte]) if byte >= 0 else p.encode() for i, p, _, byte in vocabulary(model)}


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, blocks: int = BLOCKS,
) -> DataFrame:
    """Segment texts into pieces: ``id_col``, ``text_col``, ``n_words``, ``pieces`` (ids), one row per document.

    Only distinct units go through the lattice; those of more than ``UNIT_CHARS`` are segmented one by one. A task takes the documents of its split of an input file
    a megabyte at a time, and keeps the ids of the words it met; nothing is shuffled or written. With ``blocks`` above 1, documents of a split are dealt
    into as many blocks by a hash of the id. Rows that come from no file, because they were made or shuffled, fall into blocks of
    some ``BLOCK_BYTES`` by the hash of id and text.

    Null and empty texts have no pieces, and an empty table gives none. One row out per row in, whatever the ids. Other columns are ignored. U+2581 in a
    text is read as a blank, as in the library that defines these models.
    """
    spark = docs.sparkSession
    plain = {p: (i, round(s * 10**DIGITS)) for i, p, s, byte in vocabulary(model) if byte < 0}
    byte_ids = [i for _, i in sorted((byte, i) for i, _, _, byte in vocabulary(model) if byte >= 0)]
    if len(byte_ids) != 256:
        raise ValueError(f"{model} has no byte pieces")
    sizes = docs.select(F.when(F.input_file_name() == "", F.octet_length(F.col(text_col).cast("string"))).alias("size"))
    loose = sizes.agg(F.sum("size")).first()[0] or 0
    by_hash = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(1 + loose // BLOCK_BYTES))
    by_file = F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.pmod(F.xxhash64(F.col(id_col)), F.lit(blocks)))
    block = F.when(F.input_file_name() == "", by_hash).otherwise(by_file)
    columns = F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")
    read = docs.select(*columns)
    if loose or blocks > 1:
        read = docs.select(block.alias("block"), *columns).repartition("block").select("id", "text")
    spelled = _spelled(model)
    cut = cut_pattern(plain)
    tables = PieceTrie.of(plain), np.array(byte_ids, np.int32), cut, [spelled.get(i, b"") for i in range(max(spelled) + 1)]
    suffixes = ends_of_pieces({p: s for p, (_, s) in plain.items()}), {p: i for p, (i, _) in plain.items()}, byte_ids
    run = _segment(spark.sparkContext.broadcast(tables), spark.sparkContext.broadcast(suffixes))
    return read.mapInArrow(run, _OUT_TYPES).withColumnsRenamed({"id": id_col, "text": text_col})


def decode(encoded: DataFrame, pieces_col: str = "pieces", name: str = "decoded", model: str = DEFAULT_MODEL) -> DataFrame:
    """Add the text that the ids of ``pieces_col`` spell. Null ids stay null, no ids give an empty text; an id outside the
    vocabulary is an error."""
    shared = encoded.sparkSession.sparkContext.broadcast(_spelled(model))
    schema = StructType([*encoded.schema.fields, StructField(name, StringType())])
    at = encoded.columns.index(pieces_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = shared.value
        for batch in batches:
            upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))])
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(upto, upto[a] + DECODED_IDS, side="right")) - 1)
                part = batch.slice(a, b - a)
                out = []
                for row in part.column(at):
                    text = b"".join(map(spelled.__getitem__, row.as_py())).decode("utf-8", "replace") if row.is_valid else None
                    out.append(text if not text else text.removeprefix(BLANK).replace(BLANK, " "))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])
                a = b

    return encoded.mapInArrow(run, schema)
