"""Files of pretrained word vectors as a Spark source: text and binary layout, read in byte ranges, with terms filtered while reading.

Register with ``spark.dataSource.register(WordVectors)`` and read with ``spark.read.format("word_vectors")``, or call ``read_vectors``. The
text layout has one line per term: the term and its numbers, with an optional first line of two counts. The binary layout has a first line of
two counts and then, per term, its bytes, a blank, and 32-bit floats, with or without a line break.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Bytes of one range; records that must follow one another for a place to count as a record start; longest term in bytes; terms of one batch.
RANGE_BYTES, CHAIN, LONGEST_TERM, BATCH = 64 << 20, 12, 1000, 4096
_SCHEMA = pa.schema([("term", pa.string()), ("vec", pa.list_(pa.float32()))])


@dataclass
class VectorRange(InputPartition):
    path: str
    start: int
    end: int
    width: int


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """The file, or the files of a folder but hidden ones, with their sizes."""
    system, inside = _open(path)
    prefix = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    info = system.get_file_info(inside)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no vectors at {path}")
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    found = system.get_file_info(pafs.FileSelector(inside))
    return sorted((prefix + f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._")


def _record(data: bytes, at: int, width: int) -> int | None:
    """Where the binary record at ``at`` ends; None if there can be none, -1 if the data ends before."""
    if data[at : at + 1] == b"\n":
        at += 1
    blank = data.find(b" ", at, at + LONGEST_TERM + 1)
    if blank < 0:
        return -1 if len(data) - at <= LONGEST_TERM else None
    if blank == at:
        return None
    term = data[at:blank]
    if any(b <= 32 or b == 127 for b in term):
        return None
    try:
        term.decode()
    except UnicodeDecodeError:
        return None
    if blank + 1 + 4 * width > len(data):
        return -1
    return blank + 1 + 4 * width if np.isfinite(np.frombuffer(data, "<f4", width, blank + 1)).all() else None


def _starts(data: bytes, width: int, chain: int, whole: bool) -> set[int]:
    """Ends of the first record that starts in ``data`` and from which ``chain`` more can be read (or all the rest, if the data is the file's end).

    Floats hold any bytes, so a place inside a record can look like a start. Chains from such places soon break.
    """
    found = set()
    for at in range(min(len(data), LONGEST_TERM + 4 * width + 2)):
        first = end = _record(data, at, width)
        for _ in range(chain):
            if end is None or end < 0 or end >= len(data):
                break
            end = _record(data, end, width)
        if first is not None and first >= 0 and end is not None and (end >= 0 or not whole):
            found.add(first)
    return found


class VectorReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.layout = options["path"], options.get("layout", "text")
        if self.layout not in ("text", "binary"):
            raise ValueError("layout must be 'text' or 'binary'")
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and membership of the term are applied while reading; other filters stay with Spark."""
        for f in filters:
            terms = {f.value} if isinstance(f, EqualTo) and f.attribute == ("term",) else None
            if isinstance(f, In) and f.attribute == ("term",):
                terms = set(f.value)
            if terms is None:
                yield f
            else:
                self.wanted = terms if self.wanted is None else self.wanted & terms

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for path, size in _files(self.path):
            head, width = self._head(path)
            cuts = [head]
            for at in range(self.range_bytes, size, self.range_bytes):
                start = at if self.layout == "text" else self._record_start(path, at, size, width)
                if start is not None and start > cuts[-1]:
                    cuts.append(start)
            out += [VectorRange(path, a, b, width) for a, b in zip(cuts, [*cuts[1:], size], strict=True)]
        return out

    def _head(self, path: str) -> tuple[int, int]:
        """Bytes of the line of counts, if there is one, and the width it states."""
        system, inside = _open(path)
        with system.open_input_file(inside) as f:
            line = f.read(200).split(b"\n")[0]
        counts = line.split()
        is_head = len(counts) == 2 and all(c.isdigit() for c in counts)
        if self.layout == "binary" and not is_head:
            raise ValueError(f"{path} does not start with two counts")
        return (len(line) + 1, int(counts[1])) if is_head else (0, 0)

    def _record_start(self, path: str, at: int, size: int, width: int) -> int | None:
        """A record start behind ``at``, by reading on until only one chain of records is left; None near the file's end."""
        system, inside = _open(path)
        chain = CHAIN
        while True:
            span = (chain + 2) * (LONGEST_TERM + 4 * width + 2)
            with system.open_input_file(inside) as f:
                f.seek(at)
                data = f.read(min(span, size - at))
            found = _starts(data, width, chain, at + len(data) >= size)
            if len(found) <= 1 or at + len(data) >= size:
                return at + found.pop() if len(found) == 1 and at + max(found, default=0) < size else None
            chain *= 4

    def read(self, partition: VectorRange) -> Iterator[pa.RecordBatch]:
        system, inside = _open(partition.path)
        terms: list[str] = []
        vectors: list[np.ndarray] = []
        with system.open_input_file(inside) as f:
            for term, vector in (self._lines if self.layout == "text" else self._records)(f, partition):
                terms.append(term)
                vectors.append(vector)
                if len(terms) == BATCH:
                    yield self._batch(terms, vectors)
                    terms, vectors = [], []
        if terms:
            yield self._batch(terms, vectors)

    def _batch(self, terms: list[str], vectors: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in vectors])])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(vectors), pa.float32()))
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), lists], schema=_SCHEMA)

    def _lines(self, f: pa.NativeFile, part: VectorRange) -> Iterator[tuple[str, np.ndarray]]:
        """Lines that start in the range; the one that reaches into it belongs to the range before."""
        f.seek(max(part.start - 1, 0))
        rest = b""
        at = f.tell()
        skipping = part.start > 0
        while at < part.end or rest:
            data = f.read(1 << 20)
            if not data and not rest:
                return
            lines = (rest + data).split(b"\n")
            begin = at
            rest = lines.pop() if data else b""
            for line in lines:
                if skipping:
                    skipping = False
                elif begin < part.end:
                    yield from self._parsed(line)
                else:
                    return
                begin += len(line) + 1
            at = begin
            if not data:
                return

    def _parsed(self, line: bytes) -> Iterator[tuple[str, np.ndarray]]:
        term, _, numbers = line.rstrip(b"\r ").partition(b" ")
        if numbers and (self.wanted is None or term.decode("utf-8", "replace") in self.wanted):
            yield term.decode("utf-8", "replace"), np.array(numbers.split(), np.float32)

    def _records(self, f: pa.NativeFile, part: VectorRange) -> Iterator[tuple[str, np.ndarray]]:
        f.seek(part.start)
        left, data = part.end - part.start, b""
        while left or data.strip(b"\n"):
            chunk = f.read(min(left, 4 << 20))
            left -= len(chunk)
            data += chunk
            at = 0
            while at < len(data):
                end = _record(data, at, part.width)
                if end is None or (end < 0 and not left and data[at:].strip(b"\n")):
                    raise ValueError(f"{part.path} has no record at byte {part.end - left - len(data) + at}")
                if end < 0:
                    break
                at += data[at : at + 1] == b"\n"
                blank = data.index(b" ", at)
                term = data[at:blank].decode()
                if self.wanted is None or term in self.wanted:
                    yield term, np.frombuffer(data, "<f4", part.width, blank + 1)
                at = end
            data = data[at:]
            if not chunk and not left:
                return


class WordVectors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "word_vectors"

    def schema(self) -> str:
        return "term string, vec array<float>"

    def reader(self, schema) -> DataSourceReader:
        return VectorReader(self.options)


def read_vectors(spark: SparkSession, path: str, layout: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``term, vec`` of a file or a folder of files. Ranges of ``range_bytes`` are read side by side; ``term = ..`` and ``term IN (..)`` are applied
    while reading. Lines without numbers are skipped; a binary file that does not hold records throughout is an error."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WordVectors)
    return spark.read.format("word_vectors").option("layout", layout).option("range_bytes", range_bytes).load(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """``term, vec`` as a folder of text files, one line per term. Terms must not hold white space."""
    numbers = F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")
    vectors.select(F.concat_ws(" ", "term", numbers)).write.text(path)
