"""WARC archives of web pages: written by tasks beside an index, read back by coalesced byte ranges of the index."""

from __future__ import annotations

import base64
import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textreg.llm.batches import stage
from textreg.plans.stage import shared_root

#: Payloads from this size on are stored once; equal ones become revisits.
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 128 << 20
#: One read spans gaps up to this size and ends at this length.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20


def open_folder(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder URI (file, hdfs, s3, gs, abfs ...); a bare path is a local one."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def _base32(sha1: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1)).decode()


def _record(row: dict) -> bytes:
    """One WARC record as a gzip member of its own, so a byte range of the archive can be read alone."""
    payload = b"" if row["refers_to"] is not None else (row["payload"] or "").encode("utf-8", "surrogatepass")
    fields = [
        ("WARC-Type", row["record_type"]),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{row["id"]}:{row["url"]}:{row["sha1"]}')}>"),
        ("WARC-Target-URI", " ".join((row["url"] or "").split())),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{_base32(row['sha1'])}"),
        ("X-Payload-Length", row["bytes"]),
        ("X-Page-ID", "" if row["id"] is None else row["id"]),
        *([("X-Refers-To-Page-ID", row["refers_to"])] if row["refers_to"] is not None else []),
        ("Content-Type", "text/html"),
        ("Content-Length", len(payload)),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n", 6, mtime=0)


_INDEX = pa.schema([
    ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()),
    ("id", pa.int64()), ("record_type", pa.string()),
])
_INDEX_TYPES = "archive string, offset bigint, length bigint, url string, digest string, id bigint, record_type string"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for row in batch.to_pylist():
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        # A name per attempt: what a lost or repeated attempt leaves is in no index.
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    data = _record(row)
                    out.write(data)
                    index.append({
                        "archive": name, "offset": at, "length": len(data), "url": row["url"], "digest": row["sha1"],
                        "id": row["id"], "record_type": row["record_type"],
                    })
                    at += len(data)
                yield pa.RecordBatch.from_pylist(index, schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
) -> tuple[str, DataFrame]:
    """Write one record per page and return the folder and its index (written before it is returned).

    Of pages with equal payloads of at least ``revisit_bytes``, the largest id is stored as a response and the
    others as revisits that name it; equal means equal SHA-1 and length. The index has ``archive``, ``offset``,
    ``length``, ``url``, ``digest``, ``id`` and ``record_type``. Archives are files of one task each, of about
    ``ARCHIVE_BYTES``; pages move once, to meet their decision.

    A null payload counts as empty, a null url is an empty field. A page without an id is a response of its own.
    Pages that share id and payload are all responses or all revisits. Other columns are ignored.
    """
    spark = pages.sparkSession
    if folder is None:
        folder = f"{shared_root(spark)}/textreg/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    facts = pages.select(F.col(id_col).cast("bigint").alias("id"), F.sha1(payload).alias("sha1"), F.length(payload).cast("bigint").alias("bytes"))
    large = facts.filter((F.col("bytes") >= revisit_bytes) & F.col("id").isNotNull())
    kept = large.groupBy("sha1", "bytes").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    revisits = large.join(kept.drop("n"), ["sha1", "bytes"]).filter("id != refers_to").select("id", "sha1", "refers_to").distinct()
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.col(payload_col).cast("string").alias("payload"), F.sha1(payload).alias("sha1"),
        F.length(payload).cast("bigint").alias("bytes"),
    ).join(revisits, ["id", "sha1"], "left")
    rows = rows.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    make_folder(folder)
    index = rows.select("id", "url", "payload", "sha1", "bytes", "refers_to", "record_type").mapInArrow(_write(folder), _INDEX_TYPES)
    return folder, stage(index, "warc-index")


def make_folder(folder: str) -> None:
    system, root = open_folder(folder)
    system.create_dir(root, recursive=True)


def _parse(data: bytes) -> dict:
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])]
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "id": int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"], "payload": None if revisit else payload,
        "payload_bytes": int(fields["X-Payload-Length"]) if revisit else len(payload),
        "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex(),
        "refers_to": int(fields["X-Refers-To-Page-ID"]) if revisit else None,
    }


_READ = pa.schema([
    ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
    ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()),
])


def _read(folder: str):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        archive, source = None, None

        def flush(name: str, held: list[tuple[int, int]]) -> pa.RecordBatch:
            nonlocal archive, source
            if name != archive:
                if source is not None:
                    source.close()
                archive, source = name, system.open_input_file(f"{root}/{name}")
            first, last = held[0][0], held[-1][0] + held[-1][1]
            data = source.read_at(last - first, first)
            out = [_parse(data[a - first : a - first + n]) for a, n in held]
            for r in out:
                if r["payload"] is not None and hashlib.sha1(r["payload"]).hexdigest() != r["payload_digest"]:
                    raise ValueError(f"payload of page {r['id']} in {name} does not match its digest")
            return pa.RecordBatch.from_pylist(out, schema=_READ)

        name, held = None, []
        for batch in batches:
            for a, at, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (a != name or at - sum(held[-1]) > GAP_BYTES or at + n - held[0][0] > READ_BYTES):
                    yield flush(name, held)
                    held = []
                name = a
                held.append((at, n))
        if held:
            yield flush(name, held)
        if source is not None:
            source.close()

    return run


def read_records(folder: str, selected: DataFrame) -> DataFrame:
    """Read the records of the ``selected`` index rows: sorted by archive and offset, near ones in one read.

    Returns ``id``, ``url``, ``record_type``, ``payload`` (null for a revisit), ``payload_bytes``, ``payload_digest``
    (of the full payload, checked for responses) and ``refers_to``. Ranges of one archive are dealt by stretches of
    ``READ_BYTES``, so a large archive is read by many tasks. Selecting nothing reads nothing.
    """
    spots = selected.select("archive", "offset", "length", F.expr(f"offset div {READ_BYTES}").alias("stretch"))
    dealt = spots.repartition("archive", "stretch").sortWithinPartitions("archive", "offset")
    return dealt.select("archive", "offset", "length").mapInArrow(
        _read(folder),
        "id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint",
    )
