"""WARC archives compressed record by record with a Zstandard dictionary.

An archive is a Zstandard stream: a skippable frame with the dictionary, then one
frame per record. Any record can be read by itself, given the dictionary. The
dictionary is built from the archive's first records.

Writing and reading are narrow jobs. Payload digests decide which of equal
payloads is stored; the other records refer to it. A writing task may be lost and
run again: each attempt writes files of its own, and only those named in the
returned (and stored) table of archives count.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mdlake.session import shared_dir, stored

_SKIPPABLE = 0x184D2A5D  # the magic number of the frame that holds the dictionary
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 1 << 20  # the first records of an archive from which its dictionary is built
ARCHIVE_BYTES = 32 << 20  # uncompressed records of an archive; a longer record has one of its own
LEVEL = 3
_DATE = datetime(2026, 1, 1, tzinfo=timezone.utc)  # archives are a function of their input


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, size: int) -> bytes:
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    http = b"" if kind == "revisit" else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if kind == "revisit" else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
        f"WARC-Date: {_DATE:%Y-%m-%dT%H:%M:%SZ}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_of(records: list[bytes]) -> bytes:
    """A dictionary trained on the records, or empty if they are too few or too short."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def archive_of(records: list[bytes]) -> bytes:
    """The bytes of an archive."""
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r)
        size += len(r)
    trained = dictionary_of(sample)
    packed = zstandard.ZstdCompressor(level=19).compress(trained) if trained else b""
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    return struct.pack("<II", _SKIPPABLE, len(packed)) + packed + b"".join(map(compressor.compress, records))


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != _SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    packed = archive[8 : 8 + size]
    trained = zstandard.ZstdDecompressor().decompress(packed) if packed else b""
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    rest = memoryview(archive)[8 + size :]
    while len(rest):
        one = reader.decompressobj()
        record = one.decompress(rest)
        rest = rest[len(rest) - len(one.unused_data) :]
        head, _, tail = record.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, tail[: int(headers["Content-Length"])]


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def save(records: list[bytes]) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(archive_of(records))
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": len(records)}], pa.schema([("path", pa.string()), ("records", pa.int64())]))

        records, size = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("kind", "page_id", "url", "html", "sha1", "refers_to", "size")]
            for kind, page, url, html, sha1, refers_to, n in zip(*columns):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                record = _record(kind, page, url, (html or "").encode(), digest, refers_to, n)
                if records and size + len(record) > ARCHIVE_BYTES:
                    yield save(records)
                    records, size = [], 0
                records.append(record)
                size += len(record)
        if records:
            yield save(records)

    return run


def plan_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` with kind, sha1, size and refers_to.

    Among equal payloads of at least ``least`` bytes the largest page_id is the response; the others revisit it. A null html is an
    empty payload. A null page_id sorts below all others; of several rows with the largest page_id, all are responses.
    Digests of repeated payloads are joined as a slim stored table, which Spark broadcasts only while it is small; hashes
    that repeat most are split by adaptive execution where it is not.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html", F.sha1(html).alias("sha1"), F.octet_length(html).cast("bigint").alias("size"))
    repeated = (
        pages.where(F.col("size") >= least).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    planned = pages.join(stored(repeated, "warc-repeated"), "sha1", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return planned.select("*", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first")).alias("refers_to")).drop("first")


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes (page_id, url, html) to archives in ``folder`` and returns (path, records) of the files that count."""
    written = plan_records(pages, least).mapInArrow(_write(folder), "path string, records bigint")
    return stored(written, "warc-archives")


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every record of the named archives.

    Lengths and digests of responses are those of the bytes that were read; a revisit has those in its headers and no payload.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def number(urn: str | None) -> int | None:
        return int(urn[len("<urn:page:") : -1]) if urn and len(urn) > len("<urn:page:>") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as file:
                    archive = file.read()
                rows, size = [], 0
                for head, block in records_of(archive):
                    row = {"page_id": number(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To"))}
                    if row["record_type"] == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        row |= {"payload_bytes": len(payload), "payload_digest": payload_digest(payload), "payload": payload}
                        size += len(payload)
                    else:
                        row |= {"payload_bytes": int(head["X-Payload-Length"]), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:")}
                    rows.append(row)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"
    return archives.repartition(max(1, min(archives.count(), 100_000)), "path").mapInArrow(run, kinds)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives below the shared one."""
    base = shared_dir(spark)
    return f"{base if ':' in base else 'file://' + base}/warc-{uuid.uuid4().hex}"
