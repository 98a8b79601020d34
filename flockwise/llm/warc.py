"""WARC archives: index first, then coalesced byte-range reads of the selected records."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flockwise.llm.common import slices, stored, text_or_empty
from flockwise.session import scratch_path

#: The profile of a revisit and the media type of its block.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEDIA = "application/http; msgtype=response"
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    path = re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", path))
    return fs.FileSystem.from_uri(path)


def record_id(page_id: int | None) -> str:
    """A custom (version 8) UUID that holds the page id; a null id has a mark of its own."""
    number = (page_id or 0) & (2**64 - 1)
    value = (0 if page_id is not None else 1) << 80 | 8 << 76 | (number >> 62) << 64 | 2 << 62 | number & (2**62 - 1)
    return f"urn:uuid:{uuid.UUID(int=value)}"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 80:
        return None
    number = (value >> 64 & 3) << 62 | value & (2**62 - 1)
    return number - 2**64 if number >> 63 else number


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, revisit_of: int | None, revisit: bool, date: str) -> bytes:
    """One record, without compression. A revisit keeps the response's HTTP headers, but no payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]", lambda m: "%0D" if m[0] == "\r" else "%0A", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <{record_id(revisit_of)}>", f"WARC-Profile: {PROFILE}"]
    else:
        block += payload
    head += [f"Content-Type: {MEDIA}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return named, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row to gzipped archives below ``folder``; returns the index of all records.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, those with the largest
    ``page_id`` are responses and the others revisit it. Repeated page numbers fold before the payloads
    move, and only digests that occur twice are joined, so a frequent payload meets one small row.

    Each task writes its own file under a fresh name and reports it in the index, which is
    stored at once: a task that runs again leaves an unlisted file, never a wrong entry.

    A null html is an empty payload; a null url is left out of the record; a row with a null id is a
    response unless an equal payload has an id. Rows that repeat an id and payload each get a record of
    that type. Other columns are ignored; an empty table gives an empty index.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.encode(text_or_empty("html"), "utf-8").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    digests = rows.select("sha", "page_id", F.length("payload").alias("size")).where(F.col("size") >= min_revisit_bytes)
    twice = digests.groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("last")).where("n > 1").select("sha", "last")
    marked = rows.join(twice, "sha", "left").select("page_id", "url", "sha", "last", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        offset, out = 0, None
        for batch in slices(batches, 4):
            if out is None:
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            listed = []
            for page_id, url, sha, last, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = base64.b32encode(sha).decode()
                revisit = last is not None and page_id != last
                raw = record(page_id, url, payload, digest, last, revisit, date)
                packer = zlib.compressobj(4, wbits=31)
                member = packer.compress(raw) + packer.flush()
                out.write(member)
                listed.append((page_id, url, f"{folder.rstrip('/')}/{name}", offset, len(member), digest, "revisit" if revisit else "response"))
                offset += len(member)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["page_id", "url", "file", "offset", "length", "payload_digest", "record_type"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in listed], k) for i, k in enumerate(kinds)], names)
        if out is not None:
            out.close()

    return stored(marked.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, gap: int = 64 << 10, most: int = 8 << 20) -> DataFrame:
    """The records that ``index`` lists (any selection of its rows), read by byte ranges.

    Rows are dealt by ranges of file and offset. Within a task, neighbours at most ``gap`` bytes
    apart are read together, up to ``most`` bytes or one record at a time. Payloads are checked against their digests.
    """

    def fetch(rows: list[tuple[str, int, int]]) -> Iterator[bytes]:
        system, path = _filesystem(rows[0][0])
        start = rows[0][1]
        with system.open_input_file(path) as f:
            data = f.read_at(max(o + n for _, o, n in rows) - start, start)
        for _, offset, length in rows:
            yield zlib.decompress(data[offset - start : offset - start + length], wbits=31)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[str, int, int]] = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (row[0] != held[0][0] or row[1] > held[-1][1] + held[-1][2] + gap or row[1] + row[2] - held[0][1] > most):
                    yield decoded(held)
                    held = []
                held.append(row)
            if held:
                yield decoded(held)

    def decoded(held: list[tuple[str, int, int]]) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        for raw in fetch(held):
            head, http, payload = parsed(raw)
            digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
            if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"damaged payload in {held[0][0]}: {head['WARC-Record-ID']}")
            refers = page_of(head["WARC-Refers-To"]) if kind == "revisit" else None
            values = (page_of(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, int(http["Content-Length"]), digest, refers, payload if kind == "response" else None)
            for column, value in zip(out, values, strict=True):
                column.append(value)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [c.split()[0] for c in RECORDS.split(", ")])

    wanted = index.select("file", "offset", "length")
    n = max(1, index.sparkSession.sparkContext.defaultParallelism)
    return wanted.repartitionByRange(4 * n, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, RECORDS)


def archive_folder(spark) -> str:
    return scratch_path(spark, "warc")
