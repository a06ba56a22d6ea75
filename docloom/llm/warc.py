"""WARC archives: a writer and a splittable reader.

The writer compresses each record as a gzip member of its own into files in a shared folder; tasks name their files
uniquely and report them, and only files of tasks whose report is committed are read, so lost or repeated tasks leave no
record behind. The reader cuts archives into byte ranges. A task scans its range for the gzip magic and validates a
candidate by inflating it up to a complete WARC header; it owns the records that start inside the range and reads on
beyond its end for the last. A candidate inside other compressed data is refused when the members after it don't lead
beyond the range.

Files are opened by URI with pyarrow's file systems (local or shared mounts, HDFS, S3, GCS).

Defined cases: a null payload is empty; a null url is an empty target; of equal payloads of MIN_REVISIT bytes or more
the one with the smallest id is the response, rows that share this id are all responses; a null id is never the response
of others; no rows, no archives and no records; damaged archives raise, and so does reading another number of records
than was written. Ids are carried in the record ids.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import join_frequent, materialize, text_of
from docloom.sources.scratch import scratch_path

MAGIC = b"\x1f\x8b\x08"
MIN_REVISIT = 100
#: Bytes after which a new archive is begun, of a range, and of a read.
ARCHIVE, RANGE, READ = 256 << 20, 8 << 20, 256 << 10
#: Bytes that are inflated at a time in search of a WARC header's end.
HEADER = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_types(pages: DataFrame, key: str, url: str, payload: str) -> DataFrame:
    """(id, url, payload, digest, refers_to): which rows revisit another's payload; refers_to is null for responses."""
    rows = pages.select(F.col(key).cast("long").alias("id"), text_of(url).alias("url"), text_of(payload).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    ids = materialize(rows.filter(F.octet_length("payload") >= MIN_REVISIT).select("id", "digest"), "ids")
    first = ids.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL")
    again = join_frequent(ids, materialize(first, "first"), ["digest"], "n", ids.count())
    again = again.filter(~F.col("id").eqNullSafe(F.col("first"))).select("id", "digest", "first").distinct()
    again = again.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
    return rows.join(again, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").drop("_id", "_digest")


def record_id(number: int | None) -> str:
    return f"<urn:page:{'' if number is None else number}>"


def record_bytes(number: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC/1.1 record, uncompressed. A revisit keeps the HTTP header with the full payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(number)}",
        f"WARC-Date: {date}",
        "WARC-Target-URI: " + " ".join(url.split()),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
        payload = b""
    fields.append(f"Content-Length: {len(http) + len(payload)}")
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of ``record_types`` as archives in ``folder``; returns the committed list (path, bytes, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out, path, size, n = None, "", 0, 0
        done = []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                for row in zip(*(piece.column(k).to_pylist() for k in range(5)), strict=True):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        store.create_dir(root, recursive=True)
                        out, path, size, n = store.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}", 0, 0
                    data = member(record_bytes(row[0], row[1], row[2], row[3], row[4], date))
                    out.write(data)
                    size, n = size + len(data), n + 1
                    if size >= ARCHIVE:
                        out.close()
                        done.append((path, size, n))
                        out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        if done:
            paths, sizes, counts = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], names=["path", "bytes", "records"])

    rows = records.select("id", "url", "payload", "digest", "refers_to")
    return materialize(rows.mapInArrow(run, "path string, bytes long, records long"), "archives")


def _header(block: bytes) -> tuple[dict[str, str], int] | None:
    """(fields, length) of the WARC header that ``block`` starts with, or None."""
    if not block.startswith(b"WARC/1."):
        return None
    end = block.find(b"\r\n\r\n")
    if end < 0:
        return None
    fields = {}
    for line in block[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return (fields, end + 4) if "warc-type" in fields and fields.get("content-length", "").isdigit() else None


class _Reader:
    """Reads of a file by position, through one buffer."""

    def __init__(self, source, size: int):
        self.source, self.size, self.at, self.data = source, size, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.source.seek(at)
            self.at, self.data = at, self.source.read(max(n, READ))
        return self.data[at - self.at : at - self.at + n]


def _is_member(file: _Reader, at: int) -> bool:
    """Whether a gzip member with a WARC record starts here: its header is inflated, however long, and parsed."""
    z, block, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while not z.eof:
            data = file.read(pos, 4096)
            if not data:
                break
            pos += len(data)
            while data:
                more = z.decompress(data, HEADER)
                data = z.unconsumed_tail
                seam = max(0, len(block) - 3)
                block += more
                if block.find(b"\r\n\r\n", seam) >= 0:
                    return _header(bytes(block)) is not None
                if not block.startswith(b"WARC/1."[: len(block)]):
                    return False
    except zlib.error:
        return False
    return False


def _inflated(file: _Reader, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the member at ``at``; None if it is damaged or cut short."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            data = file.read(pos, READ)
            if not data:
                return None
            pos += len(data)
            out.append(z.decompress(data))
    except zlib.error:
        return None
    return b"".join(out), pos - len(z.unused_data)


def records_in_range(file: _Reader, start: int, end: int) -> list[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records whose member starts in [start, end)."""
    at, broken = start, None
    while at < min(end, file.size):
        window = file.read(at, min(READ, min(end + 2, file.size) - at))
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - 2)
            continue
        at += found
        if at >= end:
            break
        if not _is_member(file, at):
            at += 1
            continue
        # A true member is followed by members up to the range's end; one inside other data is not.
        out, pos = [], at
        while pos < min(end, file.size):
            if file.read(pos, 3) != MAGIC or (got := _inflated(file, pos)) is None or (head := _header(got[0])) is None:
                break
            fields, body = head
            out.append((fields, got[0][body : body + int(fields["content-length"])]))
            pos = got[1]
        if pos >= min(end, file.size):
            return out
        broken = at if broken is None else broken
        at += 1
    if broken is not None:
        raise ValueError(f"the archive is damaged: no unbroken records from byte {broken} on")
    return []


def ranges(archives: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, bytes, start, end) of byte ranges, a range to a task."""
    rows = archives.filter("bytes > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(size).cast("long"))))
    rows = rows.select("path", "bytes", "start", F.least(F.col("start") + size, F.col("bytes")).alias("end"))
    return rows.repartition(max(1, rows.count()))


def read_archives(parts: DataFrame, with_payload: bool = True) -> DataFrame:
    """(record_id, type, target, refers_to, declared_digest, digest, payload_bytes[, payload]) of every record.

    digest is computed from the payload read (null for revisits); payload_bytes is the HTTP header's length, so it is
    the full payload's for revisits too. A response whose payload isn't as declared raises.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(path) as source:
                    found = records_in_range(_Reader(source, row["bytes"]), row["start"], row["end"])
                out = []
                for fields, block in found:
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                    declared = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    seen = hashlib.sha256(payload).hexdigest() if fields["warc-type"] == "response" else None
                    if seen is not None and (seen != declared or len(payload) != length):
                        raise ValueError(f"payload of {fields.get('warc-record-id')} isn't as declared")
                    out.append((fields.get("warc-record-id"), fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-refers-to"), declared, seen, length, payload))
                if out:
                    cols = list(zip(*out, strict=True))
                    arrays = [pa.array(c, pa.int64() if k == 6 else pa.binary() if k == 7 else pa.string()) for k, c in enumerate(cols)]
                    names = ["record_id", "type", "target", "refers_to", "declared_digest", "digest", "payload_bytes", "payload"]
                    n = 8 if with_payload else 7
                    yield pa.RecordBatch.from_arrays(arrays[:n], names=names[:n])

    schema = "record_id string, type string, target string, refers_to string, declared_digest string, digest string, payload_bytes long"
    return parts.mapInArrow(run, schema + (", payload binary" if with_payload else ""))


def page_number(column: str):
    """The id in a record id."""
    return F.regexp_extract(column, r"<urn:page:(-?\d+)>", 1).try_cast("long")


def archived(spark: SparkSession, pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write a record for each page, read the archives back; one row per record."""
    folder = scratch_path(spark, "warc")
    files = write_archives(record_types(pages, key, url, payload), folder)
    back = materialize(read_archives(ranges(files), with_payload=False), "records")
    written, read = files.agg(F.sum("records")).first()[0] or 0, back.count()
    if read != written:
        raise ValueError(f"{written} records were written, but {read} read back")
    return back.select(
        page_number("record_id").alias(key),
        "payload_bytes",
        F.col("declared_digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        page_number("refers_to").alias("refers_to"),
    )
