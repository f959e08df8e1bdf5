"""WARC archives: a writer with revisit records, and a reader that splits gzip archives by byte ranges.

An archive holds one gzip member per record. A reading task scans its range for the gzip magic, takes a place for a
member only if the bytes there decode to a WARC header, and reads the records that start inside its range, past the
range's end if need be; so ranges need no index and every record belongs to one task. Archives lie in a folder that all
executors reach, by any file system of pyarrow. A writing task that is run again writes a new file, and only the files
named by the tasks that succeeded are read.

Defined cases: a null payload is empty; rows of a null page_id are kept and revisit the page of an equal payload that has an
id (without one they are responses); rows of one page_id give a record each, judged by their own payloads (equal ones of the
smallest page_id are all responses); payloads are kept whole; an empty table gives no archive and an empty result; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.session import cut, drop_folder, new_folder, written

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this many bytes are always responses.
LEAST_REVISIT = 100
SPLIT_BYTES, READ_BYTES, FILE_BYTES = 8 << 20, 1 << 18, 256 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = {"WARC-Type": kind} | headers | {"Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(4, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (with lower-case names) and block of a decoded record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError("the record ends early")
    return fields, rest[:size]


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to: for each page the response that it revisits, or null.

    Only ids and digests are compared: a digest's first page is found by partial minima, and the pages other than the first
    are joined back by id and digest, so that a common page's payloads don't meet in one task.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    with_id = lambda df: df.withColumns({"no_id": F.col("page_id").isNull(), "id": F.coalesce("page_id", F.lit(0))})
    large = with_id(rows.where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", "digest"))
    first = cut(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"))
    later = cut(large.join(first, "digest").where("no_id or id <> first").select("no_id", "id", "digest", F.col("first").alias("refers_to")).distinct())
    return with_id(rows).join(later, ["no_id", "id", "digest"], "left").drop("no_id", "id")


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Archives of rows (page_id, url, payload, digest, refers_to); returns path and size of each file, materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        out, path, size, done = None, "", 0, []
        for b in batches:
            for page, url, payload, digest, first in zip(*[b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")], strict=True):
                if out is None or size >= FILE_BYTES:
                    if out is not None:
                        out.close()
                        done.append((path, size))
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, size = system.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0
                headers = {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": (url or "").replace("\r", " ").replace("\n", " "), "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": str(len(payload)), "X-Page-ID": "" if page is None else str(page), "Content-Type": "application/http; msgtype=response"}
                if first is None:
                    data = record("response", headers, HTTP % len(payload) + payload)
                else:
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "X-Refers-To-Page-ID": str(first)}
                    data = record("revisit", headers, HTTP % len(payload))
                size += out.write(packed := member(data)) or len(packed)
        if out is not None:
            out.close()
            done.append((path, size))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], names=["path", "size"])

    return cut(rows.mapInArrow(run, "path string, size bigint"))


class _Window:
    """Bytes of a file from some place on, read as they are asked for."""

    def __init__(self, file: pa.NativeFile, start: int):
        self.file, self.base, self.data, self.ended = file, start, b"", False
        file.seek(start)

    def more(self) -> bool:
        got = self.file.read(READ_BYTES)
        self.ended = not got
        self.data += got
        return bool(got)

    def at(self, place: int, size: int) -> bytes:
        while len(self.data) < place - self.base + size and self.more():
            pass
        return self.data[place - self.base : place - self.base + size]

    def drop(self, place: int) -> None:
        self.data, self.base = self.data[place - self.base :], place


def _decoded(w: _Window, place: int) -> tuple[bytes, int] | None:
    """The member at a place and where it ends; None if no WARC record begins there."""
    d, out, at = zlib.decompressobj(31), [], place
    try:
        while not d.eof:
            piece = w.at(at, READ_BYTES)
            if not piece:
                return None
            out.append(d.decompress(piece))
            at += len(piece)
            if sum(map(len, out)) >= 5 and not b"".join(out[:2])[:5] == b"WARC/":
                return None
    except zlib.error:
        return None
    return b"".join(out), at - len(d.unused_data)


def records(file: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Place, fields and block of the records whose members start in [start, end)."""
    w, place = _Window(file, start), start
    while place < end:
        if w.at(place, 3) == MAGIC and (found := _decoded(w, place)):
            yield place, *parsed(found[0])
            place = found[1]
            w.drop(place)
            continue
        w.at(place, READ_BYTES)
        at = w.data.find(MAGIC, place - w.base + 1)
        if at < 0:
            place = max(place + 1, w.base + len(w.data) - 2)
            if w.ended:
                return
            w.drop(place)
        else:
            place = w.base + at


def read(files: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """The records of files (path, size): page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to.

    A response's payload and digest are those of the bytes read back; a record that contradicts its headers fails the task.
    """
    spark = files.sparkSession
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long")))
    splits = files.where("size > 0").select("path", starts.alias("start")).repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
        names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for b in batches:
            for path, start in zip(*[b.column(c).to_pylist() for c in ("path", "start")], strict=True):
                system, at = _open(path)
                out = []
                with system.open_input_file(at) as file:
                    for _, fields, block in records(file, start, start + split):
                        kind, digest, size = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2], int(fields["x-payload-length"])
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"{path}: the payload of page {fields['x-page-id']} isn't what its header says")
                        page, first = fields["x-page-id"], fields.get("x-refers-to-page-id")
                        out.append((int(page) if page else None, fields["warc-target-uri"], kind, payload, size, digest, int(first) if first else None))
                        if len(out) == 200:
                            yield batch(out)
                            out = []
                yield batch(out)

    return splits.mapInArrow(run, "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes an archive of pages and reads it back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The archive is deleted when the small result has been written.
    """
    spark: SparkSession = pages.sparkSession
    folder = new_folder(spark, "warc")
    files = write(decided(pages), folder)
    result, _ = written(read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    drop_folder(spark, folder)
    return result
