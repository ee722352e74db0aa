"""WARC archives: a writer with revisit records, and a splittable reader.

Archives hold one gzip member a record. The reader splits files into byte ranges
of any size. A task scans its range for the gzip magic, decodes the head of each
candidate member to see whether a WARC record begins there, and owns the records
that start inside its range; it reads on past the end to finish the last. Two
tasks thus never return one record twice, and none is missed, wherever ranges
are cut.

Files are read and written by executors through pyarrow's file systems, in the
shared folder; each is written under another name and then moved, so a task
that runs twice leaves one whole file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import mapped, shared_dir, slices, written

RANGE = 16 << 20
MAGIC = b"\x1f\x8b\x08"
PROBE = 1 << 14
ID = "urn:page:"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SHARE = 1000
LEAST_REVISIT = 0  # bytes; smaller payloads are always whole responses

RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path with a scheme; Hadoop's names of S3 are known too."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark takes for paths without one, so that executors write where Spark's readers look."""
    if re.match("[A-Za-z][A-Za-z0-9+.-]*:", path):
        return path
    base = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    return base.rstrip("/") + ("//" if base.startswith("file:") and base.rstrip("/") == "file:" else "") + path


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{page_id}>", f"WARC-Target-URI: {url}", f"WARC-Date: {datetime(2020, 1, 1, tzinfo=UTC):%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{ID}{refers_to}>", f"WARC-Profile: {REVISIT}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def clean_url(url: str | None) -> str:
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes pages (page_id, url, html) as archives in ``folder``; returns their paths and sizes.

    Of pages with equal payloads of ``least`` bytes or more that with the smallest
    id is written whole, the others as revisits of it; each row gives one record,
    also where an id has several payloads. The folder must be one that all
    executors share.
    """
    folder = qualified(pages.sparkSession, folder)
    rows = pages.selectExpr("cast(page_id as bigint) page_id", "url", "html").where("page_id is not null")
    rows = rows.withColumns({"digest": F.sha1(F.coalesce("html", F.lit("")).cast("binary")), "size": F.coalesce(F.octet_length("html"), F.lit(0))})
    sums = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(sums.select(F.col("digest").alias("same"), F.col("size").alias("same_size"), "first", "n"), "payloads")
    # A payload that has more than a share of all repeats is told by broadcast: there are fewer than SHARE of those, and the others are small keys of a join.
    often = F.col("n") * SHARE > (first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    hot, rest = (first.where(c).drop("n") for c in (often, ~often))
    marked = rows.join(F.broadcast(hot.withColumnsRenamed({"same": "hot", "same_size": "hot_size", "first": "hot_first"})), (F.col("digest") == F.col("hot")) & (F.col("size") == F.col("hot_size")), "left")
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("hot "), F.col("page_id").cast("string")))
    marked = marked.withColumn("key", key).join(rest, (F.col("key") == F.col("same")) & (F.col("size") == F.col("same_size")), "left")
    marked = marked.withColumn("first", F.coalesce("hot_first", "first")).select("page_id", "url", F.when(F.col("first") != F.col("page_id"), F.col("first")).alias("first"), "html")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, where = filesystem(folder)
        name = f"{where}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        fs.create_dir(where, recursive=True)
        part, size = f"{where}/.{uuid.uuid4().hex}", 0
        with fs.open_output_stream(part, compression=None) as out:
            for batch in slices(batches, 3):
                for page, url, refers, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    data = (html or "").encode()
                    size += out.write(record(page, clean_url(url), digest_of(data), len(data), refers, data))
        if not size:
            fs.delete_file(part)
            return
        fs.move(part, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "size": pa.array([size], pa.int64())})

    return written(mapped(marked, write, "path string, size long"), "archives")


class Window:
    """Bytes of a file from a position on, read ahead in steps and let go in steps."""

    def __init__(self, source: pa.NativeFile, start: int, step: int = 1 << 20):
        self.source, self.base, self.step = source, start, step
        source.seek(start)
        self.data = b""
        self.ended = False

    def end(self) -> int:
        return self.base + len(self.data)

    def more(self) -> bool:
        got = b"" if self.ended else self.source.read(self.step)
        self.ended = not got
        self.data += got
        return bool(got)

    def find(self, what: bytes, at: int) -> int:
        k = self.data.find(what, at - self.base)
        return k if k < 0 else k + self.base

    def get(self, at: int, size: int) -> bytes:
        """Up to ``size`` bytes from a position on, fewer only at the file's end."""
        if at - self.base > self.step:
            self.data = self.data[at - self.base :]
            self.base = at
        while self.end() < at + size and self.more():
            pass
        return self.data[at - self.base : at - self.base + size]


def is_record(view: Window, at: int) -> bool:
    """Whether a gzip member begins here whose content begins like a WARC record; its header may be of any length."""
    unpack, head, used = zlib.decompressobj(31), b"", 0
    try:
        while len(head) < 5 and not unpack.eof:
            data = view.get(at + used, 512)
            if not data:
                return False
            head += unpack.decompress(data, 5 - len(head))
            used += len(data) - len(unpack.unconsumed_tail)
    except zlib.error:
        return False
    return head == b"WARC/"


def records_in(path: str, start: int, end: int) -> Iterator[tuple[int, bytes, int]]:
    """(offset, content, size of the member) of the members holding records that start in bytes [start, end) of an archive."""
    fs, where = filesystem(path)
    with fs.open_input_file(where) as source:
        view = Window(source, start)
        at = start
        while True:
            while (k := view.find(MAGIC, at)) < 0 and view.end() < end + len(MAGIC) and view.more():
                pass
            if k < 0 or k >= end:
                return
            at = k
            if not is_record(view, at):
                at += 1
                continue
            unpack, out, used = zlib.decompressobj(31), [], 0
            try:
                while not unpack.eof:
                    chunk = view.get(at + used, PROBE)
                    if not chunk:
                        raise zlib.error("the member is cut off")
                    out.append(unpack.decompress(chunk))
                    used += len(chunk) - len(unpack.unused_data)
            except zlib.error:
                at += 1  # damaged: the search goes on behind its first byte
                continue
            yield at, b"".join(out), used
            at += used


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record of a member."""
    at = 0
    while (end := content.find(b"\r\n\r\n", at)) >= 0 and content.startswith(b"WARC/", at):
        headers = {}
        for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "")
        begin, at = end + 4, end + 4 + (int(size) if size.isdigit() else 0)
        yield headers, content[begin:at]
        while content.startswith(b"\r\n", at):
            at += 2


def page_of(value: str) -> int | None:
    text = value.strip("<>")
    number = text.removeprefix(ID)
    return int(number) if text.startswith(ID) and number.lstrip("-").isdigit() else None


def read_archives(files: DataFrame, range_bytes: int = RANGE, payloads: bool = True) -> DataFrame:
    """The records of archives given by (path, size); ranges are dealt out so that tasks share the bytes evenly.

    A revisit's payload is null; its size and digest are those of the full payload.
    A member may hold several records. Records of other writers, whose ids aren't
    pages', have a null page_id (and refers_to); the digests of such are passed on
    as they stand, while our own are checked against the payload.
    """
    start = F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(range_bytes))).alias("start")
    ranges = files.where("size > 0").select("path", start, "size").select("path", "start", F.least(F.col("start") + range_bytes, "size").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for path, begin, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                for _, content, _ in records_in(path, begin, end):
                    for headers, block in parsed(content):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, page = headers.get("warc-type"), page_of(headers.get("warc-record-id", ""))
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        if kind == "response":
                            if page is not None and digest_of(payload) != digest:
                                raise ValueError(f"{path}: the payload of {headers.get('warc-record-id')} has another digest")
                            rows.append((page, headers.get("warc-target-uri"), kind, None, len(payload), digest, payload if payloads else None))
                            held += len(payload) if payloads else 64
                        elif kind == "revisit":
                            size = next((x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
                            rows.append((page, headers.get("warc-target-uri"), kind, page_of(headers.get("warc-refers-to", "")), int(size) if size.isdigit() else None, digest, None))
                    if held > 1 << 22 or len(rows) > 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return mapped(ranges.repartition(F.col("path"), F.col("start")), run, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives below the shared folder and reads them back, without the payloads.

    Null html is an empty payload, a null url an empty one; pages with a null id
    can't be named in an archive and are left out; a repeated row is written
    again (as a response if its id is the first of its payload). An id with several
    payloads has a record for each, and each refers to the first page of its own.
    """
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_archives(pages, folder)
    return read_archives(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
