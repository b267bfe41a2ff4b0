"""WARC archives: a writer and a sequential reader with bounded memory.

Writing: each task writes archives, one gzip member per record, under names of their own, and gives their paths
to a manifest table; an archive that has `archive_bytes` is closed and the next one begun, so an archive is a
bounded unit of work. A lost or repeated task leaves files that no manifest names. Equal payloads of at least
`least` bytes become one response (that of the largest page_id) and revisit records that refer to it.

Reading: as many tasks as there are archives, an archive each. Archives are opened through pyarrow's file systems and read in blocks. Each member is inflated by
zlib as its bytes come, headers are split off, the block is framed by Content-Length, and block and payload
digests are recomputed. A reader holds one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir

READ_BYTES = 1 << 16
#: Compressed bytes after which a writer closes an archive.
ARCHIVE_BYTES = 1 << 30
#: Bytes of records that a reader puts into one batch of rows.
BATCH_BYTES = 4 << 20
LEAST_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "<urn:page:%s>"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        """What follows the block's HTTP headers."""
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def http(self) -> dict[str, str]:
        lines = self.block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member with a response or, if it refers to another page, a revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = urllib.parse.quote(url or "", safe="%/:=&?~#+!$,;'@()*[]")
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _ID % page_id, "WARC-Date": DATE, "WARC-Target-URI": uri, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": "sha1:" + sha1(payload), "WARC-Block-Digest": "sha1:" + sha1(block)}
    if refers_to is not None:
        fields |= {"WARC-Refers-To": _ID % refers_to, "WARC-Profile": PROFILE}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode()) + deflate.compress(block) + deflate.compress(b"\r\n\r\n") + deflate.flush()


def members(source: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated bytes of each gzip member of a stream of blocks."""
    inflate, out, fresh = zlib.decompressobj(31), [], True
    for data in source:
        while data:
            out.append(inflate.decompress(data))
            fresh = False
            data = inflate.unused_data
            if inflate.eof:
                yield b"".join(out)
                inflate, out, fresh = zlib.decompressobj(31), [], True
    if not fresh:
        raise ValueError("the archive ends inside a member")


def parse(member: bytes) -> Record:
    """A record of one member; raises ValueError if its framing or a digest is wrong."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    headers = {k.strip(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["Content-Length"])
    record = Record(headers, rest[:n])
    if len(record.block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("the block isn't as long as Content-Length says")
    if headers.get("WARC-Block-Digest", "").removeprefix("sha1:") not in ("", sha1(record.block)):
        raise ValueError("block digest doesn't match")
    if headers["WARC-Type"] == "response" and headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") not in ("", sha1(record.payload)):
        raise ValueError("payload digest doesn't match")
    return record


def read_file(path: str) -> Iterator[Record]:
    fs, name = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_stream(name) as stream:
        for member in members(iter(lambda: stream.read(READ_BYTES), b"")):
            yield parse(member)


def with_revisits(pages: DataFrame, *, least: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) with refers_to: the page whose payload is equal, or null for a response."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("n", F.length("payload"))
    top = rows.filter(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("top"), F.count("*").alias("same")).filter("same > 1").drop("same")
    met = rows.join(top, ["digest", "n"], "left")
    return met.select("page_id", "url", "payload", F.when(F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write(pages: DataFrame, folder: str, *, least: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as archives in folder, an address that pyarrow can open; gives the manifest (path, records, bytes).

    A null html is an empty payload; a null page_id is written as such and is never referred to while the
    equal pages have another. Rows that repeat the largest page_id with equal payloads are all responses.
    No rows give no archives.
    """

    def run(batches):
        path, stream, n, size = "", None, 0, 0
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[i].as_py() for c in batch.columns)  # one payload at a time
                if stream is None:
                    path, n, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    fs, name = pyarrow.fs.FileSystem.from_uri(path)
                    fs.create_dir(name.rpartition("/")[0], recursive=True)
                    stream = fs.open_output_stream(name)
                data = record_bytes(page_id, url, payload, refers_to)
                stream.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    stream.close()
                    stream = None
                    yield _manifest(path, n, size)
        if stream is not None:
            stream.close()
            yield _manifest(path, n, size)

    return materialize(with_revisits(pages, least=least).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def _manifest(path: str, records: int, size: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([records]), pa.array([size])], names=["path", "records", "bytes"])


def read(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of archives (path).

    Archives of other writers give null where a page's number isn't in the record's id; payload is null for
    revisits. A record whose framing or digest is wrong fails the job.
    """
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

    def page(uri: str | None) -> int | None:
        text = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text.lstrip("-").isdigit() else None

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                for r in read_file(path):
                    h, full = r.headers, r.headers["WARC-Type"] == "response"
                    rows.append((page(h["WARC-Record-ID"]), urllib.parse.unquote(h.get("WARC-Target-URI", "")), h["WARC-Type"], page(h.get("WARC-Refers-To")), len(r.payload) if full else int(r.http.get("content-length", 0)), h.get("WARC-Payload-Digest", "").removeprefix("sha1:"), r.payload if full else None))
                    size += len(r.block)
                    if size > BATCH_BYTES or len(rows) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    # a numbered repartition is not coalesced: a task for each archive
    paths = archives.select("path")
    return paths.repartition(max(1, paths.count())).mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/llm-archives/{uuid.uuid4().hex}"
