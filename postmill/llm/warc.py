"""WARC archives as a Python data source: written per task, committed by a manifest, read back by header.

Records are gzip members of their own, as usual for ``.warc.gz``. A reader plans one partition per
group of files, parses each record's header first, checks it against the pushed-down predicates, and
seeks past blocks that are not wanted. The writer notes each member's length in its gzip header (extra field ``sl``), so
no more than the first kilobyte or so of an unwanted record is inflated; members of other writers without that
field are inflated and dropped. Files go through Arrow's file systems (local, HDFS, S3, GCS), never through open();
a file that no manifest names (a lost or repeated attempt) is not part of the archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from postmill.llm.words import utf8

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
# Columns that are WARC headers, and the column type where it is not text.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
    "page_id": "X-Page-ID", "refers_to_page": "X-Refers-To-Page", "full_bytes": "X-Payload-Bytes",
}
READ_SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", content_length long, intact boolean, payload binary"
WRITE_SCHEMA = "page_id string, url string, payload binary, refers_to string"
ROLL_BYTES = 256 << 20  # a task begins a new file beyond that
GROUP_BYTES = 64 << 20  # files read by one partition
CHUNK = 1 << 20
STEP = 1 << 14  # packed bytes inflated at a time
HEAD_STEP = 1 << 10  # bytes inflated at a time while a header is sought
LEVEL = 4
# Gzip header with one extra field: kind, time and system, length of the field, its name and size, then both lengths.
SKIP = "<4s6sH2sHII"
SKIP_BYTES = struct.calcsize(SKIP)
GZIP_EXTRA = b"\x1f\x8b\x08\x04"
SAFE = str.maketrans({"\r": "%0D", "\n": "%0A"})


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str) -> str:
    return f"<urn:x-page:{page_id.translate(SAFE)}>"


def record(page_id: str | None, url: str | None, payload: bytes, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """One record; a revisit names the record it repeats and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", date), ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)), ("X-Payload-Bytes", str(len(payload)))]
    lines.append(("WARC-Record-ID", record_id(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"))
    if page_id is not None:
        lines.append(("X-Page-ID", page_id.translate(SAFE)))
    if url is not None:
        lines.append(("WARC-Target-URI", url.translate(SAFE)))
    if revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page", refers_to)]
    lines += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + END


def member(data: bytes) -> bytes:
    """One gzip member around ``data``; its extra field ``sl`` holds the lengths of the member and of the data.

    Binary values of Spark end at 2 GB, so both lengths fit their four bytes.
    """
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    skip = struct.pack(SKIP, GZIP_EXTRA, b"\0\0\0\0\0\xff", 12, b"sl", 8, SKIP_BYTES + len(body) + 8, len(data))
    return skip + body + struct.pack("<II", zlib.crc32(data), len(data))


class Members:
    """Bytes of a ``.warc`` or ``.warc.gz`` stream, read on demand; gzip members follow each other.

    ``inflated`` counts the bytes that came out of gzip members. A member whose header says how long it is
    is left by a seek as soon as nothing more of it is wanted; others are inflated to their end.
    """

    def __init__(self, stream, packed: bool):
        self.stream, self.packed, self.buffer, self.inflated = stream, packed, b"", 0
        self.raw, self.at = b"", 0  # packed bytes read, and how many of them are used
        self.inflate, self.ends, self.left = None, None, 0  # open member, its end in the file, its bytes to come

    def ready(self, n: int) -> bool:
        """At least n packed bytes are at hand."""
        while len(self.raw) - self.at < n:
            got = self.stream.read(CHUNK)
            if not got:
                return False
            self.raw, self.at = self.raw[self.at:] + got, 0
        return True

    def open_member(self) -> None:
        self.inflate, self.ends = zlib.decompressobj(31), None
        if self.ready(SKIP_BYTES):
            kind, _, _, name, size, length, plain = struct.unpack_from(SKIP, self.raw, self.at)
            if kind == GZIP_EXTRA and name == b"sl" and size == 8:
                self.ends = self.stream.tell() - (len(self.raw) - self.at) + length
                self.left = plain

    def more(self, most: int = CHUNK) -> bool:
        """Add to the buffer, at most ``most`` bytes of a packed file; False at the end."""
        if not self.packed:
            got = self.stream.read(CHUNK)
            self.buffer += got
            return bool(got)
        while True:
            if not self.ready(1):
                return False
            if self.inflate is None:
                self.open_member()
            fed = self.raw[self.at:self.at + STEP]
            got = self.inflate.decompress(fed, most)
            # At the end of a member both hold the rest.
            self.at += len(fed) - len(self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail)
            self.inflated += len(got)
            self.left -= len(got)
            if self.inflate.eof:
                self.inflate = None
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes before ``mark``, which is passed over; None at the end."""
        at = self.buffer.find(mark)
        while at < 0:
            seen = max(0, len(self.buffer) - len(mark) + 1)
            if not self.more(HEAD_STEP):
                return None
            at = self.buffer.find(mark, seen)
        out, self.buffer = self.buffer[:at], self.buffer[at + len(mark):]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.buffer], len(self.buffer)
        self.buffer = b""
        while have < n and self.more():
            parts.append(self.buffer)
            have += len(self.buffer)
            self.buffer = b""
        whole = b"".join(parts)
        if have < n:
            raise ValueError("a record ends before its Content-Length")
        self.buffer = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        """Pass over n bytes: by a seek in plain files and where they reach the end of a member of known length."""
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = b""
            if not self.packed:
                self.stream.seek(self.stream.tell() + n)
                return
            if self.inflate is not None and self.ends is not None and n >= self.left:
                n -= self.left
                self.leave()
            elif not self.more(min(n, CHUNK)):
                raise ValueError("a record ends before its Content-Length")
        self.buffer = self.buffer[n:]

    def leave(self) -> None:
        """Go to the end of the open member."""
        ahead = self.ends - (self.stream.tell() - (len(self.raw) - self.at))
        if ahead <= len(self.raw) - self.at:
            self.at += ahead
        else:
            self.stream.seek(self.ends)
            self.raw, self.at = b"", 0
        self.inflate = None


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership, prefix and presence of header columns are checked before the block is read."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo):
                self.wanted.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.wanted.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.wanted.append((column, "prefix", f.value))
            elif column in HEADERS and isinstance(f, IsNotNull):
                self.wanted.append((column, "known", None))
            else:
                yield f

    def partitions(self) -> list[Files]:
        system, root = pafs.FileSystem.from_uri(self.path)
        files: list[tuple[str, int]] = []
        for info in system.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith("manifest-"):
                with system.open_input_stream(info.path) as s:
                    files += [tuple(x) for x in json.loads(s.read())]
        groups, size = [[]], 0
        for name, n in sorted(files):
            if groups[-1] and size + n > GROUP_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(name)
            size += n
        return [Files(g) for g in groups]

    def _passes(self, values: dict[str, str | None]) -> bool:
        for column, how, what in self.wanted:
            v = values[column]
            if v is None or how == "in" and v not in what or how == "prefix" and not v.startswith(what):
                return False
        return True

    def read(self, partition: Files) -> Iterator[tuple]:
        system, root = pafs.FileSystem.from_uri(self.path)
        for name in partition.paths:
            with system.open_input_file(f"{root}/{name}") as stream:
                data = Members(stream, name.endswith(".gz"))
                while (head := data.until(END)) is not None:
                    headers = _parse(head)
                    values = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
                    if values["payload_digest"]:
                        values["payload_digest"] = values["payload_digest"].removeprefix("sha1:")
                    length = int(headers["content-length"])
                    if not self._passes(values):
                        data.skip(length + len(END))
                        continue
                    payload, intact = None, None
                    if (self.payload or self.verify) and values["record_type"] == "response":
                        payload = data.take(length).partition(END)[2]
                        intact = payload_digest(payload) == values["payload_digest"] if self.verify else None
                        data.skip(len(END))
                    else:
                        data.skip(length + len(END))
                    yield (*values.values(), length, intact, payload if self.payload else None)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = pafs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        files, out, size, name = [], None, 0, ""
        for batch in iterator:
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size = system.open_output_stream(f"{root}/{name}", compression=None), 0
                packed = member(record(page_id, url, payload or b"", refers_to, refers_to is not None, self.date))
                out.write(packed)
                size += len(packed)
                if size >= ROLL_BYTES:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = pafs.FileSystem.from_uri(self.path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/manifest-{uuid.uuid4().hex}.json") as s:
            s.write(json.dumps([f for m in messages if m for f in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            for name, _ in m.files if m else []:
                system.delete_file(f"{root}/{name}")


class WarcSource(DataSource):
    """``format("warc")``. Options when reading: payload (true/false), verify (true/false); when writing: date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def with_uri(folder: str) -> str:
    return folder if "://" in folder else "file://" + folder.removeprefix("file:")


def revisits(pages: DataFrame, least_bytes: int, page_id: str, html: str) -> DataFrame:
    """Records that repeat a payload: (page_id, digest, refers_to). Ids and digests only are exchanged."""
    body = utf8(F.col(html))
    narrow = pages.select(F.col(page_id).alias("page_id"), F.sha1(body).alias("digest"), F.octet_length(body).alias("n")).filter(F.col("n") >= least_bytes)
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("records")).filter("records > 1").drop("records")
    return narrow.join(first, "digest").filter("refers_to IS NOT NULL AND NOT page_id <=> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_warc(
    pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", html: str = "html"
) -> None:
    """Archive pages under ``path``: one record per row.

    Of rows with equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is the
    response and the others revisit it; rows that repeat its id as well are responses too. A null html is
    an empty payload; a null id is larger than all others (and if a group has no other, all its rows are
    responses); a null url leaves the header out. Other columns are ignored.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    body = utf8(F.col(html))
    again = revisits(pages, least_bytes, page_id, html)
    again = again.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("refers_to").cast("string").alias("_refers"))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body).alias("digest"))
    (
        rows.join(again, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
        .select(F.col("page_id").cast("string"), F.col("url").cast("string"), "payload", F.col("_refers").alias("refers_to"))
        .write.format("warc").mode("append").option("date", date).save(with_uri(path))
    )


def read_warc(spark: SparkSession, path: str, payload: bool = True, verify: bool = False) -> DataFrame:
    """Records under ``path``; filters on header columns are pushed into the scan.

    ``payload`` false leaves blocks out, unread beyond their beginning; ``verify`` compares payloads with their digests (column
    intact). A path without archives gives no rows.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(payload=str(payload).lower(), verify=str(verify).lower()).load(with_uri(path))


def round_trip(pages: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back: what each record says of its page."""
    kind = pages.schema["page_id"].dataType
    write_warc(pages, path, least_bytes)
    return read_warc(pages.sparkSession, path, payload=False, verify=True).select(
        F.col("page_id").cast(kind).alias("page_id"), F.col("full_bytes").cast("bigint").alias("payload_bytes"), "payload_digest", "record_type",
        F.col("refers_to_page").cast(kind).alias("refers_to"), "intact",
    )


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, CASE WHEN page_id = first THEN true END AS intact
FROM p JOIN f USING (h)
"""
