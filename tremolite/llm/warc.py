"""Deterministic WARC archives: records sorted by payload digest, files rolled by compressed size, committed by manifest.

The order (digest, page_id descending) brings equal payloads together, the response first, so a writer tells revisits as it goes
and each payload is shuffled once. A group of files covers a fixed range of digests. A digest that alone outweighs a part of
such a group gets groups of its own; its revisits travel without their payload. Files are written under temporary names and
renamed; only files that the manifest lists belong to the archive, so retried tasks and lost executors leave nothing behind
that a reader would see.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sinks import materialized, scratch
from .common import prepare, raw_texts, table

NAME = "op1_warc"
c, lit = F.col, F.lit
REVISIT_FROM, GROUP_BYTES, ROLL_BYTES, LEVEL = 1000, 16 << 20, 4 << 20, 6
DATE = "2024-01-01T00:00:00Z"
_HEAD = 600  # what a record weighs besides its payload
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST_DDL = "file string, records long, bytes long, sha1 string"
RECORD_DDL = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, file string"


def _b32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, digest: str, number: int) -> str:
    """The same for the same page, payload and number of its repetition."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id}|{digest}|{number}'.encode()).digest()[:16], version=5)}>"


def _one_line(url: str) -> str:
    """White space and control characters percent-encoded."""
    return "".join(x if x > " " and x not in "\x7f\x85\u2028\u2029" else "".join(f"%{b:02X}" for b in x.encode()) for x in url)


def make_record(page_id, url, payload: bytes | None, digest: str, size: int, number: int, refers_to: tuple | None) -> bytes:
    """One WARC record: a response with regenerated HTTP headers, or a revisit of `refers_to` (page_id, url)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, number)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_one_line(url)}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to[0], digest, 0)}"]
        if refers_to[0] is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to[0]}")
        if refers_to[1] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_one_line(refers_to[1])}")
    head += [f"WARC-Payload-Digest: {_b32(digest)}", f"WARC-Block-Digest: {_b32(hashlib.sha1(block).hexdigest())}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Shelf:
    """Rolls the files of one group; finished ones are renamed and listed."""

    def __init__(self, root: str, group: str, roll: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.group, self.roll, self.number, self.out, self.listed = group, roll, 0, None, []
        self.temporary = f"{self.root}/_temporary/{uuid.uuid4().hex}"
        self.fs.create_dir(self.temporary)
        self.fs.create_dir(f"{self.root}/files")

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"{self.group}-{self.number:05d}.warc.gz"
            self.out, self.size, self.records, self.sha = self.fs.open_output_stream(f"{self.temporary}/{self.name}", compression=None), 0, 0, hashlib.sha1()
        packed = zlib.compress(record, LEVEL, wbits=31)
        self.out.write(packed)
        self.sha.update(packed)
        self.size, self.records = self.size + len(packed), self.records + 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(f"{self.temporary}/{self.name}", f"{self.root}/files/{self.name}")
            self.listed.append((f"files/{self.name}", self.records, self.size, self.sha.hexdigest()))
            self.out, self.number = None, self.number + 1

    def end(self) -> list[tuple]:
        self.close()
        self.fs.delete_dir(self.temporary)
        return self.listed


def _writer(root: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = shelf = seen = None
        listed: list[tuple] = []
        for b in batches:
            cols = [b.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6, 7, 8)]
            for (grp, page, url, digest, size, hot, top_id, top_url), payload in zip(zip(*cols, strict=True), raw_texts(b.column(3)), strict=True):
                if grp != group:
                    listed += shelf.end() if shelf else []
                    group, shelf, seen, repeat, answered = grp, _Shelf(root, grp, roll), None, 0, None
                repeat = repeat + 1 if seen == (digest, page) else 0
                refers = None
                if size >= REVISIT_FROM:
                    if hot:
                        refers = None if page == top_id and repeat == 0 else (top_id, top_url)
                    elif answered and answered[0] == digest:
                        refers = answered[1:]
                    else:
                        answered = (digest, page, url)
                seen = (digest, page)
                shelf.add(make_record(page, url, payload or b"", digest, size, repeat, refers))
        listed += shelf.end() if shelf else []
        if listed:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*listed, strict=True)], names=["file", "records", "bytes", "sha1"])
    return run


def write_warc(pages: DataFrame, root: str, group_bytes: int = GROUP_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Archive `pages` (page_id, url, html) below `root`, a folder all executors share; returns the manifest (also in root/manifest).

    Of records with equal payloads of REVISIT_FROM bytes or more, the one with the largest page_id is a response (of repeated
    rows the first), the others revisit it; smaller ones are all responses. A null html is an empty payload, a null url has no
    target URI, a null page_id has no id and counts as the smallest. White space and control characters in a url are
    percent-encoded. No pages: an empty manifest. The same rows give the same files, whatever the partitions.
    """
    prepare(pages.sparkSession)
    html = F.coalesce(c("html"), lit(""))
    rows = pages.select(c("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("bigint").alias("size"))
    weight = c("size") + _HEAD
    by = rows.groupBy("digest").agg(F.sum(weight).alias("weight"), F.max(F.struct("page_id", "url")).alias("top"))
    heavy = materialized(by.where(c("weight") > group_bytes / 4).select(c("digest").alias("heavy"), "weight", c("top.page_id").alias("top_id"), c("top.url").alias("top_url")), "heavy")
    total = rows.agg(F.sum(weight)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    j = rows.join(heavy, c("digest") == c("heavy"), "left")
    base = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") / (1 << 32) * groups).cast("bigint")
    salt = F.pmod(F.xxhash64("page_id"), F.ceil(c("weight") / (group_bytes / 4)).cast("int"))
    group = F.when(c("heavy").isNull(), F.format_string("%08d", base)).otherwise(F.format_string("%08d-%s-%05d", base, c("digest"), salt))
    idle = c("heavy").isNotNull() & (c("size") >= REVISIT_FROM) & F.coalesce(c("page_id") < c("top_id"), c("top_id").isNotNull())
    j = j.select(group.alias("grp"), "page_id", "url", F.when(idle, "").otherwise(c("html")).alias("html"), "digest", "size", c("heavy").isNotNull().alias("hot"), "top_id", "top_url")
    # partitions follow the payload, not a session setting: about one group each
    sorted_ = j.repartition(min(groups, 50_000), "grp").sortWithinPartitions("grp", "digest", F.desc_nulls_last("page_id"), "url")
    sorted_.mapInArrow(_writer(root, roll_bytes), MANIFEST_DDL).write.parquet(f"{root}/manifest")
    return pages.sparkSession.read.parquet(f"{root}/manifest")


def records_of(stream: io.RawIOBase, chunk: int = 1 << 18) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an open .warc.gz, one gzip member at a time."""
    left = b""
    while True:
        member, raw = zlib.decompressobj(31), []
        while not member.eof:
            left = left or stream.read(chunk)
            if not left:
                if raw:
                    raise ValueError("the archive ends inside a record")
                return
            raw.append(member.decompress(left))
            left = member.unused_data
        data = b"".join(raw)
        head, _, rest = data.partition(b"\r\n\r\n")
        names = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield names, rest[:int(names["Content-Length"])]


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for head, block in records_of(stream):
                        if _b32(hashlib.sha1(block).hexdigest()) != head["WARC-Block-Digest"]:
                            raise ValueError(f"block digest differs in {name}, {head['WARC-Record-ID']}")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = base64.b32decode(head["WARC-Payload-Digest"][5:]).hex(), head["WARC-Type"]
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload digest differs in {name}, {head['WARC-Record-ID']}")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        ids = [int(head[x]) if x in head else None for x in ("X-Page-Id", "X-Refers-To-Page-Id")]
                        rows.append((ids[0], head.get("WARC-Target-URI"), size, digest, kind, ids[1], head["WARC-Record-ID"], name))
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in RECORD_DDL.split(", ")])
    return run


def read_warc(spark: SparkSession, root: str) -> DataFrame:
    """The records of all files that the manifest lists, digests checked."""
    files = spark.read.parquet(f"{root}/manifest").select("file")
    # a stated number of tasks: the list of names is small, what is behind it is not
    return files.repartition(max(1, min(files.count(), 20_000))).mapInArrow(_reader(root), RECORD_DDL)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, root = table(spark, sf_dir, "pages"), scratch(spark, "warc")
    write_warc(pages.select("page_id", "url", "html"), root)
    return read_warc(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM q
"""
