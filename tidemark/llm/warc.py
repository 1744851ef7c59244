"""WARC archives as a PySpark data source: writing, and reading by file partitions.

``warc`` writes one gzip member per record, with the lengths of the member in a gzip extra field,
so that a reader inflates a record's headers first and jumps over the rest when nothing asks for
it. Members without that field, and plain .warc files, are read too. The driver of a write lists
the files of successful tasks in a manifest of its own; a reader takes those of all, or all *.warc and *.warc.gz
files of a folder without manifest, one partition each.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.llm.common import FEW_KEYS, hot_join, shared_dir, small_batches, staged, table

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_length long, payload_bytes long, headers map<string,string>, payload binary"
MANIFEST = "_warc_manifest"  # one file for each write
#: The columns that are a header's text; filters on them are decided before a block is inflated.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIRST = 4096  # compressed bytes from which headers are inflated; more when they are longer
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_block(first: str, headers: list[tuple[str, str | None]]) -> bytes:
    return "\r\n".join([first, *(f"{k}: {v}" for k, v in headers if v is not None), "", ""]).encode()


def clean_uri(uri: str | None) -> str | None:
    """As a header can hold it: blanks, controls and non-ASCII percent-encoded; null: no header."""
    return None if uri is None else quote(uri, safe="%:/?#[]@!$&'()*+,;=-._~")


def record_bytes(record_id: str, uri: str | None, payload: bytes | None, n_bytes: int, digest: str, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or, for payload None, the revisit of ``refers_to`` with the HTTP headers alone."""
    http = header_block("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=UTF-8"), ("Content-Length", str(n_bytes))])
    block = http + (payload or b"")
    head = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", clean_uri(uri)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if payload is None:
        head += [("WARC-Refers-To", refers_to), ("WARC-Profile", REVISIT_PROFILE), ("WARC-Truncated", "length")]
    return header_block("WARC/1.1", [*head, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member whose extra field 'sl' holds the lengths of the member and of its content."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_id, target_uri, payload, payload_bytes, payload_digest, refers_to); payload null: a revisit."""

    def __init__(self, options: dict[str, str]):
        self.path, self.level = options["path"], int(options.get("level", "4"))
        self.date, self.roll = options.get("date", "1970-01-01T00:00:00Z"), int(options.get("roll", str(1 << 30)))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        names, out, size = [], None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                data = gzip_member(record_bytes(r["record_id"], r["target_uri"], r["payload"], r["payload_bytes"], r["payload_digest"], r["refers_to"], self.date), self.level)
                if out is None or size > self.roll:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = store.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Files(names)

    def commit(self, messages: list[Files | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list[Files | None]) -> None:
        store, root = pafs.FileSystem.from_uri(self.path)
        for name in (n for m in messages if m for n in m.names):
            store.delete_file(f"{root}/{name}")


@dataclass
class OneFile(InputPartition):
    name: str


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes | None  # None: skipped


class Source:
    """A seekable file behind a buffer of its next bytes."""

    def __init__(self, file):
        self.file, self.held = file, b""

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := self.file.read(max(n - len(self.held), 1 << 20))):
            self.held += more
        return self.held[:n]

    def take(self, n: int) -> bytes:
        data, self.held = self.peek(n), self.held[n:]
        return data

    def skip(self, n: int) -> None:
        if n > len(self.held):
            self.file.seek(n - len(self.held), io.SEEK_CUR)
        self.held = self.held[n:]


def parsed(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith(("WARC/", "HTTP/")):
        raise ValueError(f"no record starts here: {first[:40]!r}")
    found = {}
    for line in lines:
        k, colon, v = line.partition(":")
        if colon:
            found.setdefault(k.strip().lower(), v.strip())
    return found


def plain_records(src: Source, wanted) -> Iterator[Record]:
    while src.peek(1):
        n = FIRST
        while (end := (seen := src.peek(n)).find(b"\r\n\r\n")) < 0:
            if len(seen) < n:
                raise ValueError("a record's headers do not end")
            n *= 2
        headers = parsed(src.take(end + 4)[:end])
        length = int(headers.get("content-length", "0"))
        if wanted(headers):
            yield Record(headers, src.take(length))
        else:
            src.skip(length)
            yield Record(headers, None)
        src.take(4)


def gzip_records(src: Source, wanted) -> Iterator[Record]:
    while head := src.peek(24):
        flags = head[3]
        member = struct.unpack("<I", head[16:20])[0] if flags == 4 and head[12:14] == b"sl" else None
        z, raw, n, fed = zlib.decompressobj(31), b"", FIRST, 0
        while (end := raw.find(b"\r\n\r\n")) < 0:
            piece = src.peek(min(n, member) if member else n)[fed:]
            if not piece or z.eof:
                raise ValueError("a record's headers do not end")
            raw, fed, n = raw + z.decompress(piece), fed + len(piece), n * 2
        headers = parsed(raw[:end])
        keep = wanted(headers)
        if member and not keep:
            src.skip(member)
            yield Record(headers, None)
            continue
        parts = [raw]
        src.skip(fed)
        while not z.eof:
            piece = src.take(1 << 16)
            if not piece:
                raise ValueError("a gzip member does not end")
            got = z.decompress(piece)
            if keep:
                parts.append(got)
        src.held = z.unused_data + src.held
        length = int(headers.get("content-length", "0"))
        yield Record(headers, b"".join(parts)[end + 4 : end + 4 + length] if keep else None)


class WarcReader(DataSourceReader):
    """Options: path; verify (true: inflate every response and hold its payload against digest and length)."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.verify, self.tests = schema, options["path"], options.get("verify", "false").lower() == "true", []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADER_OF and isinstance(f, EqualTo):
                self.tests.append((HEADER_OF[name], {f.value}))
            elif name in HEADER_OF and isinstance(f, In):
                self.tests.append((HEADER_OF[name], set(f.value)))
            elif name in HEADER_OF and isinstance(f, IsNotNull):
                self.tests.append((HEADER_OF[name], None))
            else:
                yield f

    def partitions(self) -> list[OneFile]:
        store, root = pafs.FileSystem.from_uri(self.path)
        if store.get_file_info(root).type == pafs.FileType.File:
            return [OneFile(root)]
        found = store.get_file_info(pafs.FileSelector(root, recursive=True))
        names = []
        for x in (x for x in found if x.base_name.startswith(MANIFEST)):
            with store.open_input_stream(x.path) as f:
                names += [f"{root}/{n}" for n in json.loads(f.read())]
        if names or any(x.base_name.startswith(MANIFEST) for x in found):
            return [OneFile(n) for n in sorted(names)]
        return [OneFile(x.path) for x in found if x.path.endswith((".warc", ".warc.gz"))]

    def passes(self, headers: dict[str, str]) -> bool:
        for name, values in self.tests:
            v = headers.get(name)
            if name == "warc-payload-digest" and v:
                v = v.removeprefix("sha1:")
            if v is None or values is not None and v not in values:
                return False
        return True

    def read(self, partition: OneFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file, no partition
            return
        store, _ = pafs.FileSystem.from_uri(self.path)
        asked = set(self.schema.names)
        inside = bool(asked & {"payload", "payload_bytes"})
        whole = "payload" in asked or self.verify

        def wanted(h):
            # of a revisit the block is short: HTTP headers with the length of the payload it refers to
            return self.passes(h) and (whole or inside)

        types, rows, size = to_arrow_schema(self.schema), [], 0
        with store.open_input_file(partition.name) as file:
            src = Source(file)
            for rec in (gzip_records if src.peek(2) == b"\x1f\x8b" else plain_records)(src, wanted):
                if not self.passes(rec.headers):
                    continue
                rows.append(self.row(rec, asked))
                size += len(rec.block or b"") if "payload" in asked else 0
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    def row(self, rec: Record, asked: set[str]) -> dict:
        h, payload, n_bytes = rec.headers, None, None
        if rec.block is not None:
            payload, n_bytes = rec.block, len(rec.block)
            if h.get("content-type", "").startswith("application/http"):
                end = rec.block.find(b"\r\n\r\n")
                http = parsed(rec.block[:end]) if end >= 0 else {}
                payload = rec.block[end + 4 :] if end >= 0 else rec.block
                n_bytes = int(http.get("content-length", len(payload))) if h.get("warc-type") == "revisit" else len(payload)
            if self.verify and h.get("warc-type") == "response" and h.get("warc-payload-digest", "").startswith("sha1:") and h["warc-payload-digest"][5:] != base32_sha1(payload):
                raise ValueError(f"payload of {h.get('warc-record-id')} does not have its digest")
        values = {c: h.get(k) for c, k in HEADER_OF.items()}
        if values["payload_digest"]:
            values["payload_digest"] = values["payload_digest"].removeprefix("sha1:")
        values |= {"content_length": int(h.get("content-length", "0")), "payload_bytes": n_bytes, "headers": list(h.items()), "payload": None if h.get("warc-type") == "revisit" else payload}
        return {c: values[c] for c in self.schema.names}


class WarcSource(DataSource):
    """``spark.read.format("warc")`` and ``df.write.format("warc")``; a narrower schema reads less."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def base32_of_hex(digest):
    """Column: upper-case base32 of 40 hex digits, five of them to four letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    five = lambda i: F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 10).cast("int")
    letter = lambda v, s: F.substring(F.lit(letters), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, 1)
    return F.concat(*[letter(five(i), s) for i in range(8) for s in (15, 10, 5, 0)])


def archive(pages: DataFrame, path: str, least: int = 0, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> None:
    """Write a record per row of ``pages`` to WARC files at ``path``.

    Of equal payloads of at least ``least`` bytes the row with the largest id is the response and
    the others are revisits of it; shorter payloads are all responses. Null payloads are empty
    ones, null URIs are left out, null ids lose against any other. Rows that repeat an id with
    ones, null URIs are left out, null ids lose against any other. Rows that repeat an id with
    its payload are alike; of ties none is a revisit of itself. Payloads are equal when their
    SHA-256 and lengths are. Only payloads that recur meet the table again: few of them are
    broadcast, more are joined with hot ones dealt over several tasks. An empty table gives an
    archive without files.
    """
    body = F.coalesce(pages[payload_col], F.lit("")).cast("binary")
    rows = pages.select(pages[id_col].alias("id"), pages[uri_col].alias("target_uri"), body.alias("body")).withColumns({"digest": F.sha1("body"), "payload_bytes": F.octet_length("body").cast("long")})
    rows = rows.withColumn("key", F.concat(F.sha2("body", 256), F.col("payload_bytes").cast("string")))
    many = rows.where(F.col("payload_bytes") >= least).groupBy("key").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    many = staged(many, "payloads").withColumn("met", F.lit(True))
    both = rows.join(F.broadcast(many.drop("n")), "key", "left") if many.count() <= FEW_KEYS // 8 else hot_join(rows, many, "key", "left")
    urn = lambda c: F.format_string("<urn:record:%s>", F.coalesce(F.col(c).cast("string"), F.lit("null")))
    revisit = F.col("met").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    out = both.select(
        urn("id").alias("record_id"), "target_uri", F.when(~revisit, F.col("body")).alias("payload"), "payload_bytes", base32_of_hex(F.col("digest")).alias("payload_digest"), F.when(revisit, urn("first")).alias("refers_to")
    )
    register(pages.sparkSession)
    small_batches(pages.sparkSession)
    out.write.format("warc").mode("append").option("path", path).save()


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    path = shared_dir(spark, "warc")
    archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = spark.read.format("warc").schema("record_id string, record_type string, payload_digest string, refers_to string, payload_bytes long").option("path", path).option("verify", "true").load()
    number = lambda c: F.nullif(F.regexp_extract(c, "^<urn:record:(-?[0-9]*)", 1), F.lit("")).cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


_FIVE = "('0x' || substr(h, 1 + 5 * i, 5))::INT"
_LETTERS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_FIVE} >> {s}) & 31) + 1, 1)" for s in (15, 10, 5, 0))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, max(page_id) AS first_id FROM p GROUP BY h)
SELECT p.page_id, p.payload_bytes, list_aggregate(list_transform(range(8), lambda i: {_LETTERS.replace('(h,', '(p.h,')}), 'string_agg', '') AS payload_digest,
  CASE WHEN p.page_id IS NOT DISTINCT FROM f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
FROM p JOIN f ON p.h = f.h
"""
