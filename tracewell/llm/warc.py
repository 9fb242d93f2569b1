"""WARC archives as a Spark data source (``warc``), and an archive of pages in which equal payloads are kept once.

Reading plans tasks from whole files, pushes predicates on the record type and on headers down, parses a record's headers
first, and skips the block of a record that is not wanted, or whose payload no column asks for, without decoding it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ._util import release, shared_dir

#: Bytes of archives that one reading task takes together, of a file before the next is begun, and of payloads in a batch.
SPLIT_BYTES, FILE_BYTES, BATCH_BYTES = 64 << 20, 256 << 20, 4 << 20

# Columns by header, and what the format asks for.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to", "content_type": "content-type"}
SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_type string, headers map<string,string>, payload binary"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path within it, of a URI or a local path."""
    path = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def gzip_member(record: bytes, level: int) -> bytes:
    """The record as a gzip member of its own, whose extra field ``sl`` tells how long it is: a reader can leap over it."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    extra = struct.pack("<2sHII", b"sl", 8, 24 + len(body) + 8, len(record)) if max(len(body), len(record)) < 1 << 31 else b""
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff" + struct.pack("<H", len(extra))
    return head + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class Inflated:
    """The bytes of one gzip member, inflated as far as they are read."""

    def __init__(self, file):
        self.file, self.zip, self.left = file, zlib.decompressobj(31), b""
        self.begin, head = file.tell(), file.read(24)
        self.size = struct.unpack_from("<I", head, 16)[0] if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl" else None
        self.left = self.zip.decompress(head)

    def more(self) -> bool:
        """Inflate some more; False at the end of the member."""
        while not self.zip.eof:
            block = self.zip.unconsumed_tail or self.file.read(1 << 14)
            if not block:
                raise ValueError("an archive ends within a record")
            if found := self.zip.decompress(block, 1 << 16):
                self.left += found
                return True
        return False

    def take(self, n: int) -> bytes:
        parts = [self.left]
        got = len(self.left)
        self.left = b""
        while got < n and self.more():
            parts.append(self.left)
            got += len(self.left)
            self.left = b""
        whole = b"".join(parts)
        self.left = whole[n:]
        return whole[:n]

    def close(self) -> None:
        """Go on to the next member: by the length that the extra field tells, or by inflating what is left."""
        if self.size is not None:
            self.file.seek(self.begin + self.size)
            return
        while True:
            self.left = b""
            if not self.more():
                break
        self.file.seek(-len(self.zip.unused_data), io.SEEK_CUR)


class Plain:
    """The records of an archive that is not compressed."""

    def __init__(self, file):
        self.file, self.left, self.end = file, b"", None

    def more(self) -> bool:
        found = self.file.read(1 << 14)
        self.left += found
        return bool(found)

    def take(self, n: int) -> bytes:
        out, self.left = self.left[:n], self.left[n:]
        return out + self.file.read(n - len(out)) if len(out) < n else out

    def close(self) -> None:
        self.file.seek(self.end)


def head_of(part: Inflated | Plain) -> dict[str, str] | None:
    """The headers of the record that begins here, by lower-case name; None at the end."""
    while (at := part.left.find(b"\r\n\r\n")) < 0:
        if not part.more():
            if part.left.strip():
                raise ValueError("an archive ends within the headers of a record")
            return None
    raw, part.left = part.left[:at].lstrip(), part.left[at + 4 :]
    lines = re.sub(rb"\r\n[ \t]+", b" ", raw).split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError(f"no record begins where one should: {lines[0][:40]!r}")
    pairs = (line.decode("utf-8", "replace").partition(":") for line in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def http_payload(block: bytes) -> bytes:
    """What an HTTP message carries, its transfer and content encodings undone."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") == b"chunked":
        parts, rest = [], body
        while rest:
            size, _, rest = rest.partition(b"\r\n")
            n = int(size.split(b";")[0] or b"0", 16)
            if not n:
                break
            parts.append(rest[:n])
            rest = rest[n + 2 :]
        body = b"".join(parts)
    coding = fields.get(b"content-encoding", b"identity")
    if coding in (b"gzip", b"x-gzip", b"deflate"):
        body = zlib.decompressobj(47).decompress(body)
    return body


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, split_bytes: int):
        self.path, self.schema, self.split_bytes, self.wanted = path, schema, split_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality, membership, prefixes and presence of the record type and other headers are decided here, the rest by Spark."""
        for f in filters:
            name = getattr(f, "attribute", ())
            if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) and len(name) == 1 and name[0] not in ("headers", "payload"):
                values = list(f.value) if isinstance(f, In) else [getattr(f, "value", None)]
                self.wanted.append((header_name(name[0]), type(f).__name__, values))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Whole files: small ones together up to ``split_bytes``, a larger one by itself."""
        files, path = filesystem(self.path)
        found = sorted((x.path, x.size) for x in files.get_file_info(pafs.FileSelector(path, recursive=True)) if x.is_file and re.search(r"\.warc(\.gz)?$", x.path))
        bins: list[tuple[list[str], int]] = []
        for name, size in found:
            if bins and bins[-1][1] + size <= self.split_bytes:
                bins[-1] = ([*bins[-1][0], name], bins[-1][1] + size)
            else:
                bins.append(([name], size))
        return [Files(paths) for paths, _ in bins] or [Files([])]

    def _fits(self, head: dict[str, str]) -> bool:
        for name, how, values in self.wanted:
            v = head.get(name)
            if v is None or how in ("EqualTo", "In") and v not in values or how == "StringStartsWith" and not v.startswith(values[0]):
                return False
        return True

    def _records(self, name: str) -> Iterator[tuple[dict[str, str], bytes | None]]:
        """(headers, payload) of the records that are wanted."""
        files, _ = filesystem(self.path)
        ask = "payload" in self.schema.names
        with io.BufferedReader(files.open_input_file(name), 1 << 16) as file:
            zipped = file.peek(2)[:2] == b"\x1f\x8b"
            while file.peek(1):
                part = Inflated(file) if zipped else Plain(file)
                head = head_of(part)
                if head is None:
                    return
                length = int(head.get("content-length", 0))
                if not zipped:
                    part.end = file.tell() - len(part.left) + length + 4
                if self._fits(head):
                    yield head, self._payload(head, part.take(length)) if ask and head.get("warc-type") != "revisit" else None
                part.close()

    def _payload(self, head: dict[str, str], block: bytes) -> bytes:
        payload = http_payload(block) if head.get("content-type", "").startswith("application/http") else block
        told = head.get("warc-payload-digest", "")
        if told.startswith("sha1:") and "warc-truncated" not in head and told[5:] != base32_sha1(hashlib.sha1(payload).digest()):
            raise ValueError(f"the payload of {head.get('warc-record-id')} does not have the digest that its header tells")
        return payload

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)
        for name in partition.paths:
            rows: list[list] = []
            size = 0
            for head, payload in self._records(name):
                rows.append([payload if c == "payload" else list(head.items()) if c == "headers" else head.get(header_name(c)) for c in self.schema.names])
                size += 1000 + len(payload or b"")
                if size > BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def header_name(column: str) -> str:
    return HEADER_OF.get(column, column.replace("_", "-").lower())


def _value(text) -> str:
    """A header's value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", str(text))


def record(row: dict) -> bytes:
    """One response or revisit record; a revisit names the payload by its digest and length, and doesn't hold it."""
    revisit = row["record_type"] == "revisit"
    payload = row.get("payload") or b""
    digest = row.get("payload_sha1") or hashlib.sha1(payload).digest()
    length = row["payload_length"] if row.get("payload_length") is not None else len(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + (b"" if revisit else payload)
    head = {"WARC-Type": row["record_type"], "WARC-Record-ID": row["record_id"], "WARC-Date": row.get("date") or "1970-01-01T00:00:00Z", "WARC-Target-URI": row.get("target_uri"), "WARC-Payload-Digest": "sha1:" + base32_sha1(digest), "X-Payload-Length": length}
    if revisit:
        head |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": row["refers_to"]}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v if k == 'Content-Type' else _value(v)}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Files of up to ``file_bytes`` under names that readers pass over, which the commit of the job makes theirs: attempts that
    fail leave nothing that is read."""

    def __init__(self, path: str, level: int, file_bytes: int):
        self.path, self.level, self.file_bytes, self.job = path, level, file_bytes, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, base = filesystem(self.path)
        files.create_dir(base, recursive=True)
        paths: list[str] = []
        out, size = None, 0
        for batch in iterator:
            for i in range(batch.num_rows):  # one row at a time as Python objects
                if out is None:
                    paths.append(f"{base}/part-{self.job}-{uuid.uuid4().hex}.warc.gz")
                    out, size = files.open_output_stream(paths[-1] + ".tmp"), 0
                    info = b"software: tracewell\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    out.write(gzip_member(head.encode() + info + b"\r\n\r\n", self.level))
                member = gzip_member(record(batch.slice(i, 1).to_pylist()[0]), self.level)
                out.write(member)
                size += len(member)
                if size >= self.file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(paths)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = filesystem(self.path)
        files.create_dir(base, recursive=True)
        for m in messages:
            for path in m.paths if m else ():
                files.move(path + ".tmp", path)
        self.abort([])

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, base = filesystem(self.path)
        for x in files.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if x.base_name.startswith(f"part-{self.job}-") and x.base_name.endswith(".tmp"):
                files.delete_file(x.path)


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``: records of all archives under a folder, ``.warc`` or ``.warc.gz``.

    The columns of SCHEMA, or those of a schema of your own: any other string column is the header of its name, with ``-``
    for ``_``. Options: path, split_bytes; for writing level and file_bytes, too. A missing header is null. Rows to write have
    record_id, record_type (response or revisit), payload, and may have target_uri, date, refers_to, and payload_sha1 and
    payload_length, which a revisit needs in place of its payload.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("split_bytes", SPLIT_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], int(self.options.get("level", 6)), int(self.options.get("file_bytes", FILE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def plan_records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", parts: int = 1000) -> DataFrame:
    """The records that archive ``pages``: of equal payloads of ``min_bytes`` or more the smallest id's is a response, the
    others are revisits of it.

    Digests are counted first, with a combining step in each task. A digest that holds over 1/``parts`` of the rows is split
    into as many groups as its share asks for; there are fewer than ``parts`` of those, so their list is broadcast, and the
    join moves each page once, to groups of bounded size. Null html counts as empty; rows without an id are responses, and so
    are repeated rows of the id that stays.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    equal = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    total = max(1, pages.count())
    winners = equal.withColumn("salts", F.ceil(F.col("n") * parts / total).cast("int"))
    hot = winners.filter("salts > 1").select("sha", "salts")
    dealt = winners.select("sha", "keep", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = rows.join(F.broadcast(hot), "sha", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id", "url"), F.col("salts")), F.lit(0)).cast("int"))
    met = salted.join(dealt, ["sha", "salt"], "left")
    revisit = F.coalesce(F.col("keep") != F.col("page_id"), F.lit(False))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return met.select(name("page_id").alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"), F.when(~revisit, F.col("payload")).alias("payload"), F.col("sha").alias("payload_sha1"), F.octet_length("payload").cast("long").alias("payload_length"), F.when(revisit, name("keep")).alias("refers_to"))


def archive(pages: DataFrame, path: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ``pages`` to WARC files in the folder ``path``, which driver and executors share; see ``plan_records``. Control
    characters and spaces in addresses are percent-encoded; other columns are not archived; an empty table gives no file."""
    register(pages.sparkSession)
    plan_records(pages, min_bytes, id_col, url_col, html_col).write.format("warc").mode("append").save(path)
    release(pages.sparkSession)


def read_archive(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """The records of a folder; payloads are decoded only if ``schema`` has them, and then held against their digests."""
    register(spark)
    return spark.read.format("warc").schema(schema).load(path)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the pages in an archive made by ``archive``."""
    page = lambda c: F.substr(F.col(c), F.lit(len("urn:page:") + 1)).try_cast("long")
    found = read_archive(spark, path, "record_id string, record_type string, payload_digest string, refers_to string, x_payload_length string, payload binary").filter(F.col("record_type").isin("response", "revisit"))
    size = F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(F.col("x_payload_length").cast("long")).cast("long")
    return found.select(page("record_id").alias("page_id"), size.alias("payload_bytes"), F.substr(F.col("payload_digest"), F.lit(6)).alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"))


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Archive ``pages`` in the shared folder and read the archive back; see ``archive`` and ``page_records``."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    archive(pages, path, min_bytes)
    return page_records(pages.sparkSession, path)
