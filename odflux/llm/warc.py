"""WARC archives as a Python data source: ``spark.read.format("warc")`` and ``df.write.format("warc")``.

Records are written one gzip member each, as archives usually are, and every member names its own
compressed size in an extra field of its gzip header, which other readers skip. A reader inflates
a member only up to the end of the record's headers, judges it by the pushed filters, and goes on
to the next member by its size, so an unwanted payload is neither inflated nor decoded. Members of
other writers, which have no such field, are inflated to their end and thrown away; archives that
are not compressed are passed over by Content-Length.

Reading. One partition holds whole files, small ones together up to ``partitionBytes``. Equality,
membership, comparison with null and prefixes on ``record_type``, ``record_id``, ``target_uri``,
``date``, ``refers_to``, ``payload_digest`` and ``content_length`` are pushed down. A schema without
``payload`` reads headers only. Use ``scan``, or one ``load`` per filter (see there).

Writing. A task writes files of about ``fileBytes`` under names that only the commit makes
visible, so a task that is lost or runs twice leaves nothing that is read. Files go through the
file system of their URI, in a folder that all executors share.

``write_pages`` writes a response record per page and, for a payload that another page of a
smaller id has, a revisit record, which holds the HTTP head alone and names the response.

Defined results: a null payload is an empty one. Pages are told apart by id and a running number,
so of equal pages one is the response. A page without an id comes after others and is named by its
number only. Short payloads are never revisits. Null urls have no Target-URI. An empty table
writes no file, and an empty folder reads as no records. Other columns are not read. A record that
is cut off or does not begin with a version line is an error.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

from odflux.llm.common import row_bytes, scratch_path, table
from odflux.llm.registry import query

SCHEMA = (
    "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, "
    "content_length long, headers map<string,string>, http_headers map<string,string>, payload binary"
)
FIELDS = {  # columns that are one header each
    "record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_length": "content-length",
}
DATE = "2000-01-01T00:00:00Z"  # of records without one; a fixed date keeps files repeatable
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 100  # bytes of a payload that may be a revisit
PIECE = 1 << 16  # bytes inflated or read at once
GROUP = 1 << 22  # bytes of payloads in one Arrow batch
#: A gzip header with an extra field "SZ" of 8 bytes, the size of the whole member.
_GZIP = struct.Struct("<2sBBIBBH2sHQ")


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return fs.LocalFileSystem(), path


# --- Records --------------------------------------------------------------------------------------------

def head(first: str, fields: list[tuple[str, str | None]]) -> bytes:
    """A version or status line and its header fields, with the empty line behind them."""
    lines = [first, *(f"{k}: {v}" for k, v in fields if v is not None), "", ""]
    return "\r\n".join(line.replace("\r", " ").replace("\n", " ") for line in lines).encode()


def parse_head(data: bytes) -> tuple[str, dict[str, str]]:
    """First line and fields (names in lower case; the first of equal names counts)."""
    first, *lines = data.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()  # a folded line
        elif ":" in line:
            name, value = line.split(":", 1)
            last = name.strip().lower()
            fields.setdefault(last, value.strip())
    return first, fields


def member(record: bytes, level: int = 1) -> bytes:
    """A record as a gzip member that knows its size."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(record) + squeeze.flush()
    size = _GZIP.size + len(body) + 8
    start = _GZIP.pack(b"\x1f\x8b", 8, 4, 0, 0, 255, 12, b"SZ", 8, size)
    return start + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class _Raw:
    """Bytes of an archive as they are."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.held = stream, size, b""

    def more(self) -> bool:
        piece = self.stream.read(PIECE)
        self.held += piece
        return bool(piece)

    def done(self) -> bool:
        return not self.held and not self.more()

    def until(self, mark: bytes) -> bytes:
        """All up to and with the mark."""
        seen = 0
        while (found := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                raise ValueError("a record is cut off")
        found += len(mark)
        out, self.held = self.held[:found], self.held[found:]
        return out

    def take(self, n: int) -> bytes:
        parts, left = [self.held[:n]], n - len(self.held)
        self.held = self.held[n:]
        if left > 0:
            parts.append(self.stream.read(left))
        out = b"".join(parts)
        if len(out) < n:
            raise ValueError("a record is cut off")
        return out

    def skip(self, n: int) -> None:
        left = n - len(self.held)
        self.held = self.held[n:]
        if left > 0:
            self.stream.seek(left, io.SEEK_CUR)
            if self.stream.tell() > self.size:
                raise ValueError("a record is cut off")

    def end(self) -> None:
        """Behind a record: two line ends."""
        self.take(4)


class _Members:
    """Inflated bytes of an archive of gzip members, one member at a time."""

    def __init__(self, stream, size: int):
        self.stream, self.size, self.start = stream, size, 0

    def done(self) -> bool:
        if self.start >= self.size:
            return True
        self.stream.seek(self.start)
        first = self.stream.read(_GZIP.size)
        self.length = None
        if len(first) == _GZIP.size and first[3] & 4:
            *_, extra, name, n, length = _GZIP.unpack(first)
            if extra >= 12 and name == b"SZ" and n == 8:
                self.length = length
                if self.start + length > self.size:
                    raise ValueError("a record is cut off")
        self.inflate, self.waiting, self.held = zlib.decompressobj(31), first, b""
        return False

    def more(self, wanted: int = 4096) -> bool:
        """Inflates about ``wanted`` bytes more."""
        if self.inflate.eof:
            return False
        if not self.waiting:
            self.waiting = self.stream.read(min(PIECE, max(4096, wanted)))
            if not self.waiting:
                raise ValueError("a record is cut off")
        piece = self.inflate.decompress(self.waiting, wanted)
        self.waiting = self.inflate.unconsumed_tail
        self.held += piece
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (found := self.held.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.held)
            if not self.more():
                raise ValueError("a record is cut off")
        found += len(mark)
        out, self.held = self.held[:found], self.held[found:]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self.more(n - have):
                raise ValueError("a record is cut off")
            parts.append(self.held)
            have += len(self.held)
        out = b"".join(parts)
        self.held = out[n:]
        return out[:n]

    def skip(self, n: int) -> None:
        """The rest of the member goes unread."""

    def end(self) -> None:
        if self.length is None:
            while self.more(PIECE):
                self.held = b""
            if not self.inflate.eof:
                raise ValueError("a record is cut off")
            self.length = self.stream.tell() - len(self.inflate.unused_data) - self.start
        self.start += self.length


def records(stream, size: int, wanted=lambda fields: True, payload: bool = True) -> Iterator[tuple[dict, dict | None, bytes | None]]:
    """(header fields, HTTP header fields, payload) of the wanted records of one archive."""
    first = stream.read(2)
    stream.seek(0)
    source = (_Members if first == b"\x1f\x8b" else _Raw)(stream, size)
    while not source.done():
        version, fields = parse_head(source.until(b"\r\n\r\n"))
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        length = int(fields["content-length"])
        if not wanted(fields):
            source.skip(length)
        else:
            http, body, left = None, None, length
            if length and fields.get("content-type", "").replace(" ", "").startswith("application/http"):
                start = source.until(b"\r\n\r\n")
                left -= len(start)
                if left < 0:
                    raise ValueError("HTTP headers go beyond their record")
                http = parse_head(start)[1]
            if payload:
                body = source.take(left)
            else:
                source.skip(left)
            yield fields, http, body
        source.end()


# --- Data source ------------------------------------------------------------------------------------------

def _value(name: str, fields: dict[str, str]):
    text = fields.get(FIELDS[name])
    return int(text) if text is not None and name == "content_length" else text


def _holds(test: Filter, fields: dict[str, str]) -> bool:
    value = _value(test.attribute[0], fields)
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, IsNotNull):
        return value is not None
    if isinstance(test, EqualNullSafe):
        return value == test.value
    if isinstance(test, EqualTo):
        return value is not None and value == test.value
    if isinstance(test, In):
        return value is not None and value in test.value
    return value is not None and value.startswith(test.value)


@dataclass
class Files(InputPartition):
    files: tuple[tuple[str, int], ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.columns = options["path"], [f.name for f in schema.fields]
        self.kinds = pa.schema([(f.name, _ARROW[f.name]) for f in schema.fields])
        self.target = int(options.get("partitionbytes", 64 << 20))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        for test in filters:
            known = isinstance(test, (EqualTo, EqualNullSafe, In, IsNull, IsNotNull, StringStartsWith))
            if known and len(test.attribute) == 1 and test.attribute[0] in FIELDS:
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> list[Files]:
        system, root = open_path(self.path)
        one = system.get_file_info(root)
        found = [one] if one.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted(
            (f.path, f.size) for f in found
            if f.type == fs.FileType.File and f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith((".", "_"))
        )
        groups: list[list] = []
        held = 0
        for path, size in files:
            if not groups or held + size > self.target:
                groups.append([])
                held = 0
            groups[-1].append((path, size))
            held += size
        return [Files(tuple(g)) for g in groups] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = open_path(self.path)
        payload = "payload" in self.columns
        rows: list[tuple] = []
        held = 0
        for path, size in partition.files:
            with system.open_input_file(path) as stream:
                wanted = lambda fields: all(_holds(t, fields) for t in self.tests)
                for fields, http, body in records(stream, size, wanted, payload):
                    given = {"headers": list(fields.items()), "http_headers": http and list(http.items()), "payload": body}
                    rows.append(tuple(given[c] if c in given else _value(c, fields) for c in self.columns))
                    held += len(body or b"") + 500
                    if held > GROUP:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.kinds)], schema=self.kinds)


_ARROW = {c: pa.string() for c in FIELDS} | {
    "content_length": pa.int64(), "headers": pa.map_(pa.string(), pa.string()),
    "http_headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary(),
}


@dataclass
class Written(WriterCommitMessage):
    drafts: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    """Writes columns record_type, record_id, target_uri, date, refers_to, payload_digest and payload;
    ``payload_length`` names the size of a revisit's payload, which itself is not written."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.limit, self.overwrite = options["path"], int(options.get("filebytes", 64 << 20)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = open_path(self.path)
        system.create_dir(root, recursive=True)
        drafts: list[str] = []
        stream, held = None, 0
        for batch in iterator:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "payload"}
            for k, body in enumerate(row_bytes(batch.column("payload"))):
                if stream is None:
                    drafts.append(f"{root}/.draft-{uuid.uuid4().hex}")
                    stream, held = system.open_output_stream(drafts[-1]), 0
                data = member(self._record({n: c[k] for n, c in columns.items()}, body))
                stream.write(data)
                held += len(data)
                if held >= self.limit:
                    stream.close()
                    stream = None
        if stream is not None:
            stream.close()
        return Written(tuple(drafts))

    @staticmethod
    def _record(row: dict, body: memoryview) -> bytes:
        revisit = row["record_type"] == "revisit"
        size = row["payload_length"] if revisit else len(body)
        http = head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size))])
        block = http if revisit else http + body
        fields = [
            ("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row.get("date") or DATE),
            ("WARC-Target-URI", row.get("target_uri")), ("WARC-Payload-Digest", row.get("payload_digest")),
            ("WARC-Refers-To", row.get("refers_to")), ("WARC-Profile", PROFILE if revisit else None),
            ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
        ]
        return head("WARC/1.1", fields) + block + b"\r\n\r\n"

    def commit(self, messages: list[Written | None]) -> None:
        system, root = open_path(self.path)
        old = [
            f.path for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True))
            if f.type == fs.FileType.File and f.base_name.endswith(".warc.gz")
        ] if self.overwrite else []
        for message in messages:
            for draft in message.drafts if message else ():
                system.move(draft, f"{root}/{draft.rsplit('.draft-', 1)[1]}.warc.gz")
        for path in old:
            system.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = open_path(self.path)
        for message in messages:
            for draft in message.drafts if message else ():
                if system.get_file_info(draft).type == fs.FileType.File:
                    system.delete_file(draft)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def scan(spark: SparkSession, folder: str, where: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The records of a folder that meet a condition, with the named columns (all, if none are
    named). Each call loads the folder anew: Spark 4.1 keeps the filters that it pushed last with
    the loaded relation, so branches of one ``load`` with different filters would share them."""
    register(spark)
    fields = dict(f.strip().split(" ", 1) for f in SCHEMA.replace("string,string", "string;string").split(","))
    chosen = ", ".join(f"{c} {fields[c]}".replace(";", ",") for c in columns or fields)
    read = spark.read.format("warc").schema(chosen).load(folder)
    return read.where(where) if where else read


# --- Pages ------------------------------------------------------------------------------------------------

def _named(row) -> F.Column:
    """The name of a record: its page's id and running number."""
    return F.concat(F.lit("<urn:page:"), F.coalesce(row["page"].cast("string"), F.lit("")), F.lit(":"), row["number"].cast("string"), F.lit(">"))


def write_pages(
    pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST
) -> str:
    """Writes a record per page, and gives the folder."""
    spark = pages.sparkSession
    register(spark)
    folder = folder or scratch_path(spark, "warc")
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    # Numbers are given once: a second evaluation could number the rows otherwise.
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).alias("target_uri"), payload.alias("payload")).withColumns({
        "number": F.monotonically_increasing_id(), "digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long"),
    })
    numbered = scratch_path(spark, "pages")
    rows.write.option("compression", "zstd").parquet(numbered)
    rows = spark.read.schema(rows.schema).parquet(numbered)
    # The response of equal payloads: the smallest id, a missing one last. Only payloads that two
    # pages have go on to the join, which adaptive execution splits where one has very many.
    key = F.struct(F.col("page").isNull().alias("none"), F.col("page"), F.col("number"))
    first = rows.where(F.col("payload_length") >= least).groupBy("digest").agg(F.min(key).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("digest").alias("d"), "first")
    found = rows.join(first, F.col("digest") == F.col("d"), "left")
    again = F.coalesce((F.col("first.number") != F.col("number")) & (F.col("payload_length") >= least), F.lit(False))
    found.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), _named({"page": F.col("page"), "number": F.col("number")}).alias("record_id"),
        "target_uri", F.when(again, _named(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), F.col("digest")).alias("payload_digest"), "payload_length",
        F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(folder)
    return folder


def _page(record) -> F.Column:
    return F.nullif(F.regexp_extract(record, r"^<urn:page:([^:]*):\d+>$", 1), F.lit("")).cast("long")


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = [bytes(b) for b in row_bytes(batch.column("payload"))]
        yield pa.RecordBatch.from_arrays([
            batch.column("record_id"), batch.column("record_type"), pa.array([len(b) for b in bodies], pa.int64()),
            pa.array([hashlib.sha256(b).hexdigest() for b in bodies], pa.string()), batch.column("refers_to"),
        ], names=["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"])


def _revisits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [int(dict(http)["content-length"]) for http in batch.column("http_headers").to_pylist()]
        digests = [d.removeprefix("sha256:") for d in batch.column("payload_digest").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("record_id"), batch.column("record_type"), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
            batch.column("refers_to"),
        ], names=["record_id", "record_type", "payload_bytes", "payload_digest", "refers_to"])


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to). Responses are measured by
    the payload itself; of revisits only the headers are read."""
    out = "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string"
    responses = scan(spark, folder, "record_type = 'response'", ["record_type", "record_id", "refers_to", "payload"])
    revisits = scan(spark, folder, "record_type = 'revisit'", ["record_type", "record_id", "refers_to", "payload_digest", "http_headers"])
    return responses.mapInArrow(_check, out).union(revisits.mapInArrow(_revisits, out)).select(
        _page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page(F.col("refers_to")).alias("refers_to")
    )


ORACLE = """
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes,
         sha256(coalesce(html, '')) as payload_digest
  from pages
), f as (
  select *, row_number() over (partition by payload_digest order by page_id) as n,
         min(page_id) over (partition by payload_digest) as first
  from p
)
select page_id, payload_bytes, payload_digest,
       case when n > 1 and payload_bytes >= 100 then 'revisit' else 'response' end as record_type,
       case when n > 1 and payload_bytes >= 100 then first end as refers_to
from f
"""


@query("op12_warc", ORACLE)
def op12(spark, sf_dir):
    return read_pages(spark, write_pages(table(spark, sf_dir, "pages")))
