"""WARC archives (1.0 and 1.1) as a PySpark Python data source and sink, format "warc".

Writing: each task writes one archive, ``part-<id>.warc.gz``, with a gzip member for each record. The member's
extra field ``sl`` holds its length, so that it can be passed over. A response's block is an HTTP response, a
revisit's the head of one. Names appear only when the job commits.
Columns: record_id, type (response, revisit or others), uri, refers_to, digest, payload (binary), payload_bytes
(of the payload that a revisit stands for). Records without an id get one; ids and digests are written as they are.

Reading: ``*.warc.gz`` and ``*.warc`` of a folder, whoever wrote them, or one file. The planner cuts compressed
archives into byte ranges of ``splitBytes`` (0: none), for it needs no index: a task seeks to its range, looks
for the first gzip member there that holds a record, and reads the records whose member starts in it.
Headers are parsed first, whatever the case of their names, with continued lines. Predicates on the header
columns (type, record_id, uri, refers_to, digest, payload_bytes) are pushed down and tested on headers alone: the
block of a record that fails, and any block when ``payload`` is "false", is not decoded if its length is known
(``sl``, or no compression), and else inflated piece by piece, but never kept.
An archive whose records hold other archives, stored as they are, must be read whole (``splitBytes`` 0).

Paths: local ones and file:// are opened directly, others through pyarrow's file systems.

Defined results: a null payload is written as an empty one; null header values are left out and
read as null; a record's payload may have any length, and is whole in memory only where it is wanted; repeated rows
are repeated records; a folder without archives reads as no rows; a damaged record raises ValueError
with its place; ``archive`` reads three columns, whatever the others are named.
"""

from __future__ import annotations

import io
import operator
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage

from .common import materialize, scratch_path

SCHEMA = "record_id string, type string, date string, uri string, refers_to string, digest string, content_type string, payload_bytes long, payload binary"
_NAMES = tuple(x.split()[0] for x in SCHEMA.split(", "))
_KINDS = tuple(pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string() for n in _NAMES)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"
_PIECE, _HEAD = 1 << 14, 1 << 20
_MAGIC = b"\x1f\x8b\x08"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


# Writing.
def encode(record: dict, payload: bytes, date: str) -> bytes:
    """A record as one gzip member."""
    size = record.get("payload_bytes")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = http if record["type"] == "revisit" else http + payload
    values = {
        "WARC-Type": record["type"],
        "WARC-Record-ID": f"<{record.get('record_id') or uuid.uuid4().urn}>",
        "WARC-Date": date,
        "WARC-Target-URI": record.get("uri"),
        "WARC-Refers-To": f"<{record['refers_to']}>" if record.get("refers_to") else None,
        "WARC-Payload-Digest": record.get("digest"),
        "WARC-Profile": PROFILE if record["type"] == "revisit" else None,
        "Content-Type": HTTP,
        "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {re.sub('[\r\n]', '', v)}\r\n" for k, v in values.items() if v is not None)
    return member(head.encode() + b"\r\n" + block + b"\r\n\r\n")


def member(data: bytes) -> bytes:
    """A gzip member that names its length in the extra field sl, where it fits."""
    z = zlib.compressobj(3, wbits=-15)
    body = z.compress(data) + z.flush()
    size = 24 + len(body) + 8
    fits = max(size, len(data)) < 1 << 32
    extra = struct.pack("<H2sHII", 12, b"sl", 8, size if fits else 0, len(data) if fits else 0)
    return _MAGIC + b"\x04" + b"\0" * 5 + b"\xff" + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


# Reading.
def parse_header(data: bytes) -> dict[str, str]:
    """Fields of a WARC header by their names in lower case; continued lines are joined."""
    first, *lines = re.split(r"\r?\n", data.decode("utf-8", "replace"))
    if not first.startswith("WARC/"):
        raise ValueError(f"no record: {first[:40]!r}")
    got: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            got[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            got[name] = value.strip()
    return got


def _bare(x: str | None) -> str | None:
    return x[1:-1] if x and x[0] == "<" and x[-1] == ">" else x


class _Stream:
    """What a gzip member holds, or a file from a place on, inflated as it is asked for."""

    def __init__(self, f, at: int, packed: bool):
        f.seek(at)
        self.f, self.at, self.packed, self.data, self.over = f, at, packed, b"", False
        self.z, self.fed = zlib.decompressobj(31), 0

    def more(self) -> bool:
        if self.over:
            return False
        if not self.packed:
            piece = self.f.read(_PIECE)
            self.over = not piece
            self.data += piece
            return bool(piece)
        piece = self.z.unconsumed_tail
        if not piece:
            piece = self.f.read(_PIECE)
            self.fed += len(piece)
            if not piece:
                raise ValueError("truncated member")
        self.data += self.z.decompress(piece, 4 * _PIECE)
        self.over = self.z.eof
        return True

    def until(self, mark: bytes, most: int = _HEAD) -> bytes | None:
        """Up to the mark, which is passed; None (and nothing passed) where there is none."""
        seen = 0
        while (i := self.data.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.data)
            if seen > most or not self.more():
                return None
        out, self.data = self.data[:i], self.data[i + len(mark) :]
        return out

    def take(self, n: int, keep: bool) -> bytes:
        parts, left = [], n
        while left:
            if not self.data:
                if not self.packed and not keep:
                    self.f.seek(left, io.SEEK_CUR)  # nothing to inflate
                    return b""
                if not self.more():
                    raise ValueError("truncated record")
            part, self.data = self.data[:left], self.data[left:]
            left -= len(part)
            if keep:
                parts.append(part)
        return b"".join(parts)

    def start(self) -> bool:
        """Passes the line ends between records; whether something follows."""
        while True:
            self.data = self.data.lstrip(b"\r\n")
            if self.data:
                return True
            if not self.more():
                return False

    def end(self) -> int:
        """Where the member ends: the rest of it is inflated."""
        while not self.over:
            self.data = b""
            self.more()
        return self.at + self.fed - len(self.z.unused_data)


def member_size(head: bytes) -> int:
    """The length in the extra field sl of a member's first bytes; 0: unknown."""
    if len(head) > 12 and head[3] & 4:
        at, end = 12, 12 + int.from_bytes(head[10:12], "little")
        while at + 4 <= min(end, len(head)):
            size = int.from_bytes(head[at + 2 : at + 4], "little")
            if head[at : at + 2] == b"sl" and size == 8 and at + 12 <= len(head):
                return int.from_bytes(head[at + 4 : at + 8], "little")
            at += 4 + size
    return 0


def _holds_record(f, at: int) -> bool:
    try:
        s = _Stream(f, at, True)
        s.more()
        return s.data.lstrip(b"\r\n").startswith(b"WARC/")
    except (zlib.error, ValueError):
        return False


def first_member(f, begin: int, end: int) -> int:
    """The first place in the range where a member with a record starts; end: none."""
    at = begin
    while at < end:
        f.seek(at)
        data = f.read(min(1 << 20, end - at) + 2)
        i = data.find(_MAGIC)
        while i >= 0:
            if at + i >= end:
                return end
            if _holds_record(f, at + i):
                return at + i
            i = data.find(_MAGIC, i + 1)
        at += 1 << 20
    return end


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int


_TESTS = {EqualTo: operator.eq, EqualNullSafe: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
_HEADERS = {"record_id", "type", "uri", "refers_to", "digest", "payload_bytes"}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", 32 << 20)))
        self.want = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = [("type", "eq", options["type"])] if options.get("type") else []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in _HEADERS and type(f) in _TESTS:
                self.tests.append((name, _TESTS[type(f)].__name__, f.value))
            elif name in _HEADERS and isinstance(f, In):
                self.tests.append((name, "in", tuple(f.value)))
            elif name in _HEADERS and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((name, "null" if isinstance(f, IsNull) else "not null", None))
            else:
                yield f

    def partitions(self):
        fs, root = file_system(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        out = []
        for info in sorted(files, key=lambda i: i.path):
            name = info.path.rpartition("/")[2]
            if name[0] in "_." or not name.endswith((".warc", ".warc.gz")):
                continue
            path = self.path if info.path == root else f"{self.path.rstrip('/')}/{name}"
            step = self.split if self.split and name.endswith(".gz") else info.size
            out += [Range(path, a, min(a + step, info.size)) for a in range(0, info.size, max(step, 1))]
        return out or [Range("", 0, 0)]

    def _passes(self, head: dict) -> bool:
        for name, test, value in self.tests:
            x = head[name]
            if test == "null" or test == "not null":
                ok = (x is None) == (test == "null")
            elif x is None:
                ok = test == "eq" and value is None
            elif test == "in":
                ok = x in value
            else:
                ok = value is not None and getattr(operator, test)(x, value)
            if not ok:
                return False
        return True

    def record(self, s: _Stream) -> tuple | None:
        """The next record of a stream; None where it fails the tests. Of its block no more is read than that needs."""
        head = s.until(b"\r\n\r\n")
        if head is None:
            raise ValueError("no end of a header")
        got = parse_header(head)
        left = int(got["content-length"])
        kind, form = got.get("warc-type"), got.get("content-type")
        size: int | None = left
        if form and form.lower().startswith("application/http") and kind in ("response", "request", "revisit"):
            # The payload follows the block's own header; that of a revisit names the size of what it stands for.
            while len(s.data) < left and b"\r\n\r\n" not in s.data and len(s.data) < _HEAD and s.more():
                pass
            own, found, _ = s.data[:left].partition(b"\r\n\r\n")
            skip = len(own) + 4 if found else 0
            s.take(skip, False)
            left -= skip
            named = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", own) if kind == "revisit" else None
            size = left if kind != "revisit" else int(named[1]) if named else None
        row = dict(record_id=_bare(got.get("warc-record-id")), type=kind, date=got.get("warc-date"), uri=_bare(got.get("warc-target-uri")), refers_to=_bare(got.get("warc-refers-to")), digest=got.get("warc-payload-digest"), content_type=form, payload_bytes=size)
        if not self._passes(row):
            self.left = left
            return None
        payload = s.take(left, True) if self.want else None
        self.left = 0 if self.want else left
        return (*row.values(), payload)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, path = file_system(partition.path)
        rows, held = [], 0
        with fs.open_input_file(path) as raw:
            f = io.BufferedReader(raw, 1 << 18)
            packed = f.read(2) == _MAGIC[:2]
            at = first_member(f, partition.begin, partition.end) if packed and partition.begin else partition.begin
            while at < partition.end:
                f.seek(at)
                known = member_size(f.read(64)) if packed else 0
                s = _Stream(f, at, packed)
                try:
                    while s.start():
                        row = self.record(s)
                        if row is not None:
                            rows.append(row)
                            held += len(row[-1] or b"")
                        if len(rows) >= 4096 or held >= 16 << 20:
                            yield self._batch(rows)
                            rows, held = [], 0
                        if known:
                            break  # written one record a member: what is left is passed over
                        s.take(self.left, False)
                    at = at + known if known else s.end() if packed else partition.end
                except (ValueError, KeyError, zlib.error) as e:
                    raise ValueError(f"{partition.path} at {at}: {e}") from e
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.date = options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        name, some = f"part-{uuid.uuid4().hex}.warc.gz", False
        with fs.open_output_stream(f"{root}/_{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    out.write(encode(row, row.get("payload") or b"", self.date))
                    some = True
        if not some:
            fs.delete_file(f"{root}/_{name}")
        return Written(name if some else "")

    def commit(self, messages):
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.move(f"{root}/_{m.name}", f"{root}/{m.name}")

    def abort(self, messages):
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{root}/_{m.name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark offer predicates to it (off by default for Python sources)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


PAGE = "urn:page:"


def page_of(record_id: Column) -> Column:
    """The id of a page of ``archive``; null for other records."""
    return F.when(record_id.startswith(PAGE), F.substr(record_id, F.lit(len(PAGE) + 1)).try_cast("long"))


def archive(pages: DataFrame, path: str, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write pages as records (ids urn:page:<id>): of equal payloads of at least that many bytes the one with
    the smallest id is the response, others are revisits of it. A null id reads as a made one."""
    register(pages.sparkSession)
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    # Smallest id by digest: aggregated in each task first, joined by digest; payloads of unique digests stay put.
    keys = rows.select("record_id", "digest", "payload_bytes").where(F.col("payload_bytes") >= least)
    several = materialize(keys.groupBy("digest").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1"), "digests")
    joined = rows.join(several.select("digest", "first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit(PAGE), c.cast("string"))
    out = joined.select(
        urn(F.col("record_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        "uri",
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("digest"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, payload: bool = True, kind: str | None = None) -> DataFrame:
    """Records of an archive; kind and payload reach the reader whatever the session's settings."""
    register(spark)
    rows = spark.read.format("warc").option("path", path).option("payload", str(payload).lower())
    return (rows.option("type", kind) if kind else rows).load()


def scratch_archive(spark: SparkSession) -> str:
    return scratch_path(spark, "warc")
