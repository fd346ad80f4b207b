"""WARC archives: a Python data source, and archiving of pages with revisits.

Writing: each Spark task writes one archive of gzip members, one per record, and an
index beside it with a row per member: where it lies, how many bytes it takes, and the
header columns.  Responses hold an HTTP block, the page being its body; revisits name
the record that they refer to.

Reading: archives are planned as file partitions, cut at record boundaries.  In an
archive with an index, pushed predicates on record type and headers are decided from
the index, and a member that fails them is passed over without a byte of it read; of
one whose payload isn't asked for (option ``payload`` false) only the headers are
decompressed.  Archives without an index are read from end to end: in plain ones
(.warc) unwanted bodies are passed over, gzipped ones have to be decompressed to find
the next record, but unwanted bodies aren't kept.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from . import shared

#: Names in the archive format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_type string, record_id string, target_uri string, page_id long, date string, payload_digest string, refers_to long, payload_bytes long, headers map<string,string>, payload binary"
#: Bytes of archive planned into one partition, and rows sent to Spark at once.
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
#: Bytes read and decompressed at a time, and fewer where only headers are wanted.
STEP, HEAD_STEP = 1 << 16, 1 << 12
#: Rows of an index written at a time.
INDEX_ROWS = 20_000
#: Fixed value: the start of the block that stands for a server's answer.
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(body)))])
    return gzip.compress(VERSION + b"\r\n" + head + b"\r\n" + body + b"\r\n\r\n", compresslevel=3, mtime=0)


class Members:
    """Reads records from a stream of gzip members (or plain records), headers first."""

    def __init__(self, stream: BinaryIO, plain: bool = False, step: int = STEP):
        self.stream, self.plain, self.step = stream, plain, step
        self.raw, self.out = b"", bytearray()
        self.inflate = None
        self.inflated = 0  # bytes decompressed so far

    def _fill(self) -> bool:
        if self.plain:
            part = self.stream.read(self.step)
            self.out += part
            return bool(part)
        while True:
            if not self.raw:
                self.raw = self.stream.read(self.step)
                if not self.raw:
                    return False
            if self.inflate is None:
                self.inflate = zlib.decompressobj(31)
            part = self.inflate.decompress(self.raw, self.step)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, None
            if part:
                self.out += part
                self.inflated += len(part)
                return True

    def headers(self) -> dict[str, str] | None:
        """Headers of the next record, in the order written; None at the end.

        Names are kept as they are written (``named`` looks them up in any case); a
        line that begins with white space goes on with the one before; a name that
        repeats has its values joined by commas.
        """
        while True:
            while self.out[:2] == b"\r\n":
                del self.out[:2]
            at = self.out.find(b"\r\n\r\n")
            if at >= 0 and len(self.out) > 4:
                break
            if not self._fill():
                if self.out.strip():
                    raise EOFError("archive ends inside a record's headers")
                return None
        first, *lines = bytes(self.out[:at]).decode("utf-8", "replace").split("\r\n")
        del self.out[: at + 4]
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        found: dict[str, str] = {}
        name = None
        for line in lines:
            if line[:1] in (" ", "\t") and name is not None:
                found[name] += " " + line.strip()
                continue
            name, _, value = line.partition(":")
            name = next((x for x in found if x.lower() == name.strip().lower()), name.strip())
            found[name] = f"{found[name]}, {value.strip()}" if name in found else value.strip()
        return found

    def skip(self, size: int) -> None:
        held = min(size, len(self.out))
        del self.out[:held]
        size -= held
        if self.plain:
            self.stream.skip(size)
            return
        while size:
            if not self._fill():
                raise EOFError("archive ends inside a record")
            held = min(size, len(self.out))
            del self.out[:held]
            size -= held

    def body(self, size: int) -> bytes:
        while size > len(self.out):
            if not self._fill():
                raise EOFError("archive ends inside a record")
        found = bytes(self.out[:size])
        del self.out[:size]
        return found


def named(headers: dict[str, str]) -> dict[str, str]:
    """Headers by lower-cased name."""
    return {k.lower(): v for k, v in headers.items()}


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload of a block: what follows the HTTP headers in a server's answer or a request, else all."""
    if named(headers).get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        return block[at + 4 :] if at >= 0 else b""
    return block


@dataclass
class Split(InputPartition):
    path: str
    start: int
    length: int
    plain: bool = False
    index: str = ""


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and x.lstrip("-").isdigit() else None


def columns_of(headers: dict[str, str]) -> dict:
    """Header columns of a record."""
    h = named(headers)
    digest = h.get("warc-payload-digest")
    return {
        "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "page_id": _number(h.get("x-page-id")), "date": h.get("warc-date"),
        "payload_digest": digest.removeprefix("sha1:") if digest else None, "refers_to": _number(h.get("x-refers-to-page")), "payload_bytes": _number(h.get("x-payload-length")),
    }


_TESTS = {
    EqualTo: lambda v, f: v == f.value,
    In: lambda v, f: v in f.value,
    GreaterThan: lambda v, f: v > f.value,
    GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value,
    LessThanOrEqual: lambda v, f: v <= f.value,
    IsNotNull: lambda v, f: True,
    StringStartsWith: lambda v, f: v.startswith(f.value),
    StringEndsWith: lambda v, f: v.endswith(f.value),
    StringContains: lambda v, f: f.value in v,
}
_HEADER_COLUMNS = ("record_type", "record_id", "target_uri", "page_id", "date", "payload_digest", "refers_to", "payload_bytes")


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in _TESTS and len(f.attribute) == 1 and f.attribute[0] in _HEADER_COLUMNS:
                self.tests.append((f.attribute[0], f))
            else:
                yield f

    def partitions(self) -> list[Split]:
        fs, inner = shared.open_fs(self.path)
        info = fs.get_file_info(inner)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
        names = {f.path: f for f in files}
        out: list[Split] = []
        for name in sorted(names):
            if not name.endswith((".warc", ".warc.gz")):
                continue
            f, plain = names[name], name.endswith(".warc")
            if plain or f"{name}.cuts" not in names:
                out.append(Split(name, 0, f.size, plain))
                continue
            cuts = json.loads(fs.open_input_stream(f"{name}.cuts").read())  # a place about every SPLIT_BYTES
            index = f"{name}.index" if f"{name}.index" in names else ""
            out += [Split(name, a, b - a, index=index) for a, b in zip(cuts, [*cuts[1:], f.size], strict=True) if b > a]
        return out or [Split("", 0, 0)]

    def _wanted(self, row: dict) -> bool:
        return all(row[name] is not None and _TESTS[type(f)](row[name], f) for name, f in self.tests)

    def _records(self, fs: pafs.FileSystem, split: Split) -> Iterator[dict]:
        """The wanted records of a split as rows."""
        with fs.open_input_file(split.path) as file:
            if split.index:
                for start, size in self._members(fs, split):
                    records = Members(_Window(file, start, size), step=STEP if self.payload else HEAD_STEP)
                    yield self._row(records, records.headers())
                return
            records = Members(_Window(file, split.start, split.length), split.plain)
            while (h := records.headers()) is not None:
                if self._wanted(columns_of(h)):
                    yield self._row(records, h, skip=True)
                else:
                    records.skip(int(named(h).get("content-length", 0)) + 4)

    def _members(self, fs: pafs.FileSystem, split: Split) -> Iterator[tuple[int, int]]:
        """Where the wanted members of a split lie, by the index."""
        within = (pc.field("start") >= split.start) & (pc.field("start") < split.start + split.length)
        rows = pq.read_table(split.index, filesystem=fs, filters=within, columns=["start", "size", *{name for name, _ in self.tests}])
        for row in rows.to_pylist():
            if self._wanted(row):
                yield row["start"], row["size"]

    def _row(self, records: Members, h: dict[str, str], skip: bool = False) -> dict:
        """A record's row; its digest is that of the payload where that is read."""
        length = int(named(h).get("content-length", 0))
        row = columns_of(h) | {"headers": h, "payload": None}
        if self.payload and row["record_type"] != "revisit":
            row["payload"] = payload_of(h, records.body(length))
            row["payload_digest"] = sha1_base32(row["payload"])
            if skip:
                records.skip(4)
        elif skip:
            records.skip(length + 4)
        return row

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.schema)
        if not split.path:
            return
        fs, _ = shared.open_fs(self.path)
        rows, size = [], 0
        for row in self._records(fs, split):
            rows.append(row)
            size += 400 + len(row["payload"] or b"")
            if size >= BATCH_BYTES:
                yield self._batch(rows, kind)
                rows, size = [], 0
        if rows:
            yield self._batch(rows, kind)

    @staticmethod
    def _batch(rows: list[dict], kind: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(r[f.name].items()) if f.name == "headers" else r[f.name] for r in rows], f.type) for f in kind], schema=kind)


class _Window:
    """A stretch of a file as a stream."""

    def __init__(self, file, start: int, length: int):
        self.file, self.left = file, length
        file.seek(start)

    def read(self, n: int) -> bytes:
        part = self.file.read(min(n, self.left)) if self.left else b""
        self.left -= len(part)
        return part

    def skip(self, n: int) -> None:
        n = min(n, self.left)
        self.file.seek(n, 1)
        self.left -= n


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    records: int


_INDEX = pa.schema([("start", pa.int64()), ("size", pa.int64()), *((c, pa.int64() if c in ("page_id", "refers_to", "payload_bytes") else pa.string()) for c in _HEADER_COLUMNS)])


class WarcWriter(DataSourceArrowWriter):
    """Writes rows (page_id, url, payload, refers_to, first_url, size, digest); refers_to null: a response.

    Tasks write into a folder of the job, from which only the files of successful
    tasks are moved when it commits; the rest goes with the folder.
    """

    def __init__(self, options: dict):
        self.path, self.job = options["path"], f"_job-{uuid.uuid4().hex}"
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, inner = shared.open_fs(self.path)
        folder, name = f"{inner}/{self.job}", f"part-{uuid.uuid4().hex}.warc.gz"
        fs.create_dir(folder, recursive=True)
        cuts, at, records, rows = [0], 0, 0, []
        columns = ("page_id", "url", "payload", "refers_to", "first_url", "size", "digest")
        with fs.open_output_stream(f"{folder}/{name}", compression=None) as out, fs.open_output_stream(f"{folder}/{name}.index", compression=None) as file, pq.ParquetWriter(file, _INDEX) as index:
            for batch in iterator:
                for values in zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in columns), strict=True):
                    headers, block = self._record(**dict(zip(columns, values, strict=True)))
                    member = encode_record(headers, block)
                    out.write(member)
                    rows.append({"start": at, "size": len(member), **columns_of(dict(headers))})
                    at, records = at + len(member), records + 1
                    if at - cuts[-1] >= SPLIT_BYTES:
                        cuts.append(at)
                    if len(rows) >= INDEX_ROWS:
                        index.write_table(pa.Table.from_pylist(rows, _INDEX))
                        rows = []
            index.write_table(pa.Table.from_pylist(rows, _INDEX))
        with fs.open_output_stream(f"{folder}/{name}.cuts", compression=None) as out:
            out.write(json.dumps(cuts).encode())
        return Written([f"{name}.cuts", f"{name}.index", name], records)

    def _record(self, page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, first_url: str | None, size: int, digest: bytes) -> tuple[list[tuple[str, str]], bytes]:
        """Headers and block of a page's record."""
        sha1, block = base64.b32encode(digest).decode(), b""
        headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, sha1)), ("WARC-Date", self.date)]
        if url is not None:
            headers.append(("WARC-Target-URI", " ".join(url.split())))
        headers += [("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-Length", str(size))]
        if page_id is not None:
            headers.append(("X-Page-Id", str(page_id)))
        if refers_to is None:
            block = HTTP_HEAD.format(size).encode() + (payload or b"")
        else:
            headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, sha1)), ("WARC-Refers-To-Date", self.date), ("X-Refers-To-Page", str(refers_to))]
            if first_url is not None:
                headers.append(("WARC-Refers-To-Target-URI", " ".join(first_url.split())))
        return [*headers, ("Content-Type", "application/http; msgtype=response")], block

    def commit(self, messages) -> None:
        fs, inner = shared.open_fs(self.path)
        for m in messages:
            for name in m.files if m else ():
                fs.move(f"{inner}/{self.job}/{name}", f"{inner}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        fs, inner = shared.open_fs(self.path)
        if fs.get_file_info(f"{inner}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{inner}/{self.job}")


def record_id(page: int | None, digest: str) -> str:
    """A record's name: the same for a page and its payload wherever it is named; a new one for a page without id."""
    return f"<urn:uuid:{uuid.uuid4() if page is None else uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {digest}')}>"


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: path, payload (true), date (for writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    shared.prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per page; equal payloads of at least ``min_bytes`` become revisits of the smallest id.

    Defined cases: a null html is the empty payload; a page without id is a
    response with no id header, never a revisit's target; rows that repeat the
    smallest id of their payload are all responses; a null url has no target
    header, and white space in a url becomes single spaces; an empty table writes
    no record; other columns of the input are ignored.

    Only digests are grouped (with partial aggregation); pages travel once, to the
    task that writes them, and adaptive execution splits a payload's hot group.
    """
    register(pages.sparkSession)
    payload = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload").cast("long")})
    first = rows.where((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.min_by("url", "page_id").alias("first_url"))
    copies = shared.write_and_read(first.where(F.col("first") < F.col("last")).select("digest", "first", "first_url"), "copies")  # a plain table: else a hot join can't be split
    dealt = rows.join(copies, "digest", "left")
    refers_to = F.when((F.col("size") >= min_bytes) & (F.col("page_id") > F.col("first")), F.col("first"))
    out = dealt.select("page_id", "url", F.when(refers_to.isNull(), F.col("payload")).alias("payload"), refers_to.alias("refers_to"), "first_url", "size", "digest")
    out.write.format("warc").mode("append").option("path", path).save()


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of all archives below a folder; see SCHEMA for the columns."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
