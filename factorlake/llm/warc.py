"""WARC archives as a PySpark Python data source.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").load(folder).where("warc_type = 'response'")

Writing: each task makes one archive of gzip members: a warcinfo record and one for each row. Beside it an index holds
the byte offsets where new partitions may begin, every CHUNK_BYTES or so. Tasks write under names of their
own; the commit renames what the successful attempts wrote and deletes what others left, so retries after lost executors
leave no double records. A response holds its HTTP header, then the page; a revisit names the response that it repeats.

Each member's gzip header has the skip-lengths field (`sl`: packed and plain length) of the WARC format.

Reading: one partition for each chunk of each archive, member by member through a window of READ_BYTES. Headers come first:
a record whose type or header values fail a pushed-down predicate is passed over, unread if it is long, and payloads
of the others are unpacked only if wanted: option `payload` is true, `digest` (unpacked, measured and hashed, but not handed on)
or false. warcinfo records are no rows.

Paths are those of the shared folder (file: or any scheme that pyarrow's file systems open), never a
folder of one machine.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from factorlake.llm.shared import fresh_path, written

SCHEMA = "page_id long, url string, warc_type string, record_id string, payload_bytes long, payload_digest string, refers_to long, payload binary"
#: Payloads of fewer bytes are always stored whole.
REVISIT_BYTES = 1000
CHUNK_BYTES, READ_BYTES = 16 << 20, 1 << 20
#: Digests that occur again are broadcast up to so many, a row of some 60 bytes each; more are joined by a shuffle of the pages.
MOST_AGAIN = 300_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADERS = {"page_id": "WARC-Page-ID", "url": "WARC-Target-URI", "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "payload_bytes": "WARC-Payload-Length", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To-Page-ID"}
_MEMBER = struct.Struct("<4sI2sH2sHII")
_LONGS = ("page_id", "payload_bytes", "refers_to")


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def _header_value(text: str) -> str:
    """Header values are one line: what would break it is percent-encoded, and % too, so it can be undone."""
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _undo(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def response_id(page_id: int | None, digest: str) -> str:
    """Of the response of a page: a function of both, so that revisits can name it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{digest}'.encode()).digest(), version=4)}>"


def record(fields: dict, payload: bytes, date: str) -> bytes:
    """fields: the values of _HEADERS' columns; the payload digest is bare hex."""
    kind, digest = fields["warc_type"], fields["payload_digest"]
    fields = {"record_id": response_id(fields.get("page_id"), digest) if kind == "response" else f"<urn:uuid:{uuid.uuid4()}>"} | {k: v for k, v in fields.items() if v is not None}
    more, body = {"WARC-Date": date}, b""
    if digest:
        fields["payload_digest"] = f"sha1:{digest}"
    if kind == "response":
        more["Content-Type"] = "application/http; msgtype=response"
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    elif kind == "revisit":
        more |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": response_id(fields["refers_to"], digest)}
    elif kind == "warcinfo":
        more["Content-Type"], body = "application/warc-fields", b"format: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", *[f"{_HEADERS[k]}: {_header_value(str(v))}" for k, v in fields.items() if k in _HEADERS and v is not None], *[f"{k}: {v}" for k, v in more.items()], f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def packed(plain: bytes) -> bytes:
    """One gzip member whose header tells its packed and plain lengths."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(plain) + packer.flush()
    size = _MEMBER.size + len(body) + 8
    return _MEMBER.pack(b"\x1f\x8b\x08\x04", 0, b"\0\xff", 12, b"sl", 8, size, len(plain) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def told_length(head: bytes) -> int | None:
    """Bytes of the gzip member that begins so, if its header tells."""
    return _MEMBER.unpack_from(head)[6] if len(head) >= _MEMBER.size and head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"sl" else None


class _Window:
    """Bytes of an open file, READ_BYTES at a time."""

    def __init__(self, file) -> None:
        self.file, self.start, self.data = file, 0, b""

    def get(self, at: int, n: int) -> bytes:
        if not self.start <= at <= at + n <= self.start + len(self.data):
            self.file.seek(at)
            self.start, self.data = at, self.file.read(max(n, READ_BYTES))
        return self.data[at - self.start : at - self.start + n]


class _Member:
    """The gzip member at `at`, unpacked as far as asked."""

    def __init__(self, window: _Window, at: int) -> None:
        self.window, self.at, self.packer = window, at, zlib.decompressobj(31)
        self.size = told_length(window.get(at, _MEMBER.size))

    def more(self, most: int = 1 << 16) -> bytes:
        """Further plain bytes; none at the end."""
        out = b""
        while not out and not self.packer.eof:
            fed = self.packer.unconsumed_tail
            if not fed:
                fed = self.window.get(self.at, 1 << 14)
                self.at += len(fed)
                if not fed:
                    raise ValueError("a member ends early")
            out = self.packer.decompress(fed, most)
        return out

    def end(self, start: int) -> int:
        """Where the next member begins."""
        if self.size is not None:
            return start + self.size
        while self.more():
            pass
        return self.at - len(self.packer.unused_data)


def parse_headers(block: bytes) -> dict:
    """The known fields of a header block, by column name, and `length`."""
    given = dict(line.split(": ", 1) for line in block.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    out: dict = {k: _undo(given[h]) if h in given else None for k, h in _HEADERS.items()}
    out |= {k: int(out[k]) for k in _LONGS if out[k] is not None}
    if out["payload_digest"]:
        out["payload_digest"] = out["payload_digest"].removeprefix("sha1:")
    return out | {"length": int(given["Content-Length"]), "http": given.get("Content-Type", "").startswith("application/http")}


@dataclass
class Chunk(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Archive(WriterCommitMessage):
    name: str
    records: int


class WarcReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.payload, self.columns = options["path"], options.get("payload", "true"), columns
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        """Equality on any header column is tested while headers are parsed; Spark keeps the others."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in _HEADERS and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            elif not (column in _HEADERS and isinstance(f, IsNotNull) and column in self.wanted):
                yield f

    def partitions(self) -> list[Chunk]:
        fs, root = _store(self.path)
        out = []
        for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if x.path.endswith(".idx"):
                with fs.open_input_stream(x.path) as f:
                    cuts = json.loads(f.read())
                out += [Chunk(x.path.removesuffix(".idx"), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out or [Chunk("", 0, 0)]

    def read(self, chunk: Chunk) -> Iterator[tuple]:
        if not chunk.path:
            return
        fs, _ = _store(self.path)
        with fs.open_input_file(chunk.path) as f:
            window, at = _Window(f), chunk.start
            while at < chunk.end:
                member, head = _Member(window, at), b""
                while b"\r\n\r\n" not in head and (piece := member.more(4096)):
                    head += piece
                block, _, rest = head.partition(b"\r\n\r\n")
                fields = parse_headers(block)
                if fields["warc_type"] != "warcinfo" and all(fields[k] in v for k, v in self.wanted.items()):
                    body = None
                    if self.payload != "false" and fields["warc_type"] == "response":
                        pieces, n = [rest], len(rest)
                        while n < fields["length"]:
                            pieces.append(member.more())
                            n += len(pieces[-1])
                        body = b"".join(pieces)[: fields["length"]]
                        if fields["http"]:
                            body = body.partition(b"\r\n\r\n")[2]
                        fields["payload_bytes"], fields["payload_digest"] = len(body), hashlib.sha1(body).hexdigest()
                    yield tuple((body if self.payload == "true" else None) if k == "payload" else fields[k] for k in self.columns)
                at = member.end(at)


class WarcWriter(DataSourceWriter):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.columns, self.chunk = options["path"], columns, int(options.get("chunk_bytes", CHUNK_BYTES))
        self.job, self.date = uuid.uuid4().hex, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)

    def write(self, rows: Iterator) -> Archive:
        fs, root = _store(self.path)
        name = f"part-{self.job}-{uuid.uuid4().hex}.warc.gz"
        cuts, at, n = [0], 0, 0
        with fs.open_output_stream(f"{root}/_{name}", compression=None) as f:
            at += f.write(packed(record({"warc_type": "warcinfo", "payload_digest": None}, b"", self.date)))
            for row in rows:
                x = dict(zip(self.columns, row, strict=True))
                at += f.write(packed(record(x, bytes(x.pop("payload", None) or b""), self.date)))
                n += 1
                if at - cuts[-1] >= self.chunk:
                    cuts.append(at)
        if cuts[-1] != at:
            cuts.append(at)
        with fs.open_output_stream(f"{root}/_{name}.idx") as f:
            f.write(json.dumps(cuts).encode())
        return Archive(name, n)

    def commit(self, messages: list[Archive | None]) -> None:
        fs, root = _store(self.path)
        for m in messages:
            if m:
                for end in ("", ".idx"):
                    fs.move(f"{root}/_{m.name}{end}", f"{root}/{m.name}{end}")
        self.abort([])

    def abort(self, messages: list[Archive | None]) -> None:
        """Deletes what this write has left under temporary names, failed attempts' files too."""
        fs, root = _store(self.path)
        for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(f"_part-{self.job}-"):
                fs.delete_file(x.path)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options), [f.name for f in schema.fields])

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), [f.name for f in schema.fields])


def records_of(pages: DataFrame) -> DataFrame:
    """One record per row of pages. Of equal payloads of at least REVISIT_BYTES the one with the largest
    page_id is the response and the others revisit it without a payload.

    Digests are counted on narrow rows. Those that occur again are broadcast if they are at most MOST_AGAIN, so that no payload is
    shuffled. Defined cases: null html is an empty
    payload; a null page_id never wins against a number and two rows that tie for the
    largest page_id are both responses; an empty table gives no records.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    again = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1")
    again = written(again.select("payload_digest", "largest"), "warc-again")
    both = rows.join(F.broadcast(again) if again.count() <= MOST_AGAIN else again, "payload_digest", "left")
    revisits = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return both.select(
        "page_id", "url", F.when(revisits, F.lit("revisit")).otherwise(F.lit("response")).alias("warc_type"), "payload_bytes", "payload_digest",
        F.when(revisits, F.col("largest")).alias("refers_to"), F.when(~revisits, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, path: str) -> None:
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").option("path", path).save()


def read(spark, path: str, payload: str = "true") -> DataFrame:
    """payload: true, digest or false, see above. Turns on Spark's pushdown to Python sources in this session."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", payload).load(path)


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages as WARC archives in the shared folder and reads them back: digests and lengths of responses
    are computed from the payloads read, those of revisits come from their headers, for which no payload is unpacked."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(records_of(pages), path)
    both = read(spark, path, "digest").where("warc_type = 'response'").unionByName(read(spark, path, "false").where("warc_type = 'revisit'"))
    return both.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to", "url", "record_id")
