"""Zip archives as a batch Python data source: members are planned from the central directory, keys are pushed down, and a task reads
only the byte ranges of its own members.

spark.read.format("zip-members").load(path): (key long, name, size long, value string) of the members named prefix + digits + .json, the
options being prefix (CIK) and range_bytes. Checksums are verified. path is a file or a folder of .zip files in any store that Arrow's file systems reach.

Defined cases: members of other names are skipped; encrypted members and methods other than stored and deflated are an error; an archive
of any size (zip64) is read, and one without such members gives no rows.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

SCHEMA = "key long, name string, size long, value string"
#: Compressed bytes of a task, unless one member has more.
RANGE_BYTES = 32 << 20
_HEADER = struct.Struct("<4s5H3L2H")


@dataclass
class Range(InputPartition):
    path: str
    #: Of each member: key, name, offset of its header, compressed and full size, method, checksum.
    members: list[tuple[int, str, int, int, int, int, int]]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def directory(path: str, prefix: str) -> list[tuple[int, str, int, int, int, int, int]]:
    """The archive's members with a key, by offset; reads its central directory alone."""
    fs, inside = _store(path)
    out = []
    with fs.open_input_file(inside) as f, zipfile.ZipFile(io.BufferedReader(f, 1 << 20)) as z:
        for x in z.infolist():
            stem = x.filename.rsplit("/", 1)[-1].removesuffix(".json").removeprefix(prefix)
            if x.filename.endswith(".json") and stem.isdigit():
                if x.flag_bits & 1 or x.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                    raise ValueError(f"{path}: {x.filename} is encrypted or of another method than stored and deflated")
                out.append((int(stem), x.filename, x.header_offset, x.compress_size, x.file_size, x.compress_type, x.CRC))
    return sorted(out, key=lambda m: m[2])


class ZipReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]) -> None:
        self.path, self.prefix, self.range = options["path"], options.get("prefix", "CIK"), int(options.get("range_bytes", RANGE_BYTES))
        self.columns, self.keys = columns, None

    def pushFilters(self, filters: list[Filter]):
        """Equality and membership of key choose members before any is read; Spark keeps the other filters."""
        for f in filters:
            own = f.attribute == ("key",) if hasattr(f, "attribute") else False
            if own and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.keys = values if self.keys is None else self.keys & values
            elif not (own and isinstance(f, IsNotNull)):
                yield f

    def partitions(self) -> list[Range]:
        fs, root = _store(self.path)
        scheme = self.path[: len(self.path) - len(root)] if "://" in self.path or self.path.startswith("file:") else ""
        info = fs.get_file_info(root)
        files = [root] if info.is_file else sorted(x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.path.endswith(".zip"))
        out = []
        for file in files:
            ranges, room = [], 0
            for m in directory(scheme + file, self.prefix):
                if self.keys is not None and m[0] not in self.keys:
                    continue
                if not ranges or m[3] > room:
                    ranges.append([])
                    room = self.range
                ranges[-1].append(m)
                room -= m[3]
            out += [Range(scheme + file, r) for r in ranges]
        return out or [Range("", [])]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.members:
            return
        fs, inside = _store(part.path)
        with fs.open_input_file(inside) as f:
            for key, name, at, packed, size, method, crc in part.members:
                value = None
                if "value" in self.columns:
                    # The header's own name and extra field may be longer than the directory's.
                    fields = _HEADER.unpack(f.read_at(_HEADER.size, at))
                    raw = f.read_at(packed, at + _HEADER.size + fields[9] + fields[10])
                    raw = raw if method == zipfile.ZIP_STORED else zlib.decompress(raw, -15)
                    if zlib.crc32(raw) != crc:
                        raise ValueError(f"{part.path}: {name} is damaged")
                    value = raw.decode("utf-8", "replace")
                row = {"key": key, "name": name, "size": size, "value": value}
                yield tuple(row[c] for c in self.columns)


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip-members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(dict(self.options), [f.name for f in schema.fields])


def members(spark: SparkSession, path: str, prefix: str = "CIK", range_bytes: int = RANGE_BYTES, payload: bool = True) -> DataFrame:
    """payload: without it no member is read. Turns on Spark's pushdown to Python sources in this session."""
    spark.dataSource.register(ZipMembers)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("zip-members").option("prefix", prefix).option("range_bytes", range_bytes)
    return (reader if payload else reader.schema("key long, name string, size long")).load(path)
