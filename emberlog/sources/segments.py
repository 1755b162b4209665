"""Segment files of the older on-disk format: records of a 4-byte big-endian length and a protobuf entry.

A Python data source reads and writes them (``spark.read.format("segments")``). Each file is one partition.
"""

from __future__ import annotations

import glob
import os
import re
import shutil
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schema import LOG_SCHEMA
from ..ship import ship

# Fixed values of the format: the largest record, and field numbers by column.
MAX_RECORD = 64 << 20
FIELD_NUMBERS = {"id": 1, "timestamp_ns": 2, "received_at_ns": 3, "service": 4, "level": 5, "message": 6, "fields": 7, "namespace": 8}
_NAMES = {n: c for c, n in FIELD_NUMBERS.items()}
_SEGMENT_NAME = re.compile(r"\d{20}\.seg")


class CorruptSegment(ValueError):
    """A segment file ends inside a record, or holds a record that can't be read."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise CorruptSegment("bad varint")
        value |= (data[at] & 0x7F) << shift
        shift += 7
        at += 1
        if data[at - 1] < 0x80:
            return value, at


def _wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width fields are passed over."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            value, at = b"", at + (8 if kind == 1 else 4)
        else:
            raise CorruptSegment(f"wire type {kind}")
        if at > len(data):
            raise CorruptSegment("record too short")
        yield tag >> 3, value


def decode(record: bytes) -> tuple:
    """A record as a row of the log columns."""
    row: dict = {"id": "", "timestamp_ns": 0, "received_at_ns": 0, "namespace": "", "service": "", "level": "", "message": "", "fields": {}}
    for number, value in _wire(record):
        name = _NAMES.get(number)
        if name == "fields":
            pair = dict(_wire(value))
            row["fields"][pair.get(1, b"").decode()] = pair.get(2, b"").decode()
        elif isinstance(value, int) and name in ("timestamp_ns", "received_at_ns"):
            row[name] = value - (1 << 64) if value >> 63 else value
        elif isinstance(value, bytes) and name:
            row[name] = value.decode()
    return tuple(row[c] for c in LOG_SCHEMA.fieldNames())


def _packed(number: int, value: int | bytes) -> bytes:
    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 0x7F:
            out.append(x & 0x7F | 0x80)
            x >>= 7
        return bytes([*out, x])

    if isinstance(value, int):
        return varint(number << 3) + varint(value & (1 << 64) - 1)
    return varint(number << 3 | 2) + varint(len(value)) + value


def encode(row: dict) -> bytes:
    out = b""
    for name, number in sorted(FIELD_NUMBERS.items(), key=lambda x: x[1]):
        value = row[name]
        if name == "fields":
            out += b"".join(_packed(number, _packed(1, k.encode()) + _packed(2, v.encode())) for k, v in sorted((value or {}).items()))
        elif value:
            out += _packed(number, value if isinstance(value, int) else value.encode())
    return out


def framed(record: bytes) -> bytes:
    return struct.pack(">I", len(record)) + record


def records(path: str) -> Iterator[bytes]:
    """Records of a file; a clean end is the end, a cut record an error."""
    with open(path, "rb") as file:
        while head := file.read(4):
            size = struct.unpack(">I", head)[0] if len(head) == 4 else -1
            if not 0 <= size <= MAX_RECORD:
                raise CorruptSegment(f"bad record length in {path}")
            body = file.read(size)
            if len(body) < size:
                raise CorruptSegment(f"{path} ends inside a record")
            yield body


@dataclass
class _File(InputPartition):
    path: str


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not os.path.exists(partition.path):  # gone since it was listed: compacted or expired
            return
        name = os.path.basename(partition.path)
        for position, record in enumerate(records(partition.path)):
            yield (*decode(record), name, position)


@dataclass
class _Written(WriterCommitMessage):
    rows: int
    attempt: str
    files: int


class _Writer(DataSourceWriter):
    """Each attempt of a task fills files in a folder of its own, closing one before a record would overfill it. The
    commit alone makes segments of them, numbered after those there are; what a lost attempt left is never read."""

    def __init__(self, folder: str, max_bytes: int):
        self.folder, self.max_bytes = folder, max_bytes

    def commit(self, messages: list) -> None:
        done = [int(name[:20]) for name in os.listdir(self.folder) if _SEGMENT_NAME.fullmatch(name)] if os.path.isdir(self.folder) else []
        number = max(done, default=0)
        for message in filter(None, messages):
            for i in range(message.files):
                number += 1
                os.rename(os.path.join(message.attempt, str(i)), os.path.join(self.folder, f"{number:020d}.seg"))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        for message in filter(None, messages):
            shutil.rmtree(message.attempt, ignore_errors=True)

    def write(self, rows) -> _Written:
        attempt = os.path.join(self.folder, f"_attempt-{uuid.uuid4().hex}")
        os.makedirs(attempt)
        number, size, file, count = 0, 0, None, 0
        for row in rows:
            record = framed(encode(row.asDict(recursive=True)))
            if file is None or size + len(record) > self.max_bytes and size:
                if file:
                    file.close()
                file, size = open(os.path.join(attempt, str(number)), "wb"), 0
                number += 1
            file.write(record)
            size += len(record)
            count += 1
        if file:
            file.close()
        return _Written(count, attempt, number)


class SegmentSource(DataSource):
    """Options: ``path`` (a folder, or one file), ``maxBytes`` for writing."""

    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self) -> StructType:
        return StructType(list(LOG_SCHEMA.fields)).add("segment", "string").add("position", "long")

    def reader(self, schema: StructType) -> DataSourceReader:
        path = self.options["path"]
        return _Reader(sorted(glob.glob(os.path.join(path, "*.seg"))) if os.path.isdir(path) else [path])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], int(self.options.get("maxBytes", 64 << 20)))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(SegmentSource)
    return spark.read.format("segments").option("path", path).load()


def write_segments(df: DataFrame, path: str, max_bytes: int = 64 << 20) -> None:
    ship(df.sparkSession)
    df.sparkSession.dataSource.register(SegmentSource)
    df.select(*LOG_SCHEMA.fieldNames()).write.format("segments").option("path", path).option("maxBytes", str(max_bytes)).mode("append").save()


def checked_name(name: str) -> str:
    """A segment's name, if it is one; paths and other files are refused."""
    if not _SEGMENT_NAME.fullmatch(name):
        raise ValueError(f"not a segment name: {name!r}")
    return name


def export_segment(logs: DataFrame, segment, shard: int, path: str) -> int:
    """Write one shard's entries of a segment as Parquet; an empty selection is refused."""
    own = logs.where((F.col("segment") == segment) & (F.col("shard_id") == shard))
    rows = own.count()
    if not rows:
        raise ValueError(f"segment {segment} holds nothing of shard {shard}")
    own.write.mode("overwrite").parquet(path)
    return rows


def shard_segments(logs: DataFrame, shard: int) -> DataFrame:
    """Segments that hold at least one entry of the shard."""
    return logs.where(F.col("shard_id") == shard).select("segment").distinct()
