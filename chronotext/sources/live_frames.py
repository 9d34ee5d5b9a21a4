"""A streaming source of live frames: session files that grow while clients speak, read from where the last micro-batch ended.

A session is one file, `<session>.frames`, to which frames are appended. A frame is a head of 13 bytes (payload bytes as an
unsigned 32-bit number, a kind, milliseconds since 1970 as a signed 64-bit number, all little-endian) and its payload: 32-bit
floats for audio, JSON text for a start, nothing for a flush or stop. Offsets are bytes by file, always between frames, so a
frame whose tail is still to come waits for the next micro-batch, and a restart from a checkpoint reads exactly what follows.
A frame's `seq` is the byte at which it begins.

Files must be on a folder that the driver and all executors mount; Spark's own file sources do not follow a growing file.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

HEAD = struct.Struct("<IBq")
KINDS = ["audio", "start", "flush", "stop"]
SCHEMA = "session_id string, seq long, ts timestamp, kind string, samples array<float>, message string"
_ARROW = pa.schema([("session_id", pa.string()), ("seq", pa.int64()), ("ts", pa.timestamp("us", tz="UTC")), ("kind", pa.string()), ("samples", pa.list_(pa.float32())), ("message", pa.string())])
SUFFIX = ".frames"


def frame(kind: str, at_ms: int, payload: bytes = b"") -> bytes:
    """A frame's bytes; for audio the payload is its samples as little-endian 32-bit floats."""
    return HEAD.pack(len(payload), KINDS.index(kind), at_ms) + payload


@dataclass
class Range(InputPartition):
    """Whole frames of a file, from one byte to another."""

    path: str
    begin: int
    end: int


def whole_frames(path: str, begin: int, most: int) -> int:
    """Where the last whole frame ends that begins within `most` bytes of `begin`; a frame of unknown kind ends what can be read."""
    at, size = begin, os.path.getsize(path)
    with open(path, "rb") as f:
        while at + HEAD.size <= size and at - begin < most:
            f.seek(at)
            length, kind, _ = HEAD.unpack(f.read(HEAD.size))
            if kind >= len(KINDS):
                raise ValueError(f"no frame begins at byte {at} of {path}")
            if at + HEAD.size + length > size:
                break
            at += HEAD.size + length
    return at


def read_range(part: Range, batch_rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Frames as Arrow batches of at most `batch_rows` rows."""
    session, out = Path(part.path).name.removesuffix(SUFFIX), []
    with open(part.path, "rb") as f:
        f.seek(part.begin)
        at = part.begin
        while at < part.end:
            length, kind, ms = HEAD.unpack(f.read(HEAD.size))
            payload = f.read(length)
            samples = list(struct.unpack(f"<{length // 4}f", payload[: length // 4 * 4])) if kind == 0 else None
            out.append({"session_id": session, "seq": at, "ts": ms * 1000, "kind": KINDS[kind], "samples": samples, "message": payload.decode("utf-8", "replace") if kind == 1 else None})
            at += HEAD.size + length
            if len(out) == batch_rows:
                yield pa.RecordBatch.from_pylist(out, _ARROW)
                out = []
    if out:
        yield pa.RecordBatch.from_pylist(out, _ARROW)


class _Folder:
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path") or ""
        if not self.path:
            raise ValueError("live frames need a path")
        self.most = int(options.get("maxbytesperfile", options.get("maxBytesPerFile", 1 << 26)))
        self.split = int(options.get("splitbytes", options.get("splitBytes", 1 << 24)))

    def files(self) -> list[str]:
        return sorted(e.name for e in os.scandir(self.path) if e.is_file() and e.name.endswith(SUFFIX) and not e.name.startswith("."))

    def ranges(self, start: dict, end: dict) -> list[Range]:
        """What came between two offsets, long parts split between frames."""
        out = []
        for name in sorted(end):
            path, at = os.path.join(self.path, name), start.get(name, 0)
            while at < end[name]:
                stop = min(end[name], whole_frames(path, at, self.split))
                out.append(Range(path, at, stop))
                at = stop
        return out

    def ends(self, start: dict, most: int) -> dict:
        return {name: whole_frames(os.path.join(self.path, name), start.get(name, 0), most) for name in self.files()}


class FramesStream(DataSourceStreamReader):
    """Each micro-batch takes at most `maxBytesPerFile` of each file (64 MB unless said otherwise), but for the first after a
    start: a source does not learn from where it starts before it has said how far it could read, and offsets never go back."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.known = _Folder(options), None

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        # a file that is gone keeps its offset as long as the query runs, so that it is not read anew if it comes back
        self.known = self.folder.ends({}, 1 << 62) if self.known is None else self.known | self.folder.ends(self.known, self.folder.most)
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.folder.ranges(start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition)

    def commit(self, end: dict) -> None:
        pass


class FramesTable(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = _Folder(options)

    def partitions(self) -> list[Range]:
        return self.folder.ranges({}, self.folder.ends({}, 1 << 62)) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return read_range(partition) if partition.path else iter([pa.RecordBatch.from_pylist([], _ARROW)])


class LiveFrames(DataSource):
    """`spark.read` or `spark.readStream` with format("live_frames"): a row for each frame (SCHEMA)."""

    @classmethod
    def name(cls) -> str:
        return "live_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FramesTable:
        return FramesTable(self.options)

    def streamReader(self, schema) -> FramesStream:
        return FramesStream(self.options)


def frames(spark: SparkSession, path: str, stream: bool = True, **options: str) -> DataFrame:
    """The frames of a folder, as they come or as they stand."""
    spark.dataSource.register(LiveFrames)
    reader = (spark.readStream if stream else spark.read).format("live_frames").option("path", path)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def append(path: str, session: str, parts: Iterable[bytes]) -> None:
    """Adds frames to a session's file."""
    with open(os.path.join(path, session + SUFFIX), "ab") as f:
        for p in parts:
            f.write(p)
