"""Packets as a replayable streaming source, and lines that appear once for each batch.

A socket cannot be read twice, so packets go to a log first: ``PacketLog`` appends wire frames and when they arrived to
segments of a folder that all executors share, ``record`` feeds it from a connection. Times in packets are of the
sender's own clock; arrivals are of the host's, which all streams have in common, and are the event time. A segment gets its name, which says its stream and
numbers, when it is whole. ``spark.readStream.format("pcm_packets")`` reads segments in tasks; its offsets are the
packets of each stream that were there, so a batch that runs again reads the same packets. ``spark.read`` gives all.

``writeStream.format("once_lines")`` writes the text column ``value``: tasks write below ``_pending``, and the commit of a batch moves
its part to ``batch-<number>`` in one step. A batch that is there already, since the query died before it noted it,
is left as it is.
"""

from __future__ import annotations

import re
import struct
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, InputPartition, WriterCommitMessage

from tidewave.errors import SessionError, WireError
from tidewave.streaming import wire

SCHEMA = "stream_id string, seq bigint, timestamp_ns bigint, sample_rate int, samples array<smallint>, arrived timestamp"
ARRIVED = struct.Struct("<Q")
SEGMENT = re.compile(r"(\d{12})-(\d{12})\.pcm")
#: Packets of a segment, and of a batch of rows.
PER_SEGMENT, PER_BATCH = 256, 128


def _store(path: str) -> tuple[fs.FileSystem, str]:
    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return store, inner.rstrip("/")


class PacketLog:
    """Appends packets of one stream to segments below ``folder/stream_id``; numbers go on where the log ends."""

    def __init__(self, folder: str, stream_id: str, per_segment: int = PER_SEGMENT):
        if not re.fullmatch(r"[\w.-]+", stream_id):
            raise ValueError("a stream is named by letters, digits, dots and dashes")
        self.folder, self.stream, self.per_segment = f"{folder.rstrip('/')}/{stream_id}", stream_id, per_segment
        self.store, self.inner = _store(self.folder)
        self.store.create_dir(self.inner, recursive=True)
        self.next = max((last + 1 for _, last, _ in segments(self.store, self.inner)), default=0)
        self.held: list[bytes] = []

    def append(self, frame: bytes, arrived_ns: int | None = None) -> None:
        wire.decode(frame)
        self.held.append(ARRIVED.pack(time.time_ns() if arrived_ns is None else arrived_ns) + frame)
        if len(self.held) >= self.per_segment:
            self.flush()

    def flush(self) -> None:
        """Makes what is held a segment."""
        if not self.held:
            return
        name = f"{self.next:012d}-{self.next + len(self.held) - 1:012d}.pcm"
        part = f"{self.inner}/_{uuid.uuid4().hex}"
        with self.store.open_output_stream(part) as file:
            file.write(b"".join(self.held))
        self.store.move(part, f"{self.inner}/{name}")
        self.next, self.held = self.next + len(self.held), []


def record(conn, log: PacketLog) -> int:
    """Logs all packets of a connection; the count, or SessionError with it. What came whole is kept either way."""
    packets = 0
    try:
        while (frame := wire.receive(conn)) is not None:
            log.append(frame)
            packets += 1
    except (WireError, OSError) as e:
        raise SessionError(str(e), packets) from e
    finally:
        log.flush()
    return packets


def segments(store: fs.FileSystem, inner: str) -> list[tuple[int, int, str]]:
    """(first, last, path) of the segments of one stream, in order."""
    found = []
    for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
        if m := SEGMENT.fullmatch(f.base_name):
            found.append((int(m[1]), int(m[2]), f.path))
    return sorted(found)


class PcmPackets(DataSource):
    """Option ``path``: the folder of the log; ``stream``: one stream of it."""

    @classmethod
    def name(cls) -> str:
        return "pcm_packets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PacketBatchReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PacketStreamReader(self.options)


class _Log:
    def __init__(self, options):
        self.path, self.only = options["path"], options.get("stream")

    def streams(self) -> dict[str, list[tuple[int, int, str]]]:
        store, inner = _store(self.path)
        names = [f.base_name for f in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)) if f.type is fs.FileType.Directory]
        return {n: segments(store, f"{inner}/{n}") for n in sorted(names) if self.only in (None, n)}

    def between(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        """A partition for each segment that holds packets from ``start`` on and before ``end``."""
        out = []
        for stream, found in self.streams().items():
            a, b = start.get(stream, 0), end.get(stream, 0)
            out += [InputPartition((stream, path, first, max(a, first), min(b, last + 1))) for first, last, path in found if first < b and last >= a]
        return out

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        stream, path, first, a, b = partition.value
        store, _ = _store(self.path)
        with store.open_input_file(path) as file:
            data = file.read()
        at, rows = 0, []
        for seq in range(first, b):
            (arrived,) = ARRIVED.unpack_from(data, at)
            at += ARRIVED.size
            size = wire.HEADER.size + 2 * wire.HEADER.unpack_from(data, at)[4]
            if seq >= a:
                samples, ns, rate = wire.decode(data[at : at + size])
                rows.append((seq, ns, rate, samples, arrived // 1000))
            at += size
            if len(rows) == PER_BATCH or seq == b - 1 and rows:
                yield self._batch(stream, rows)
                rows = []

    @staticmethod
    def _batch(stream: str, rows: list[tuple]) -> pa.RecordBatch:
        seq, ns, rate, samples, arrived = zip(*rows, strict=True)
        ends = np.concatenate([[0], np.cumsum([len(x) for x in samples])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(samples), pa.int16()))
        return pa.record_batch([pa.array([stream] * len(seq)), pa.array(seq, pa.int64()), pa.array(ns, pa.int64()), pa.array(rate, pa.int32()), lists, pa.array(arrived, pa.timestamp("us", "UTC"))], names=[c.split(" ")[0] for c in SCHEMA.split(", ")])


class PacketBatchReader(_Log, DataSourceReader):
    def partitions(self):
        end = {s: found[-1][1] + 1 for s, found in self.streams().items() if found}
        return self.between({}, end) or [InputPartition(None)]

    def read(self, partition):
        return iter(()) if partition.value is None else super().read(partition)


class PacketStreamReader(_Log, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {s: found[-1][1] + 1 for s, found in self.streams().items() if found}

    def partitions(self, start: dict, end: dict):
        return self.between(start, end)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Part(WriterCommitMessage):
    path: str
    lines: int


class OnceLines(DataSource):
    """Option ``path``: the folder; the frame must have one text column ``value``."""

    @classmethod
    def name(cls) -> str:
        return "once_lines"

    def schema(self) -> str:
        return "value string"

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        if [f.name for f in schema.fields] != ["value"]:
            raise WireError("lines are one column, value")
        return LineWriter(self.options["path"])


class LineWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def write(self, iterator) -> WriterCommitMessage:
        store, inner = _store(self.path)
        path, n = f"{inner}/_pending/{uuid.uuid4().hex}", 0
        store.create_dir(f"{inner}/_pending", recursive=True)
        with store.open_output_stream(path) as file:
            for row in iterator:
                file.write(row[0].encode() + b"\n")
                n += 1
        return Part(path, n)

    def commit(self, messages, batchId: int) -> None:
        store, inner = _store(self.path)
        parts = [m for m in messages if m is not None]
        target = f"{inner}/batch-{batchId:012d}"
        if store.get_file_info(target).type is fs.FileType.NotFound:
            staged = f"{inner}/_pending/batch-{uuid.uuid4().hex}"
            store.create_dir(staged, recursive=True)
            for i, m in enumerate(p for p in parts if p.lines):
                store.move(m.path, f"{staged}/part-{i:05d}.jsonl")
            store.move(staged, target)
        self._forget(store, parts)

    def abort(self, messages, batchId: int) -> None:
        store, _ = _store(self.path)
        self._forget(store, [m for m in messages if m is not None])

    @staticmethod
    def _forget(store: fs.FileSystem, parts: list[Part]) -> None:
        for m in parts:
            if store.get_file_info(m.path).type is not fs.FileType.NotFound:
                store.delete_file(m.path)


def register(spark) -> None:
    for source in (PcmPackets, OnceLines):
        spark.dataSource.register(source)
