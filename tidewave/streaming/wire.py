"""Wire frames of PCM and JSON lines of poses and windows."""

from __future__ import annotations

import json
import socket
import struct
from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewave.errors import SessionError, TruncatedFrameError, WireError, WireFormatError

# The header of a frame is magic, version, rate, nanoseconds of the first sample, number of samples.
HEADER = struct.Struct("<4sBIQH")
MAGIC, VERSION, MOST = b"WSAR", 1, 4096


def encode(samples: np.ndarray, timestamp_ns: int, rate: int) -> bytes:
    x = np.asarray(samples)
    if x.ndim != 1 or not 1 <= len(x) <= MOST or timestamp_ns < 0 or rate <= 0:
        raise WireError("a frame has 1 to 4096 samples, no negative time and a positive rate")
    return HEADER.pack(MAGIC, VERSION, rate, timestamp_ns, len(x)) + x.astype("<i2").tobytes()


def decode(data: bytes) -> tuple[np.ndarray, int, int]:
    """(samples, timestamp_ns, rate) of exactly one frame."""
    if len(data) < HEADER.size:
        raise WireError("shorter than a header")
    magic, version, rate, ns, n = HEADER.unpack_from(data)
    if magic != MAGIC or version != VERSION or rate == 0 or not 1 <= n <= MOST or len(data) != HEADER.size + 2 * n:
        raise WireError("not a frame of this version and length")
    return np.frombuffer(data, "<i2", n, HEADER.size), ns, rate


def receive(conn: socket.socket) -> bytes | None:
    """The next frame; None at an end between frames, an error at an end inside one."""

    def exactly(n: int, first: bool) -> bytes | None:
        out = b""
        while len(out) < n:
            part = conn.recv(n - len(out))
            if not part:
                if first and not out:
                    return None
                raise TruncatedFrameError(f"{len(out)} of {n} bytes")
            out += part
        return out

    head = exactly(HEADER.size, True)
    if head is None:
        return None
    n = HEADER.unpack(head)[4]
    if head[:4] != MAGIC or not 1 <= n <= MOST:
        raise WireError("no frame starts here")
    return head + exactly(2 * n, False)


def consume(conn: socket.socket, on_packet) -> int:
    """Feeds all frames of a connection to ``on_packet``; the count of packets, or SessionError with it."""
    packets = 0
    try:
        while (data := receive(conn)) is not None:
            on_packet(*decode(data))
            packets += 1
    except (WireError, OSError) as e:
        raise SessionError(str(e), packets) from e
    return packets


def encode_column(samples: Column, timestamp_ns: Column, rate: Column) -> Column:
    @F.arrow_udf("binary")
    def run(x: pa.Array, t: pa.Array, r: pa.Array) -> pa.Array:
        return pa.array([encode(np.array(a, np.int16), b, c) for a, b, c in zip(x.to_pylist(), t.to_pylist(), r.to_pylist(), strict=True)], pa.binary())

    return run(samples, timestamp_ns.cast("long"), rate.cast("int"))


def decode_column(data: Column) -> Column:
    kind = pa.struct([("samples", pa.list_(pa.int16())), ("timestamp_ns", pa.int64()), ("sample_rate", pa.int32())])

    @F.arrow_udf("struct<samples:array<smallint>,timestamp_ns:bigint,sample_rate:int>")
    def run(x: pa.Array) -> pa.Array:
        rows = [decode(b) for b in x.to_pylist()]
        return pa.array([{"samples": a.tolist(), "timestamp_ns": t, "sample_rate": r} for a, t, r in rows], kind)

    return run(data)


POSE = "type string, version int, timestamp_s double, source_timestamp_s double, model_id string, calibration_minutes double, frame string, joints array<array<double>>"
CAPTURE = "type string, version int, timestamp_s double, sample_rate int, shape array<int>, features array<float>"


def pose_json(pose: Column, timestamp_s: Column, source_timestamp_s: Column, model: Column, minutes: Column) -> Column:
    joints = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda j: F.slice(pose, (3 * j + 1).cast("int"), 3))
    return F.to_json(F.struct(F.lit("pose").alias("type"), F.lit(1).alias("version"), timestamp_s.alias("timestamp_s"), source_timestamp_s.alias("source_timestamp_s"), model.alias("model_id"), minutes.alias("calibration_minutes"), F.lit("wrist-relative").alias("frame"), joints.alias("joints")))


def parse_pose(line: Column) -> Column:
    """Struct of a valid pose line, null for any other."""
    p = F.from_json(line, POSE)
    good = (p["type"] == "pose") & (p["version"] == 1) & (p["frame"] == "wrist-relative") & (F.size(p["joints"]) == 21) & F.forall(p["joints"], lambda j: (F.size(j) == 3) & F.forall(j, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return F.when(F.coalesce(good, F.lit(False)), p)


def capture_json(features: Column, timestamp_s: Column, rate: Column, shape: tuple[int, int, int]) -> Column:
    return F.to_json(F.struct(F.lit("capture").alias("type"), F.lit(1).alias("version"), timestamp_s.alias("timestamp_s"), rate.alias("sample_rate"), F.array(*map(F.lit, shape)).alias("shape"), features.alias("features")))


def parse_capture(line: Column) -> Column:
    p = F.from_json(line, CAPTURE)
    good = (p["type"] == "capture") & (p["version"] == 1) & (F.size(p["shape"]) == 3) & (p["shape"][0] == 2)
    return F.when(F.coalesce(good, F.lit(False)), p)


def require_capture(line: str) -> dict:
    """A capture line as a dict; any other type, version or number of features is refused."""
    try:
        data = json.loads(line)
    except ValueError as e:
        raise WireFormatError(str(e)) from e
    shape = data.get("shape") if isinstance(data, dict) else None
    if not shape or data.get("type") != "capture" or data.get("version") != 1 or len(shape) != 3 or len(data.get("features", ())) != int(np.prod(shape)):
        raise WireFormatError("not a capture frame of this version and shape")
    return data


def scene_axes(joint: Column) -> Column:
    """A joint in the axes of a viewer whose z points up."""
    return F.array(joint[0], -joint[2], joint[1])


class Sink(ABC):
    """Takes rows of pose or capture frames, one at a time."""

    @abstractmethod
    def emit(self, row: dict) -> None: ...


class LineSink(Sink):
    """One compact JSON line a row, flushed at once."""

    def __init__(self, file):
        self.file = file

    def emit(self, row: dict) -> None:
        self.file.write(json.dumps(row, separators=(",", ":")) + "\n")
        self.file.flush()


class JsonLines:
    """foreachBatch sink that appends one JSON line a row to a folder that all executors share."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batch, batch_id: int) -> None:
        batch.selectExpr("to_json(struct(*)) AS value").write.mode("append").text(self.folder)


class TcpLines:
    """Row writer for ``writeStream.foreach``: JSON lines to a socket, opened at the first row, closed on errors."""

    def __init__(self, host: str, port: int):
        self.host, self.port, self.conn = host, port, None

    def open(self, partition_id: int, epoch_id: int) -> bool:
        return True

    def process(self, row) -> None:
        try:
            if self.conn is None:
                self.conn = socket.create_connection((self.host, self.port))
            self.conn.sendall(json.dumps(row.asDict(True), separators=(",", ":")).encode() + b"\n")
        except OSError:
            self.close(None)
            raise

    def close(self, error) -> None:
        if self.conn is not None:
            self.conn.close()
            self.conn = None
