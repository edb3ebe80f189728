"""Operator 2: media columns. Bytes are stored as PNG images and read back by a numpy decoder.

``encode_png`` writes 8-bit grey images: signature, IHDR, IDAT chunks over one zlib stream, IEND, each with its
checksum. ``decode_png`` tests every checksum, inflates, and undoes all five scan-line filters in numpy.
``dct_hash`` averages an image to 32 x 32 cells and keeps the signs of its 8 x 8 lowest cosine frequencies against
their median: 64 bits as 16 hexadecimal digits.

Defined results: null and empty texts give one row of 64 zero samples; equal texts give equal values whatever
their row; extra columns are ignored; an empty table gives no rows. Each row is handled alone, so memory is
bounded by one portion of about 1 MB of text or one longer text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewave.llm.common import portions, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
CHUNK = 1 << 20
SIDE, KEPT = 32, 8
_k = np.arange(KEPT)[:, None] * (2 * np.arange(SIDE)[None, :] + 1)
COSINES = np.cos(np.pi * _k / (2 * SIDE))


class MediaError(ValueError):
    """A stored image is damaged."""


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    """``data`` and bytes 0 up to a positive multiple of ``unit``."""
    return data + bytes(-len(data) % unit if data else unit)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = WIDTH, filter_type: int | None = None) -> bytes:
    """Payload as rows of ``width`` grey samples; None takes the filter 0, 1 or 2 with the smallest sum of signed sizes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    kinds = {0: lambda: rows, 1: lambda: np.diff(rows, axis=1, prepend=np.uint8(0)), 2: lambda: np.diff(rows, axis=0, prepend=np.zeros((1, width), np.uint8))}
    if filter_type is None:
        made = {k: f() for k, f in kinds.items()}
        filter_type = min(made, key=lambda k: (int(np.abs(made[k].view(np.int8).astype(np.int32)).sum()), k))
        lines = made[filter_type]
    else:
        lines = kinds[filter_type]()
    raw = np.empty((len(rows), width + 1), np.uint8)
    raw[:, 0], raw[:, 1:] = filter_type, lines
    packed = zlib.compress(raw.tobytes(), 6)
    idat = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)) + idat + _chunk(b"IEND", b"")


def unfilter(raw: np.ndarray) -> np.ndarray:
    """Samples from scan lines whose first byte names their filter (one byte a sample)."""
    kinds, lines = raw[:, 0], raw[:, 1:]
    if not kinds.any():
        return lines
    if (kinds == 1).all():
        return np.cumsum(lines, axis=1, dtype=np.uint8)
    if (kinds == 2).all():
        return np.cumsum(lines, axis=0, dtype=np.uint8)
    out, above = np.empty_like(lines), np.zeros(lines.shape[1], np.uint8)
    for i, (kind, line) in enumerate(zip(kinds, lines, strict=True)):
        if kind == 0:
            above = line
        elif kind == 1:
            above = np.cumsum(line, dtype=np.uint8)
        elif kind == 2:
            above = line + above
        elif kind in (3, 4):
            row, left, corner = np.empty_like(line), 0, 0
            for j, x in enumerate(line.tolist()):
                up = int(above[j])
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    guess = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
                left, corner = (x + guess) & 255, up
                row[j] = left
            above = row
        else:
            raise MediaError(f"unknown filter {kind}")
        out[i] = above
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Grey samples as (height, width); raises MediaError for damaged or other images."""
    if media[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at, head, packed, ended = 8, None, [], False
    while at < len(media):
        if at + 12 > len(media):
            raise MediaError("cut chunk")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) != n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(body, zlib.crc32(kind))):
            raise MediaError(f"bad checksum in {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
            break
        elif kind[0] < 97:
            raise MediaError(f"unknown critical chunk {kind!r}")
    if not (head and ended) or head[2:] != (8, 0, 0, 0, 0):
        raise MediaError("not a whole 8-bit grey image without interlace")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != head[1] * (head[0] + 1):
        raise MediaError("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(head[1], head[0] + 1))


def dct_hash(image: np.ndarray) -> str:
    """Sign of each of the 8 x 8 lowest frequencies above their median, without the mean's own, as hexadecimal."""
    small = image.astype(np.float64)
    for axis in (0, 1):
        n = small.shape[axis]
        edges = np.arange(SIDE) * n // SIDE
        if n >= SIDE:
            counts = np.diff(np.append(edges, n))
            small = np.add.reduceat(small, edges, axis=axis) / (counts[:, None] if axis == 0 else counts[None, :])
        else:
            small = np.take(small, edges, axis=axis)
    low = np.round((COSINES @ small @ COSINES.T).ravel(), 6)
    return np.packbits(low > np.median(low[1:])).tobytes().hex()


FIELDS = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): every text as a PNG image in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            raw = [(x or "").encode() for x in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode_png(pad(x)) for x in raw], pa.binary())], names=["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text").mapInArrow(run, f"key {kind}, n_bytes bigint, media binary").withColumnRenamed("key", key)


def features(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads the binary column of ``store`` back and describes payload, stored form and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "media"):
            rows = []
            for blob in part.column(2):  # one image is inflated at a time
                blob = blob.as_py()
                image = decode_png(blob)
                payload = image.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(blob), hashlib.sha256(blob).hexdigest(), dct_hash(image)))
            yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS[2:], strict=True))], names=["key", *(n for n, _ in FIELDS[1:])])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, "n_bytes", "media").mapInArrow(run, f"key {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string").withColumnRenamed("key", key)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))
