"""Shared vectorised text primitives: UTF-8 buffers, word bounds, wrapping 64-bit hashes.

All hashes are polynomial hashes modulo 2**64 over randomised byte values, so that a hash of any
slice comes from two prefix sums; ``mix`` then spreads the bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

U64 = np.uint64
MULT = 0x9E3779B97F4A7C15 | 1
MULT2 = 0xD1342543DE82EF95 | 1
MASK = (1 << 64) - 1


#: Rows in a batch between Spark and Python, where the session has Spark's default; long texts need small batches.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix finaliser on uint64 arrays."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: Randomised value of each byte; odd, so no byte counts as nothing.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * U64(MULT)) | U64(1)

#: Space and the control characters 9 to 13.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Powers:
    """Powers of an odd multiplier and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, multiplier: int):
        self.up, self.down = np.ones(1, U64), np.ones(1, U64)
        self.multiplier, self.inverse = multiplier, pow(multiplier, -1, 1 << 64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, self.multiplier, U64))])
            self.down = np.concatenate([np.ones(1, U64), np.cumprod(np.full(size - 1, self.inverse, U64))])
        return self.up[:n], self.down[:n]


BYTE_POWERS, WORD_POWERS, WORD_POWERS2 = Powers(MULT), Powers(0xC2B2AE3D27D4EB4F), Powers(MULT2)
#: A second hash of words that shares nothing with the first.
BYTE_VALUES2, BYTE_POWERS2 = mix(np.arange(301, 557, dtype=np.uint64) * U64(MULT2)) | U64(1), Powers(0xA0761D6478BD642F)


def slice_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hash of values[start:end] for each pair; equal slices give equal hashes wherever they stand."""
    up, down = powers.to(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Returns freed memory to the system, since a worker keeps waiting for tasks beside others of its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        trim(0)


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of whole rows with about ``most`` bytes of a text or binary column each; a longer value comes alone.

    Memory freed since goes back to the system at the end.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        data = batch.column(batch.schema.get_field_index(column))
        size = pc.binary_length(data.cast(pa.large_binary())).fill_null(0).to_numpy(zero_copy_only=False)
        offsets, at = np.append(0, np.cumsum(size)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    give_back()


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and how many words come before each document's first."""
    solid = ~IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    values, powers = (BYTE_VALUES2, BYTE_POWERS2) if second else (BYTE_VALUES, BYTE_POWERS)
    return mix(slice_hashes(values[data], starts, ends, powers))


def run_hashes(hashes: np.ndarray, k: int, powers: Powers = WORD_POWERS) -> np.ndarray:
    """Hash of each k consecutive values, runs across documents included."""
    n = max(0, len(hashes) - k + 1)
    at = np.arange(n)
    return mix(slice_hashes(hashes, at, at + k, powers))


#: Groups up to which a table with a row for each is broadcast.
MANY = 10_000


def sampled(rows: DataFrame, key: Column, most: int, by: str | None = None) -> DataFrame:
    """Of ``rows`` the distinct rows with the smallest hashes of ``key``, about ``most`` and no more, or of each ``by``.

    A threshold on the hash, from a count of distinct keys, lets about four times as many pass whatever the number of
    rows, copies and tasks; they are made distinct, then cut. ``hash`` is the key's, a number from 0 to 1.
    """
    share = (F.conv(F.substring(F.md5(key.cast("string")), 1, 13), 16, 10).cast("double") / float(1 << 52)).alias("hash")
    rows = rows.select("*", share)
    bound = F.least(F.lit(1.0), F.lit(4.0 * most) / F.greatest(F.lit(1), F.approx_count_distinct("hash"))).alias("_bound")
    if by:
        bounds = rows.groupBy(by).agg(bound)
        known = bounds.limit(MANY + 1).collect()
        small = F.broadcast(rows.sparkSession.createDataFrame(known, bounds.schema)) if len(known) <= MANY else bounds
        some = rows.join(small, by).where(F.col("hash") <= F.col("_bound")).drop("_bound").distinct()
    else:
        some = rows.where(F.col("hash") <= rows.agg(bound).first()[0]).distinct()
    order = ["hash", *(c for c in some.columns if c != "hash")]
    if not by:
        return some.orderBy(*order).limit(most)
    return some.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_place") <= most).drop("_place")


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def fresh(frame: DataFrame, name: str) -> str:
    """``name``, with as many marks in front as keep it apart from the frame's columns."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
