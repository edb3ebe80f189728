"""A Spark data source for .npy matrices of which a column (or a row) is a moment: ``spark.read.format("npy_columns")``.

Options: ``path`` of one file; ``axis`` ("columns" or "rows"); ``rows``, the number of rows that must be there;
``columns_per_partition``. Files are opened through pyarrow's file systems, so a path may be local or on any store that
they know; each partition reads the ranges of its own moments. Values must be 32-bit floats.
"""

from __future__ import annotations

import ast
import struct
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewave.errors import DatasetError


def open_file(path: str):
    store, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    return store.open_input_file(inner)


class NpyColumns(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_columns"

    def schema(self) -> str:
        return "frame_idx bigint, samples array<float>"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options)


def header(file) -> tuple[tuple[int, ...], bool, str, int]:
    """(shape, column order, type, where values begin) of an open .npy file."""
    if file.read(6) != b"\x93NUMPY":
        raise DatasetError("not a .npy file")
    major = file.read(2)[0]
    size, n = ("<H", 2) if major == 1 else ("<I", 4)
    (length,) = struct.unpack(size, file.read(n))
    said = ast.literal_eval(file.read(length).decode("latin1"))
    return tuple(said["shape"]), bool(said["fortran_order"]), said["descr"], 8 + n + length


@dataclass(frozen=True)
class Matrix:
    """Where the moments of a .npy file are: its shape, which axis a moment is on, and where its values begin."""

    rows: int
    columns: int
    fortran: bool
    at: int
    by_rows: bool

    @classmethod
    def of(cls, file, path: str, by_rows: bool, rows: int | None = None) -> Matrix:
        """Of an open file, whose values must be 32-bit floats in two dimensions (by rows in more)."""
        shape, fortran, kind, at = header(file)
        if kind not in ("<f4", "|f4"):
            raise DatasetError(f"{path}: values are {kind}, not 32-bit floats")
        if by_rows and len(shape) > 2:
            shape = shape[0], int(np.prod(shape[1:]))
        if len(shape) != 2 or rows and shape[0] != rows:
            raise DatasetError(f"{path}: shape {shape}")
        return cls(*shape, fortran, at, by_rows)

    @property
    def moments(self) -> int:
        return self.rows if self.by_rows else self.columns

    def read(self, file, a: int, b: int) -> np.ndarray:
        """Moments [a, b) as rows; their values stand together, or one in each of the other axis's lines."""

        def values(first: int, n: int) -> np.ndarray:
            file.seek(self.at + 4 * first)
            return np.frombuffer(file.read(4 * n), "<f4")

        if self.by_rows != self.fortran:
            width = self.columns if self.by_rows else self.rows
            return values(a * width, (b - a) * width).reshape(b - a, width)
        lines, length = (self.columns, self.rows) if self.by_rows else (self.rows, self.columns)
        return np.stack([values(k * length + a, b - a) for k in range(lines)], axis=1)


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.step = int(options.get("columns_per_partition", 4096))
        self.rows = int(options["rows"]) if "rows" in options else None
        self.by_rows = options.get("axis", "columns") == "rows"

    def partitions(self):
        with open_file(self.path) as file:
            matrix = Matrix.of(file, self.path, self.by_rows, self.rows)
        return [InputPartition((a, min(a + self.step, matrix.moments), matrix)) for a in range(0, matrix.moments, self.step)]

    def read(self, partition):
        a, b, matrix = partition.value
        with open_file(self.path) as file:
            part = matrix.read(file, a, b)
        for i in range(b - a):
            yield a + i, part[i].tolist()


def register(spark) -> None:
    spark.dataSource.register(NpyColumns)
