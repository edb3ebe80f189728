"""A Spark data source over the arrays of many sessions: ``spark.read.format("session_arrays")``.

Option ``catalogue`` is a Parquet folder with one row a session, as ``Corpus.catalogue`` writes it: who and what was
recorded, the full paths of the session's arrays with their sizes, and a ``fault`` where the manifest does not vouch
for a file. Sessions are split into ranges of ``columns_per_partition`` moments by their sizes alone; no array is
opened to plan a scan, and none of a session with a fault is opened at all.

* Option ``only``: a JSON object of lists of values for study, participant, device, hand, condition, identity or
  session_index; other sessions give no partition. It is an option and not a pushed filter: in Spark 4.1.2 a filter that a Python source
  takes stays with its relation, and a second query over the same frame loses rows.
* The schema that a reader asks for (``.schema(...)``) is what is read: without ``diff`` the file of differences is not
  opened, without ``samples`` and ``diff`` only headers are.
* Option ``which``: ``profiles`` (frame_idx, samples, diff; the difference at ``lag`` frames before is the frame's, null
  for the first) or ``landmarks`` (frame_idx, joints; sessions without a sidecar give no rows).
* Option ``faults``: ``fail`` raises in the first task of a session with a fault, ``skip`` leaves the session out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewave.errors import DatasetError, IntegrityError
from tidewave.sources.npy import Matrix, open_file

ABOUT = {"study": pa.int32(), "participant": pa.int32(), "device": pa.string(), "hand": pa.string(), "condition": pa.string(), "session_index": pa.int32(), "identity": pa.string()}
SPARK_ABOUT = "study int, participant int, device string, hand string, condition string, session_index int, identity string"
SCHEMAS = {"profiles": f"{SPARK_ABOUT}, frame_idx bigint, samples array<float>, diff array<float>", "landmarks": f"{SPARK_ABOUT}, frame_idx bigint, joints array<float>"}
#: Moments in one batch of rows.
BATCH = 512
#: Bytes of a header, at least; sizes give numbers of moments up to this.
HEADER = 128


class SessionArrays(DataSource):
    @classmethod
    def name(cls) -> str:
        return "session_arrays"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("which", "profiles")]

    def reader(self, schema) -> DataSourceReader:
        return SessionReader(self.options, [(f.name, f.dataType.simpleString()) for f in schema.fields])


class SessionReader(DataSourceReader):
    def __init__(self, options, columns: list[tuple[str, str]]):
        self.catalogue = options["catalogue"]
        self.which = options.get("which", "profiles")
        known = dict(c.split(" ") for c in SCHEMAS[self.which].split(", "))
        wrong = [f"{n} {t}" for n, t in columns if known.get(n) != t]
        if wrong:
            raise DatasetError(f"no such columns: {wrong}")
        self.columns = [n for n, _ in columns]
        self.step = int(options.get("columns_per_partition", 4096))
        self.bins, self.lag = int(options.get("rows", 600)), int(options.get("lag", 1))
        self.skip = options.get("faults", "fail") == "skip"
        self.allowed = {c: set(some) for c, some in json.loads(options.get("only", "{}")).items()}
        if unknown := sorted(set(self.allowed) - set(ABOUT)):
            raise DatasetError(f"sessions are not chosen by {unknown}")

    def sessions(self) -> Iterator[dict]:
        """Sessions of the catalogue that are asked for, file by file."""
        store, inner = fs.FileSystem.from_uri(self.catalogue if "://" in self.catalogue else f"file://{self.catalogue.removeprefix('file:')}")
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.path.endswith(".parquet"))
        for path in files:
            for row in pq.ParquetFile(store.open_input_file(path)).read().to_pylist():
                if all(row[c] in some for c, some in self.allowed.items()):
                    yield row

    def partitions(self):
        out = []
        for s in self.sessions():
            fault = s["landmarks_fault"] if self.which == "landmarks" else s["fault"]
            path, size = (s["landmarks"], s["landmarks_size"]) if self.which == "landmarks" else (s["profiles"], s["profiles_size"])
            if fault:
                out += [] if self.skip else [InputPartition((s, fault, path, 0, None))]
            elif path is not None:
                width = 63 if self.which == "landmarks" else self.bins
                starts = list(range(0, max(1, (size - HEADER) // (4 * width)), self.step))
                # the last range goes to the end that the header says
                out += [InputPartition((s, None, path, a, b)) for a, b in zip(starts, [*starts[1:], None], strict=True)]
        return out or [InputPartition(None)]

    def read(self, partition):
        if partition.value is None:
            return
        session, fault, path, a, b = partition.value
        if fault:
            raise IntegrityError(f"{session['identity']}: {fault}")
        with open_file(path) as file:
            matrix = Matrix.of(file, path, self.which == "landmarks", self.bins if self.which == "profiles" else None)
            b = min(b or matrix.moments, matrix.moments)
            stored = self._stored(session, matrix) if "diff" in self.columns else None
            try:
                for at in range(a, b, BATCH):
                    yield self._batch(session, file, matrix, stored, at, min(at + BATCH, b))
            finally:
                if stored:
                    stored[0].close()

    def _stored(self, session: dict, matrix: Matrix):
        file = open_file(session["diffs"])
        found = Matrix.of(file, session["diffs"], False, self.bins)
        if found.moments > matrix.moments:
            raise DatasetError(f"{session['identity']}: {found.moments} differences for {matrix.moments} frames")
        return file, found

    def _batch(self, session: dict, file, matrix: Matrix, stored, a: int, b: int) -> pa.RecordBatch:
        columns = []
        for name in self.columns:
            if name in ABOUT:
                columns.append(pa.array([session[name]] * (b - a), ABOUT[name]))
            elif name == "frame_idx":
                columns.append(pa.array(np.arange(a, b), pa.int64()))
            elif name == "diff":
                columns.append(self._differences(*stored, a, b))
            else:
                columns.append(_lists(matrix.read(file, a, b)))
        return pa.record_batch(columns, names=self.columns)

    def _differences(self, file, matrix: Matrix, a: int, b: int) -> pa.Array:
        """The stored differences of frames [a, b), which stand ``lag`` columns before; null where there are none."""
        low, high = min(max(a - self.lag, 0), matrix.moments), min(max(b - self.lag, 0), matrix.moments)
        first = low + self.lag - a if high > low else b - a
        there = _lists(matrix.read(file, low, high)) if high > low else pa.array([], pa.list_(pa.float32()))
        none = lambda n: pa.nulls(n, pa.list_(pa.float32()))
        return pa.concat_arrays([none(first), there, none(b - a - first - len(there))])


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel(), pa.float32()))


def register(spark) -> None:
    spark.dataSource.register(SessionArrays)
