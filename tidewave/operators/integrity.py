"""Manifests of file trees and names of sessions."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.errors import IntegrityError

SCHEMA = "manifest/1"
SUFFIXES = (".npy", ".json", ".txt", ".csv")


def _glob(suffixes: tuple[str, ...]) -> str:
    """A pattern of file names with one of the suffixes, whatever their case."""
    return "*{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"


def tree(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(path, content) of the files below a folder with one of the suffixes; others are not opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _glob(suffixes)).load(folder)
    return files.select(relative_to(folder, F.col("path")).alias("path"), "content")


def relative_to(folder: str, path: Column) -> Column:
    """A full path, with or without scheme, as the path below ``folder``."""
    return F.regexp_replace(F.regexp_replace(path, r"^\w+:/+", "/"), "^.*?" + "/".join([""] + [re.escape(p) for p in str(folder).split("/") if p and ":" not in p]) + "/", "")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, full, size_now) of the files below a folder whose names match; none is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select(relative_to(folder, F.col("path")).alias("path"), F.col("path").alias("full"), F.col("length").alias("size_now"))


#: Bytes of a file that are in memory at once when it is hashed.
CHUNK = 4 << 20


def hashed(files: DataFrame) -> DataFrame:
    """``files`` with ``hash_now``, the SHA-256 of the file at ``full``, read piece by piece in the task of its row."""

    def run(batches):
        from tidewave.sources.npy import open_file

        for batch in batches:
            digests = []
            for path in batch.column(batch.schema.get_field_index("full")).to_pylist():
                digest = hashlib.sha256()
                with open_file(path) as file:
                    while part := file.read(CHUNK):
                        digest.update(part)
                digests.append(digest.hexdigest())
            yield pa.record_batch([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "hash_now"])

    return files.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields) + ", hash_now string")


def statuses(kept: DataFrame, files: DataFrame) -> DataFrame:
    """(path, full, size_now, status) of a manifest and a listing: each path once.

    Only files that the manifest has with their size are read; they are dealt out one by one, large ones of any size.
    """
    met = files.join(kept, "path", "full")
    status = F.when(F.col("full").isNull(), "missing").when(F.col("sha256").isNull(), "not in the manifest").when(F.col("size_now") != F.col("size_bytes"), "wrong size")
    met = met.withColumn("status", status)
    # rows are tiny and files are not, so the number of tasks does not go by the bytes of rows
    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    same = hashed(met.where("status IS NULL").select("path", "full", "size_now", "sha256").repartition(tasks, "path"))
    same = same.select("path", "full", "size_now", F.when(F.col("hash_now") != F.col("sha256"), "content changed").otherwise("ok").alias("status"))
    return met.where("status IS NOT NULL").select("path", "full", "size_now", "status").unionByName(same)


def with_suffix(paths: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Rows whose path ends in one of the suffixes, whatever its case."""
    return paths.where(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).isin(*suffixes))


def manifest(files: DataFrame) -> DataFrame:
    """(path, size_bytes, sha256) from (path, content)."""
    return files.select("path", F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def verify(kept: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): missing, extra, wrong size, content changed or ok; each path once."""
    now = files.select("path", F.octet_length("content").cast("long").alias("size_now"), F.sha2("content", 256).alias("hash_now"))
    met = kept.join(now, "path", "full")
    status = F.when(F.col("size_now").isNull(), "missing").when(F.col("size_bytes").isNull(), "extra").when(F.col("size_now") != F.col("size_bytes"), "wrong size").when(F.col("hash_now") != F.col("sha256"), "content changed").otherwise("ok")
    return met.select("path", status.alias("status"))


def totals(rows: DataFrame) -> DataFrame:
    """(files, size_bytes) of a manifest."""
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"))


def verify_files(kept: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status) of the files given alone: size first, and a digest only where the size is right."""
    now = files.select("path", F.octet_length("content").cast("long").alias("size_now"), "content")
    met = now.join(kept, "path", "left")
    status = F.when(F.col("size_bytes").isNull(), "not in the manifest").when(F.col("size_now") != F.col("size_bytes"), "wrong size").when(F.sha2("content", 256) != F.col("sha256"), "content changed").otherwise("ok")
    return met.select("path", status.alias("status"))


class Verifier:
    """Reads below a folder only what its manifest vouches for, and hashes each path once."""

    def __init__(self, kept: DataFrame, folder: str):
        self.kept, self.folder, self.seen = kept, folder, set()

    def require(self, *paths: str) -> None:
        """IntegrityError unless every path (relative to the folder) is as the manifest says."""
        new = sorted(set(paths) - self.seen)
        if not new:
            return
        spark = self.kept.sparkSession
        asked = spark.createDataFrame([(p,) for p in new], "path string")
        unknown = asked.join(self.kept, "path", "left_anti").limit(1).collect()
        if unknown:
            raise IntegrityError(f"not in the manifest: {unknown[0]['path']}")
        found = spark.read.format("binaryFile").load([f"{self.folder}/{p}" for p in new])
        path = F.coalesce(*[F.when(F.endswith("path", F.lit("/" + p)), F.lit(p)) for p in sorted(new, key=len, reverse=True)])
        require_ok(verify_files(self.kept, found.select(path.alias("path"), "content")))
        self.seen |= set(new)


def describe(report: DataFrame, shown: int = 5) -> str:
    """One line for each status that is not ok: its count and first paths."""
    bad = report.where("status <> 'ok'")
    counts = {r["status"]: r["count"] for r in bad.groupBy("status").count().collect()}
    first = bad.withColumn("_at", F.row_number().over(Window.partitionBy("status").orderBy("path"))).where(F.col("_at") <= shown).orderBy("status", "path").collect()
    lines = []
    for status, n in sorted(counts.items()):
        lines.append(f"{status}: {', '.join(r['path'] for r in first if r['status'] == status)}" + (f" (+{n - shown} more)" if n > shown else ""))
    return "\n".join(lines)


def require_ok(report: DataFrame) -> None:
    if text := describe(report):
        raise IntegrityError(text)


def write_manifest(rows: DataFrame, path: str, dataset: str) -> None:
    """One JSON file, sorted by path, written row by row."""
    with open(path, "w") as out:
        out.write(f'{{\n  "schema": {json.dumps(SCHEMA)},\n  "dataset": {json.dumps(dataset)},\n  "files": [')
        for i, r in enumerate(rows.select("path", "size_bytes", "sha256").orderBy("path").toLocalIterator()):
            text = json.dumps(r.asDict(), indent=2).replace("\n", "\n    ")
            out.write(("," if i else "") + "\n    " + text)
        out.write("\n  ]\n}\n")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    data = json.loads(Path(path).read_text())
    if data.get("schema") != SCHEMA:
        raise IntegrityError(f"unknown manifest schema {data.get('schema')!r}")
    names = [f["path"] for f in data["files"]]
    if len(set(names)) != len(names) or any(n.startswith("/") or ".." in n.split("/") or len(f["sha256"]) != 64 or f["size_bytes"] < 0 for n, f in zip(names, data["files"], strict=True)):
        raise IntegrityError("paths are relative and unique, digests have 64 digits, sizes are not negative")
    return spark.createDataFrame([(f["path"], f["size_bytes"], f["sha256"]) for f in data["files"]], "path string, size_bytes long, sha256 string")


def session_identity(study: Column, participant: Column, device: Column, hand: Column, condition: Column, index: Column) -> Column:
    return F.format_string("study%d/p%02d/%s/%s/%s/s%03d", study, participant, F.coalesce(device, F.lit("unknown-device")), F.coalesce(hand, F.lit("unknown-hand")), F.coalesce(condition, F.lit("none")), index)
