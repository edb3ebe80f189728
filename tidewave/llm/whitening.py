"""Operator 11: whitening of vectors by a one-sided Jacobi SVD of a blockwise TSQR.

Every entry c becomes the integer x = floor(1024 c) + 100000, so counts and sums are exact whatever the partitioning.
Three passes over the vectors:

1. Rows and sums by dimension: one short row a task, added up by dimension.
2. Blockwise TSQR: a task centres its rows ((n x - S) / n, the numerator an exact integer) and folds block after block
   into one upper triangle R; triangles of tasks are stacked ``FAN_IN`` at a time and reduced again, level by level,
   until one is left. It has as many rows and columns as a vector has entries, whatever the number of rows.
3. Whitened rows, whose covariance is then taken by Spark's own merging aggregates.

R has the singular values and right vectors of the centred rows. Plane rotations orthogonalise its columns, all
disjoint pairs of a round at once (``jacobi``); the lengths of the columns are then the singular values, accurate also
where they are small beside the largest, and the accumulated rotations are the components. Centring and orthogonal
steps alone are used: no matrix of products is ever formed.

Defined results: vectors that are null, or hold a null or non-finite entry, are left out, and so are those of another
length than most have (of equal counts the longer) or without entries; repeated rows each count and each give rows; a
null id is like any other; extra columns are ignored; an empty table gives no rows. Where
rows times the largest x reach 2**61 integers would not be exact, which is an error. A component whose standard
deviation is less than 1e-12 of the largest has no direction: ``whitened`` is null, and it takes no part in
``identity_error``, which is null where no component has one; ``explained`` is null where nothing varies.
``deviation`` is null where it is beyond a long (``whiten`` has it as a decimal of 38 digits).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import table
from tidewave.llm.tables import Work

SCALE, SHIFT, LARGEST = 1024.0, 100_000, 2.0**61
#: Triangles that one task stacks and reduces.
FAN_IN = 32
#: Rows that are folded into a triangle at once.
BLOCK_ROWS = 4096
#: Standard deviations below this share of the largest are none.
FLAT = 1e-12


class WhiteningError(ValueError):
    """Vectors that cannot be whitened."""


@dataclass
class Whitening:
    """What is known of the fit list: rows, sums, components (one a row) with their standard deviations, and the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    trace: float

    @property
    def kept(self) -> np.ndarray:
        return self.deviations > FLAT * self.deviations.max(initial=0.0)

    @property
    def explained(self) -> list[float | None]:
        return [float(s * s / self.trace) if self.trace > 0 else None for s in self.deviations]


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(key, v) of the vectors that take part, all of one length."""
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("v")).where(F.coalesce(fine, F.lit(False)))
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.where(F.size("v") == (most["dim"] if most else 0))


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """x of a batch as (rows, dim) longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    scaled = np.floor(SCALE * flat)
    if len(flat) and np.abs(scaled).max() >= LARGEST:
        raise WhiteningError("an entry is too large for exact integers")
    return scaled.astype(np.int64) + SHIFT


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n, rounded once."""
    return (n * x - sums).astype(np.float64) / n


def totals(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, top, sums = 0, 0, None
        for batch in batches:
            if batch.num_rows:
                x = integers(batch.column(0), len(batch.column(0)[0]))
                part = x.sum(axis=0)
                n, top, sums = n + batch.num_rows, max(top, int(np.abs(x).max())), part if sums is None else sums + part
        if n:
            yield pa.record_batch([pa.array([n], pa.int64()), pa.array([top], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "top", "sums"])

    parts = rows.select("v").mapInArrow(run, "n bigint, top bigint, sums array<bigint>")
    added = parts.select("n", "top", F.posexplode("sums").alias("dim", "s")).groupBy("dim").agg(F.sum("n").alias("n"), F.max("top").alias("top"), F.sum(F.col("s").cast("decimal(28,0)")).alias("s"))
    got = added.orderBy("dim").collect()  # a row for each dimension
    if not got:
        return 0, np.zeros(0, np.int64)
    if got[0]["n"] * got[0]["top"] >= LARGEST:
        raise WhiteningError("rows times the largest entry are too many for exact integers")
    return got[0]["n"], np.array([int(r["s"]) for r in got], np.int64)


def triangle(rows: np.ndarray) -> np.ndarray:
    """The square upper triangle R of the rows, padded with zero rows where they are few."""
    dim = rows.shape[1]
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, dim))
    return np.concatenate([r, np.zeros((dim - len(r), dim))]) if len(r) < dim else r


def _packed(r: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["r"])


def tsqr(rows: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """R of the centred rows, reduced level by level."""
    dim = len(sums)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                block = centred(integers(batch.column(0).slice(at, BLOCK_ROWS), dim), n, sums)
                r = triangle(block if r is None else np.concatenate([r, block]))
        if r is not None:
            yield _packed(r)

    def stack(data: pa.Table) -> pa.Table:
        r = None
        for blob in data["r"]:
            part = np.frombuffer(blob.as_py(), "<f8").reshape(dim, dim)
            r = triangle(part if r is None else np.concatenate([r, part]))
        return pa.Table.from_batches([_packed(r)])

    work = Work(rows.sparkSession)
    level = work.saved(rows.select("v").mapInArrow(fold, "r binary").withColumn("at", F.monotonically_increasing_id()))
    count = level.count()
    while count > 1:
        groups = -(-count // FAN_IN)
        dealt = level.select(F.pmod(F.xxhash64("at"), F.lit(groups)).alias("g"), "r") if groups > 1 else level.select(F.lit(0).cast("bigint").alias("g"), "r")
        level = work.saved(dealt.groupBy("g").applyInArrow(stack, "r binary").withColumn("at", F.monotonically_increasing_id()))
        count = level.count()
    r = np.frombuffer(level.first()["r"], "<f8").reshape(dim, dim)
    work.clear()
    return r


def rounds(dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, as rounds of disjoint pairs (each round turns all but the first by one place)."""
    places = list(range(dim + dim % 2))
    half = len(places) // 2
    for _ in range(len(places) - 1):
        pairs = [(min(a, b), max(a, b)) for a, b in zip(places[:half], reversed(places[half:]), strict=True) if max(a, b) < dim]
        yield np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)
        places = [places[0], places[-1], *places[1:-1]]


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, falling; right vectors as rows) of a square matrix by rotations of its columns.

    Columns count as orthogonal within the rounding of their own product; ``u`` and ``v`` hold them as rows.
    """
    dim, scale = r.shape[1], np.abs(r).max(initial=0.0)
    u, v = np.ascontiguousarray(r.T / (scale or 1.0)), np.eye(dim)
    tolerance = np.finfo(float).eps * np.sqrt(dim)
    plan = list(rounds(dim))
    for _ in range(sweeps):
        turned = False
        for i, j in plan:
            x, y = u[i], u[j]
            a, b, c = (np.einsum("ij,ij->i", p, q) for p, q in ((x, x), (y, y), (x, y)))
            turn = np.abs(c) > tolerance * np.sqrt(a * b)
            if not turn.any():
                continue
            turned = True
            i, j, a, b, c = i[turn], j[turn], a[turn], b[turn], c[turn]
            with np.errstate(over="ignore"):
                zeta = (b - a) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            cos = (1 / np.hypot(1.0, t))[:, None]
            sin = cos * t[:, None]
            for m in (u, v):
                left, right = m[i], m[j]
                m[i], m[j] = cos * left - sin * right, sin * left + cos * right
        if not turned:
            break
    sizes = np.sqrt((u**2).sum(axis=1)) * scale
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], v[order]


def fit(rows: DataFrame, components: int = 8) -> Whitening | None:
    """The first ``components`` of the rows (key, v) that ``usable`` gives; None without rows."""
    n, sums = totals(rows)
    if not n:
        return None
    sizes, vectors = jacobi(tsqr(rows, n, sums))
    some = min(components, len(sums))
    return Whitening(n, sums, vectors[:some], sizes[:some] / np.sqrt(n), float((sizes**2).sum() / n))


def squares(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    """Sum over dimensions of (n x - S)^2, exact: differences in two halves of 31 bits, put together as Python's integers."""
    d = np.abs(n * x - sums)
    high, low = d >> 31, d & 0x7FFFFFFF
    # differences are below 2^62, so products of halves are below 2^62; their own halves can be added over dimensions
    out = [0] * len(x)
    for part, shift in ((high * high, 62), (high * low, 32), (low * low, 0)):
        for half, more in ((part >> 32, 32), (part & 0xFFFFFFFF, 0)):
            for i, s in enumerate(half.sum(axis=1).tolist()):
                out[i] += s << (shift + more)
    return out


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(key, deviation decimal(38,0), whitened array<double>) of every row; null for components without a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        decimal.getcontext().prec = 60
        kept = model.kept
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                x = integers(batch.column(1), len(model.sums))
                values = centred(x, model.n, model.sums) @ model.components.T / np.where(kept, model.deviations, 1.0)
                mask = np.broadcast_to(~kept, values.shape).ravel()
                ends = pa.array(np.arange(len(x) + 1) * values.shape[1], pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(values.ravel(), pa.float64(), mask=mask))
                sums = [decimal.Decimal(s) if s < 10**38 else None for s in squares(x, model.n, model.sums)]
                yield pa.record_batch([batch.column(0), pa.array(sums, pa.decimal128(38, 0)), lists], names=["key", "deviation", "whitened"])

    kind = rows.schema["key"].dataType.simpleString()
    return rows.select("key", "v").mapInArrow(run, f"key {kind}, deviation decimal(38,0), whitened array<double>")


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with a direction."""
    at = np.flatnonzero(model.kept).tolist()
    if not at:
        return None
    pairs = [(i, j) for i in at for j in at if i <= j]
    value = lambda i: F.col("whitened")[i]
    row = whitened.agg(*[F.covar_pop(value(i), value(j)).alias(f"c{k}") for k, (i, j) in enumerate(pairs)]).first()
    return max(abs(row[k] - (i == j)) for k, (i, j) in enumerate(pairs))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return digests(vectors, "vec_id", "embedding")


def digests(vectors: DataFrame, key: str, column: str, components: int = 8) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    rows = usable(vectors, key, column)
    model = fit(rows, components)
    kind = vectors.schema[key].dataType.simpleString()
    if model is None:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    done = Work(vectors.sparkSession).saved(whiten(rows, model))
    error = identity_error(done, model)
    explained = F.array(*[F.lit(x).cast("double") for x in model.explained])
    each = done.select("key", F.col("deviation").try_cast("bigint").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return each.select(F.col("key").alias(key), (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", explained[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
