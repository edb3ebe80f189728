"""Label matches of leave-one-person-out folds among many people, from one table of distances.

Leaving a person out takes that person's pairs away and changes no other distance. So all pairs are measured and put
in order once; the median of a fold is an order statistic of that order with the person's own places deleted: with own
places r_0 < r_1 < ..., the k-th place that is left is k + the number of i with r_i - i <= k. Work is the square of the
number of people, not its cube, and no task holds more than two blocks of people.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.operators import poses
from tidewave.operators.ordering import placed, written

BLOCK = 1024


def _blocks(rows: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """(block, ids, units, x) from (id, unit, mean): about ``block_rows`` people in a row."""
    n = max(1, -(-rows.count() // block_rows))

    def pack(data: pa.Table) -> pa.Table:
        x = np.array(data["mean"].to_pylist(), "<f8")
        return pa.table({"block": data["block"].slice(0, 1), "ids": [data["id"].to_numpy().astype("<i8").tobytes()], "units": [data["unit"].to_numpy().astype("<i8").tobytes()], "x": [x.tobytes()]})

    dealt = rows.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), "id", "unit", "mean")
    return dealt.groupBy("block").applyInArrow(pack, "block bigint, ids binary, units binary, x binary"), n


def _met(a: DataFrame, b: DataFrame, first: str | None, n: int) -> DataFrame:
    """Blocks of both sides: every one of ``a`` with every one of ``b``, or with those from its own on."""
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]).withColumn("block", F.explode(F.sequence(F.col("a_block") if first else F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return left.join(b, "block")


def _arrays(row: dict) -> tuple[np.ndarray, ...]:
    whole = lambda k: np.frombuffer(row[k], "<i8")
    x = lambda k: np.frombuffer(row[k], "<f8").reshape(-1, poses.N_JOINTS, 3)
    return whole("a_ids"), whole("a_units"), x("a_x"), whole("ids"), whole("units"), x("x")


def _distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.sqrt(((many - one) ** 2).sum(2)).mean(1)


def pair_distances(people: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """(a, b, unit_a, unit_b, d): every pair of people (id, unit, mean) once."""
    packed, n = _blocks(people, block_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, units, x, others, other_units, y = _arrays(row)
                own = row["a_block"] == row["block"]
                for i in range(len(ids)):
                    at = slice(i + 1, None) if own else slice(None)
                    d = _distances(x[i], y[at])
                    if len(d):
                        yield pa.record_batch([pa.array(np.full(len(d), ids[i])), pa.array(others[at]), pa.array(np.full(len(d), units[i])), pa.array(other_units[at]), pa.array(d)], names=["a", "b", "unit_a", "unit_b", "d"])

    return _met(packed, packed, "own", n).select("a_block", "a_ids", "a_units", "a_x", "block", "ids", "units", "x").mapInArrow(run, "a bigint, b bigint, unit_a bigint, unit_b bigint, d double")


def nearest_outside(tested: DataFrame, people: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """(unit, distance, id): the nearest person of another unit to each tested (id, unit, mean), the smallest id on ties."""
    packed, n = _blocks(people, block_rows)
    asked, _ = _blocks(tested, block_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, units, x, ids, other_units, y = _arrays(row)
                order = np.argsort(ids)
                best = []
                for unit, one in zip(units, x, strict=True):
                    d = np.where(other_units[order] == unit, np.inf, _distances(one, y[order]))
                    best.append((unit, d.min(), ids[order][d.argmin()]))
                found = [b for b in best if np.isfinite(b[1])]
                if found:
                    u, d, i = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(u, pa.int64()), pa.array(d, pa.float64()), pa.array(i, pa.int64())], names=["unit", "distance", "id"])

    best = _met(asked, packed, None, n).select("a_block", "a_ids", "a_units", "a_x", "block", "ids", "units", "x").mapInArrow(run, "unit bigint, distance double, id bigint")
    return best.groupBy("unit").agg(F.min(F.struct("distance", "id")).alias("m")).select("unit", "m.*")


def medians_without(pairs: DataFrame) -> DataFrame:
    """(unit, typical): for each unit the median distance of the pairs that it is not part of; null without any."""
    ranked = placed(pairs, [F.col("d"), F.col("a"), F.col("b")])
    total = ranked.count()
    own = ranked.select("place", F.explode(F.array_distinct(F.array("unit_a", "unit_b"))).alias("unit"))
    mine = Window.partitionBy("unit")
    own = own.withColumn("before", F.col("place") - (F.row_number().over(mine.orderBy("place")) - 1)).withColumn("left", F.lit(total) - F.count("*").over(mine))
    low, high = F.floor((F.col("left") - 1) / 2), F.floor(F.col("left") / 2)
    at = own.groupBy("unit").agg((F.first(low) + F.sum((F.col("before") <= low).cast("long"))).alias("low"), (F.first(high) + F.sum((F.col("before") <= high).cast("long"))).alias("high"), F.first("left").alias("left"))
    wanted = at.where("left > 0").select("unit", F.explode(F.array("low", "high")).alias("place"))
    found = wanted.join(ranked.select("place", "d"), "place").groupBy("unit").agg(F.avg("d").alias("typical"))
    return at.select("unit").join(found, "unit", "left")


def left_out_matches(samples: DataFrame, least: float = 0.2, block_rows: int = BLOCK) -> DataFrame:
    """``poses.label_matches`` of all folds that leave a person (``who``) out; a person's spellings are left out together."""
    parts = poses.vector_sums(samples, ["who", "participant"])
    # one row a person: numbers by name
    people = parts.select("who", "participant", poses.mean_vector(F.col("sums"), F.col("n")).alias("mean"), "n", "sums").withColumns({"id": F.row_number().over(Window.orderBy("participant", "who")).cast("bigint"), "unit": F.dense_rank().over(Window.orderBy("who")).cast("bigint")})
    people = written(people, "people")
    whole = poses.vector_sums(people, ["who", "unit"], "sums", "n").select("who", "unit", F.col("unit").alias("id"), poses.mean_vector(F.col("sums"), F.col("n")).alias("mean"))
    near = nearest_outside(whole.select("id", "unit", "mean"), people.select("id", "unit", "mean"), block_rows)
    typical = medians_without(pair_distances(people.select("id", "unit", "mean"), block_rows))
    met = whole.select("who", "unit").join(near, "unit", "left").join(people.select("id", F.col("participant").alias("nearest")), "id", "left").join(typical, "unit", "left")
    ratio = F.when(F.col("typical") > 0, F.col("distance") / F.col("typical"))
    out = met.select(F.col("who").alias("fold"), "nearest", "distance", "typical", ratio.alias("ratio"), F.lit(0).cast("bigint").alias("shared"))
    return out.withColumn("passed", F.coalesce(F.col("ratio") > least, F.lit(False)))
