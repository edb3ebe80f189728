"""Places in a total order, without bringing all rows to one task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, on one machine a temporary one, on a cluster refused."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or f"file://{tempfile.mkdtemp(prefix='tidewave-')}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a table in the shared folder: what reads it is not computed anew, and lost executors cost nothing."""
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def placed(frame: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place from 0 on in ``order``, which must tell all rows apart.

    Rows are dealt to ranges of the order and sorted there; a place is one in its range and all rows of the ranges
    before, of which there are as many as shuffle partitions.
    """
    dealt = written(frame.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", 33)
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    ahead, starts = 0, []
    for p, n in sizes:
        starts.append((p, ahead))
        ahead += n
    starts = F.broadcast(frame.sparkSession.createDataFrame(starts, "_part bigint, _ahead bigint"))  # a row a range
    met = dealt.withColumn("_part", part).join(starts, "_part")
    return met.withColumn(name, F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_ahead")
