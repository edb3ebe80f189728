"""Tables in the folder that all executors share, and connected components over them.

A result is lazy, so the tables it reads stay until it has been read; ``scratch`` removes those made inside it once
its body, which must have read the results, is done, and ``clear`` removes all of a session.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, on one machine a temporary one, on a cluster refused."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.tidewave.work", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tidewave-')}"
        spark.conf.set("spark.tidewave.work", folder)
    return folder


#: Rows of a file of a small table.
FILE_ROWS = 8192

#: Runs whose tables have not been removed.
_open: list[Work] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables of all runs that begin inside, once what they gave has been read."""
    before = set(map(id, _open))
    try:
        yield
    finally:
        for work in [w for w in _open if id(w) not in before]:
            work.clear()


def clear() -> None:
    """Removes the tables of all runs; results that read them must have been read."""
    for work in list(_open):
        work.clear()


class Work:
    """Written tables of one run; ``saved`` cuts the lineage of a frame."""

    def __init__(self, spark: SparkSession, compression: str = "snappy"):
        self.spark, self.compression, self.at = spark, compression, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        self.n = 0
        self.paths: set[str] = set()
        _open.append(self)

    def saved(self, frame: DataFrame, rows: int | None = None) -> DataFrame:
        """``frame``, written and read again. With ``rows``, about how many it has, a small table gets a file for each
        ``FILE_ROWS`` instead of one for each partition: every local file costs the executor processes of its own."""
        if rows is not None:
            frame = frame.coalesce(max(1, -(-rows // FILE_ROWS)))
        self.n += 1
        path = f"{self.at}/{self.n}"
        frame.write.option("compression", self.compression).parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out.saved_at = path
        self.paths.add(path)
        return out

    def drop(self, frame: DataFrame) -> None:
        """Removes a saved table that nothing reads any more."""
        self._delete(frame.saved_at)

    def keep_only(self, *frames: DataFrame) -> None:
        """Removes all saved tables but those that the result reads."""
        for path in sorted(self.paths - {f.saved_at for f in frames}):
            self._delete(path)

    def clear(self) -> None:
        """Removes every table of this run."""
        self._delete(self.at)
        self.paths.clear()
        _open.remove(self)

    def _delete(self, at: str) -> None:
        self.paths.discard(at)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def components(work: Work, edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for each node of the undirected ``edges`` (a, b), about ``rows``: the smallest node of its component.

    Every round takes the smallest root among neighbours and then the root of that root, so rounds grow with the
    logarithm of a component's width. Sums by node are combined before they are shuffled; joins on a node with very
    many edges are split by adaptive execution.
    """
    both = work.saved(edges.select("a", "b").where("a <> b").union(edges.selectExpr("b AS a", "a AS b").where("a <> b")).distinct(), rows)
    rows = both.count()
    roots = work.saved(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")), rows)
    while True:
        seen = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("root").alias("near"))
        nearer = roots.join(seen.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "near").alias("next"))
        known = roots.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = work.saved(nearer.join(known, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("root"), (F.least("next", F.coalesce("far", "next")) != F.col("root")).alias("moved")), rows)
        still = step.where("moved").limit(1).count()
        work.drop(roots)
        roots = step
        if not still:
            break
    work.drop(both)
    return roots.select("node", "root")
