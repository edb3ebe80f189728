"""Fitters whose fits of all folds, and of all budgets of calibration, are one plan of constant size.

``SufficientFitter``: a fit that depends on its training rows by sums alone (of vectors that a row gives). Sums are taken
once by unit; what a fold trains on is all minus what it leaves out, so folds are never joined with samples. Then one
row a fold is solved for parameters, and test rows meet the parameters of their fold.

``RowsFitter``: any fit. Training and test rows of a fold come together as one group of a cogrouped plan; a task holds
one fold at a time, which is what such a fit needs, and rows are shipped once for each fold.

A plain predictor, a callable over two DataFrames, still gives one plan for each fold.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewave.operators import poses


class SufficientFitter(ABC):
    """``statistics`` are added up over training rows, ``solve`` makes parameters of them, ``guess`` a pose of a row."""

    @abstractmethod
    def statistics(self, samples: DataFrame) -> Column:
        """array<double> of a sample, of the same length for all."""

    def solve(self, sums: np.ndarray, n: int) -> np.ndarray:
        """Parameters from ``n`` rows' sums; their mean unless another is given."""
        return sums / n

    @abstractmethod
    def guess(self, params: Column) -> Column:
        """The pose of a sample by the parameters of its fold."""

    def _parts(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        return poses.vector_sums(rows.withColumn("stats", self.statistics(rows)), keys, "stats")

    def solved(self, sums: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, params) from (keys, n, sums), one row a fold."""

        @F.arrow_udf("array<double>")
        def run(s: pa.Array, n: pa.Array) -> pa.Array:
            found = [self.solve(np.asarray(x, float), k).tolist() for x, k in zip(s.to_pylist(), n.to_pylist(), strict=True)]
            return pa.array(found, pa.list_(pa.float64()))

        return sums.where("n > 0").select(*keys, run(F.col("sums"), F.col("n").cast("long")).alias("params"))

    def left_out(self, samples: DataFrame, unit: str, within: list[str]) -> DataFrame:
        """(fold, n, sums) of all samples but the unit's, for every unit that leaves any."""
        parts = self._parts(samples, [*within, unit])
        total = poses.vector_sums(parts, within, "sums", "n").withColumnsRenamed({"n": "all_n", "sums": "all_sums"})
        met = parts.join(total, within) if within else parts.join(F.broadcast(total), F.lit(True))  # one row
        return met.where("all_n > n").select(F.col(unit).alias("fold"), (F.col("all_n") - F.col("n")).alias("n"), F.zip_with("all_sums", "sums", lambda a, b: a - b).alias("sums"))

    def predictions(self, family) -> DataFrame:
        """(fold, sample_id, guess) for every test sample of a family."""
        if family.by_unit:
            sums = self.left_out(family.samples, *poses.unit_of(family.split))
        else:
            sums = self._parts(family.train(), ["fold"])
        return family.test().join(self.solved(sums, ["fold"]), "fold").select("fold", "sample_id", self.guess(F.col("params")).alias("guess"))

    def calibrated(self, samples: DataFrame, folded: DataFrame, taken: DataFrame, budgets: list[float]) -> DataFrame:
        """(budget, fold, sample_id, guess): training rows of a fold and what was taken for a budget, as sums."""
        with_stats = samples.select("sample_id", self.statistics(samples).alias("stats"))
        train = folded.where("role = 'train'").select("fold", "sample_id").join(with_stats, "sample_id")
        base = poses.vector_sums(train, ["fold"], "stats")
        base = base.select(F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget"), "fold", "n", "sums")
        more = poses.vector_sums(taken.select("budget", "fold", "sample_id").join(with_stats, "sample_id"), ["budget", "fold"], "stats")
        sums = poses.vector_sums(base.unionByName(more), ["budget", "fold"], "sums", "n")
        test = folded.where("role = 'test'").select("fold", "sample_id").join(samples, "sample_id")
        return test.join(self.solved(sums, ["budget", "fold"]), "fold").select("budget", "fold", "sample_id", self.guess(F.col("params")).alias("guess"))


class MeanFitter(SufficientFitter):
    """Says the mean training pose."""

    def statistics(self, samples: DataFrame) -> Column:
        return F.col("pose").cast("array<double>")

    def guess(self, params: Column) -> Column:
        return params


class RidgeFitter(SufficientFitter):
    """Linear regression of the pose on ``features`` with a constant, from sums of products; ``weight`` shrinks slopes."""

    def __init__(self, features: int, weight: float = 1e-6):
        self.d, self.weight, self.size = features + 1, weight, 3 * poses.N_JOINTS

    def statistics(self, samples: DataFrame) -> Column:
        row = F.concat(F.col("features").cast("array<double>"), F.array(F.lit(1.0)))
        products = lambda other: F.flatten(F.transform(row, lambda a: F.transform(other, lambda b: a * b)))
        return F.concat(products(row), products(F.col("pose").cast("array<double>")))

    def solve(self, sums: np.ndarray, n: int) -> np.ndarray:
        gram, cross = sums[: self.d**2].reshape(self.d, self.d), sums[self.d**2 :].reshape(self.d, self.size)
        shrink = np.eye(self.d) * self.weight * n
        shrink[-1, -1] = 0
        return np.linalg.lstsq(gram + shrink, cross, rcond=None)[0].T.ravel()

    def guess(self, params: Column) -> Column:
        row = F.concat(F.col("features").cast("array<double>"), F.array(F.lit(1.0)))
        dot = lambda k: F.aggregate(F.zip_with(F.slice(params, k * self.d + 1, self.d), row, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), dot)


class RowsFitter(ABC):
    """A fit over a fold's rows as Arrow tables of the samples' columns."""

    @abstractmethod
    def fit_predict(self, train: pa.Table, test: pa.Table) -> np.ndarray:
        """(rows of test, 63) guesses."""

    def _grouped(self, train: DataFrame, test: DataFrame, keys: list[str]) -> DataFrame:
        kinds = {f.name: f.dataType.simpleString() for f in test.schema.fields}

        def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
            if not b.num_rows:
                return pa.table({**{k: pa.array([], b[k].type) for k in keys}, "sample_id": pa.array([], pa.int64()), "guess": pa.array([], pa.list_(pa.float64()))})
            a = a.rename_columns([c[1:] for c in a.column_names])
            said = np.asarray(self.fit_predict(a.drop_columns(keys), b.drop_columns(keys)), np.float64)
            guess = pa.FixedSizeListArray.from_arrays(pa.array(said.reshape(-1)), said.size // b.num_rows).cast(pa.list_(pa.float64()))
            return pa.table({**{k: b[k] for k in keys}, "sample_id": b["sample_id"], "guess": guess})

        columns = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", sample_id long, guess array<double>"
        # both sides may come from one frame, so one gets names of its own
        train = train.toDF(*[f"_{c}" for c in train.columns])
        return train.groupBy(*[f"_{k}" for k in keys]).cogroup(test.groupBy(*keys)).applyInArrow(run, columns)

    def predictions(self, family) -> DataFrame:
        test = family.test()
        if family.by_unit:
            unit, within = poses.unit_of(family.split)
            units = family.units().withColumnRenamed(unit, "fold")
            pairs = family.samples.join(units, within) if within else family.samples.join(units, F.col(unit) != F.col("fold"))
            train = pairs.where(F.col(unit) != F.col("fold")).select(*test.columns)
        else:
            train = family.train().select(*test.columns)
        return self._grouped(train, test, ["fold"])

    def calibrated(self, samples: DataFrame, folded: DataFrame, taken: DataFrame, budgets: list[float]) -> DataFrame:
        every = F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget")
        side = lambda role: folded.where(F.col("role") == role).select("fold", "sample_id", every)
        train = side("train").unionByName(taken.select("fold", "sample_id", "budget")).join(samples, "sample_id")
        test = side("test").join(samples, "sample_id")
        return self._grouped(train, test, ["budget", "fold"])
