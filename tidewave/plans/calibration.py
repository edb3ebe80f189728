"""Calibration curves: how a fitter gains from minutes of a test person's own data."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.errors import ExperimentError
from tidewave.model import Measurement, Protocol
from tidewave.operators import poses
from tidewave.plans.fitting import RowsFitter, SufficientFitter

#: (training and calibration rows of a fold, its test rows) -> (sample_id, guess).
Fitter = Callable[[DataFrame, DataFrame], DataFrame]
BUDGETS = (0.0, 1.0, 2.0, 20.0)
SLACK = 1e-9


@dataclass(frozen=True)
class Point:
    """One budget: what was asked for, what the person with least data gave, and the error under that protocol."""

    requested: float
    achieved: float
    truncated: bool
    mpjpe: Measurement

    def describe(self) -> str:
        short = f" (asked for {self.requested:g})" if self.truncated else ""
        return f"{self.achieved:>6.2f} min{short}: {self.mpjpe.value:.2f} {self.mpjpe.unit}"


@dataclass(frozen=True)
class Curve:
    points: tuple[Point, ...]

    def at(self, minutes: float) -> Point | None:
        """The point of exactly these requested minutes."""
        return next((p for p in self.points if p.requested == minutes), None)

    @property
    def zero_shot(self) -> Point | None:
        return self.at(0.0)

    @property
    def two_minutes(self) -> Point | None:
        return self.at(2.0)

    @property
    def best(self) -> Point:
        return min(self.points, key=lambda p: p.mpjpe.value)

    @property
    def gain(self) -> float | None:
        """By how much the best point is below the zero-shot one."""
        return self.zero_shot.mpjpe.value - self.best.mpjpe.value if self.zero_shot else None

    @property
    def monotone(self) -> bool:
        values = [p.mpjpe.value for p in sorted(self.points, key=lambda p: p.requested)]
        return all(b <= a + SLACK for a, b in zip(values, values[1:], strict=False))

    def text(self) -> str:
        gain = "no zero-shot point" if self.gain is None else f"gain {self.gain:.2f} mm, {'never worse with more' if self.monotone else 'NOT always better with more'}"
        return "\n".join([*(p.describe() for p in self.points), gain])

    def as_json(self) -> str:
        rows = [{"requested": p.requested, "achieved": p.achieved, "truncated": p.truncated, "mpjpe": p.mpjpe.value, "samples": p.mpjpe.samples} for p in self.points]
        return json.dumps({"points": rows, "gain": self.gain, "monotone": self.monotone, "best": self.best.requested}, indent=2)


def sweep_errors(samples: DataFrame, folded: DataFrame, taken: DataFrame, budgets: tuple[float, ...], fitter: Fitter | SufficientFitter | RowsFitter) -> DataFrame:
    """(budget, fold, sample_id, err): the fitter refitted for every fold and budget on training rows and what was taken.

    A fitter of ``plans.fitting`` takes all folds and budgets in one plan.
    """
    if isinstance(fitter, SufficientFitter | RowsFitter):
        met = fitter.calibrated(samples, folded, taken, list(budgets)).join(samples.select("sample_id", "pose"), "sample_id")
        return met.select("budget", "fold", "sample_id", poses.joint_errors(F.col("guess"), F.col("pose")).alias("err"))
    out = None
    for fold in sorted(r["fold"] for r in folded.select("fold").distinct().collect()):
        mine = folded.where(F.col("fold") == fold)
        side = {role: samples.join(mine.where(F.col("role") == role).select("sample_id"), "sample_id", "left_semi") for role in ("train", "test")}
        for budget in budgets:
            more = taken.where((F.col("fold") == fold) & (F.col("budget") == budget)).select("sample_id")
            train = side["train"].unionByName(samples.join(more, "sample_id", "left_semi"))
            met = fitter(train, side["test"]).join(side["test"].select("sample_id", "pose"), "sample_id")
            part = met.select(F.lit(budget).alias("budget"), F.lit(fold).alias("fold"), "sample_id", poses.joint_errors(F.col("guess"), F.col("pose")).alias("err"))
            out = part if out is None else out.unionByName(part)
    return out


def sweep(samples: DataFrame, folded: DataFrame, fitter: Fitter | SufficientFitter | RowsFitter, protocol: Protocol, sample_seconds: float, budgets: tuple[float, ...] = BUDGETS) -> Curve:
    """The curve of a fitter over budgets of minutes.

    The pool of a fold is what its test people have beside training and test; an empty pool with a budget above zero is a
    ValueError, one that holds training or test samples leaks.
    """
    taken = poses.calibration(samples, folded, list(budgets), sample_seconds)
    poses.require_pool(taken, folded, list(budgets))
    got = {r["budget"]: r for r in poses.achieved(samples, folded, taken, list(budgets), sample_seconds).collect()}
    numbers = {r["budget"]: r for r in poses.metrics(sweep_errors(samples, folded, taken, budgets, fitter), ["budget"]).collect()}
    wanted = folded.where("role = 'test'").count()
    points = []
    for b in budgets:
        if b not in numbers or numbers[b]["samples"] != wanted:
            raise ExperimentError(f"at {b:g} minutes the fitter did not predict every test sample once")
        points.append(Point(b, got[b]["achieved"], got[b]["truncated"], Measurement(numbers[b]["mpjpe"], "mm", protocol.at_calibration(b), wanted)))
    return Curve(tuple(points))
