"""The evaluation suite: four families of splits, a model and three baselines, guards, fold reports and a refusing report.

Baselines of a family that leaves units out come from sums by unit (all minus the unit) and from one pass of masked
nearest neighbours, so no fold is joined with all samples. Tails of sessions are known by where they begin. So baselines
guess where a sample is read, and poses are not shuffled. A model is fitted fold by fold on that fold's rows alone.
"""

from __future__ import annotations

import hashlib
import json
from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.errors import ExperimentError, LeakageError
from tidewave.model import Alignment, Measurement, Protocol, Split
from tidewave.operators import nearest, poses
from tidewave.plans.fitting import RowsFitter, SufficientFitter
from tidewave.plans.guards import Report, ReportSet, Row, Waiver, require_protocol, run_guards

#: (train, test) of one fold -> (sample_id, guess) for each test sample.
Predictor = Callable[[DataFrame, DataFrame], DataFrame]
#: samples -> (fold, sample_id, role); ValueError where the data has no such folds.
FoldBuilder = Callable[[DataFrame], DataFrame]


#: Tables of at most so many units or people are broadcast.
FEW = 20_000


@dataclass
class Family:
    """The folds of one split over samples: by units that are left out in turn, or as rows (fold, sample_id, role).

    ``tails``: where the tested tail of each session begins, if the rows of folds are these tails.
    ``few``: whether tables of a row for each person, session and device are known to be small.
    """

    samples: DataFrame
    split: Split
    folded: DataFrame | None = None
    tails: DataFrame | None = None
    few: bool = False

    @classmethod
    def of(cls, samples: DataFrame, split: Split, builder: FoldBuilder | None = None) -> Family:
        rows = poses.keyed(samples)
        few = rows.select("participant", "who", "skey", "device").distinct().limit(FEW + 1).count() <= FEW
        if builder is None and split is not Split.WITHIN_SESSION:
            out = cls(rows, split, few=few)
            if out.units().limit(1).count() == 0:
                raise ValueError(f"no folds of {split.name}")
            leak = poses.unit_leaks(rows, split).limit(1).collect()
            if leak:
                raise LeakageError(f"{split.name}: {leak[0].asDict()}")
            return out
        folded = builder(samples) if builder else poses.folds(samples, split)
        if folded.limit(1).count() == 0 or folded.groupBy("fold").agg(F.countDistinct("role").alias("r")).where("r < 2").limit(1).count():
            raise ValueError(f"no folds of {split.name}")
        if builder and poses.index_faults(folded, samples).limit(1).count():
            raise ExperimentError("folds name samples twice or that do not exist")
        poses.require_no_leakage(folded, samples, split)
        return cls(rows, split, folded, None if builder else poses.tail_starts(rows), few)

    def small(self, frame: DataFrame) -> DataFrame:
        """A table of units or people, broadcast where it is known to be small."""
        return F.broadcast(frame) if self.few else frame

    @property
    def by_unit(self) -> bool:
        return self.folded is None

    def units(self) -> DataFrame:
        """(within, unit): what is left out in turn, one row for each person, session or device with others beside it."""
        unit, within = poses.unit_of(self.split)
        every = self.samples.select(*within, unit).distinct()
        n = every.groupBy(*within).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        return every.join(self.small(n), within, "left_semi") if within else every.join(F.broadcast(n.withColumn("some", F.lit(True))), F.lit(True)).drop("some")  # one row

    def test(self) -> DataFrame:
        """Test rows of all folds, each with its ``fold``."""
        if self.by_unit:
            unit, within = poses.unit_of(self.split)
            return self.samples.join(self.small(self.units()), [*within, unit], "left_semi").withColumn("fold", F.col(unit))
        if self.tails is not None:
            return self._placed("test")
        return self.folded.where("role = 'test'").select("fold", "sample_id").join(self.samples, "sample_id")

    def train(self) -> DataFrame:
        """Training rows of all folds that are given as rows."""
        if self.tails is not None:
            return self._placed("train")
        return self.folded.where("role = 'train'").select("fold", "sample_id").join(self.samples, "sample_id")

    def _placed(self, role: str) -> DataFrame:
        """Rows of one side where folds are the tails of sessions."""
        rows = self.samples.join(self.small(self.tails), "skey")
        tested = F.struct("ts", "sample_id") >= F.col("tail")
        return rows.where(tested if role == "test" else ~tested).select(F.col("skey").alias("fold"), *self.samples.columns)

    def names(self) -> list[str]:
        rows = self.units().select(F.col(poses.unit_of(self.split)[0]).alias("fold")) if self.by_unit else self.folded.select("fold")
        return sorted(r["fold"] for r in rows.distinct().collect())

    def side(self, fold: str, role: str) -> DataFrame:
        """One side of one fold."""
        if self.by_unit:
            unit, within = poses.unit_of(self.split)
            inside = self.samples
            for c in within:
                one = self.samples.where(F.col(unit) == fold).select(c).limit(1)
                inside = inside.join(F.broadcast(one), c, "left_semi")
            return inside.where(F.col(unit) == fold if role == "test" else F.col(unit) != fold)
        ids = self.folded.where((F.col("fold") == fold) & (F.col("role") == role)).select("sample_id")
        return self.samples.join(ids, "sample_id", "left_semi")

    def identity(self) -> tuple[int, int, str]:
        """Training and test rows summed over folds, and one hash of what every fold holds.

        Of a unit that is left out only its own rows are hashed: its training rows are all others in its scope.
        """
        if self.by_unit:
            unit, within = poses.unit_of(self.split)
            held = self.test()
            rows = held.select("fold", "sample_id", F.lit("test").alias("role"))
            scope = self.samples.groupBy(*within).agg(F.count("*").alias("all"))
            tested = held.groupBy(*within, "fold").agg(F.count("*").alias("n"))
            met = tested.join(scope, within) if within else tested.join(F.broadcast(scope), F.lit(True))  # one row
            sides = met.agg(F.sum(F.col("all") - F.col("n")).alias("train"), F.sum("n").alias("test")).first()
            more = [str(self.samples.count())]
        else:
            rows, more = self.folded, []
            sides = rows.agg(F.sum((F.col("role") == "train").cast("long")).alias("train"), F.sum((F.col("role") == "test").cast("long")).alias("test")).first()
        of_folds = poses.split_fingerprint(rows, self.samples).select(F.concat_ws("|", "fold", "role", F.col("n").cast("string"), "fingerprint").alias("h"))
        said = sorted(r["h"] for r in of_folds.collect())  # a row for each fold and side
        return sides["train"], sides["test"], hashlib.sha256("\n".join([*more, *said]).encode()).hexdigest()

    def means(self) -> DataFrame:
        """(fold, guess): the mean training pose of each fold."""
        if self.by_unit:
            unit, within = poses.unit_of(self.split)
            return poses.left_out_means(self.samples, unit, within).select(F.col(unit).alias("fold"), F.col("mean_pose").alias("guess"))
        return poses.vector_sums(self.train(), ["fold"]).select("fold", poses.mean_vector(F.col("sums"), F.col("n")).alias("guess"))

    def subject_means(self) -> DataFrame:
        """(fold, participant, own): the mean training pose of each person in each fold where they have any."""
        if self.by_unit:
            unit, _ = poses.unit_of(self.split)
            return poses.left_out_means(self.samples, unit, ["participant"]).select(F.col(unit).alias("fold"), "participant", F.col("mean_pose").alias("own"))
        return poses.vector_sums(self.train(), ["fold", "participant"]).select("fold", "participant", poses.mean_vector(F.col("sums"), F.col("n")).alias("own"))

    def nearest(self) -> DataFrame:
        """(fold, sample_id, nearest_id, guess, pose): the nearest training sample of each test sample's fold by features."""
        if self.by_unit or self.tails is not None:
            return nearest_of([self]).drop("split")
        columns = ["fold", "sample_id", "features", "pose"]
        return nearest.search(self.train().select(*columns), self.test().select(*columns), [(["fold"], [])], [F.col("fold")]).drop("rule", "d2")


def nearest_of(families: list[Family]) -> DataFrame:
    """(split, fold, sample_id, nearest_id, guess, pose): ``Family.nearest`` of families by units or tails over the same
    samples, all in one pass."""
    rows, rules, folds = families[0].samples, [], []
    for family in families:
        if family.by_unit:
            unit, within = poses.unit_of(family.split)
            rules.append((within, [unit]))
            folds.append(F.when(F.col(unit).isNotNull() & reduce(and_, (F.col(c).isNotNull() for c in within), F.lit(True)), F.col(unit)))
        else:
            rows = rows.join(family.small(family.tails), "skey", "left").withColumn("tested", F.struct("ts", "sample_id") >= F.col("tail"))
            rules.append((["skey"], ["tested"]))
            folds.append(F.when(F.col("tested"), F.col("skey")))
    found = nearest.search(rows, None, rules, folds)
    names = F.array(*[F.lit(f.split.name.lower()) for f in families])
    return found.select(F.element_at(names, F.col("rule") + 1).alias("split"), "fold", "sample_id", "nearest_id", "guess", "pose")


class Baseline(ABC):
    """Something to beat: fitted on a family's training rows, it guesses every test sample."""

    name: str

    @abstractmethod
    def fit_predict(self, family: Family) -> DataFrame | None:
        """(fold, sample_id, guess), or None where the samples do not have what it needs.

        With the sample's ``pose`` beside the guess it need not be joined again.
        """


class MeanPose(Baseline):
    name = "mean-pose"

    def fit_predict(self, family: Family) -> DataFrame:
        return family.test().select("fold", "sample_id", "pose").join(family.small(family.means()), "fold")


class SubjectMean(Baseline):
    """A person's own mean, the mean of all for people without training rows."""

    name = "subject-mean"

    def fit_predict(self, family: Family) -> DataFrame:
        test = family.test().select("fold", "sample_id", "participant", "pose")
        met = test.join(family.small(family.means()), "fold").join(family.small(family.subject_means()), ["fold", "participant"], "left")
        return met.select("fold", "sample_id", F.coalesce("own", "guess").alias("guess"), "pose")


class NearestNeighbour(Baseline):
    """The pose of the training sample with the nearest features; left out without features."""

    name = "nearest-neighbour"

    def fit_predict(self, family: Family) -> DataFrame | None:
        if not has_features(family.samples):
            return None
        return family.nearest().select("fold", "sample_id", "guess", "pose")


def has_features(samples: DataFrame) -> bool:
    return "features" in samples.columns and not samples.where("features IS NULL").limit(1).count()


BASELINES: tuple[Baseline, ...] = (MeanPose(), SubjectMean(), NearestNeighbour())


def fold_means(train: DataFrame, test: DataFrame) -> DataFrame:
    """A predictor that says the mean training pose."""
    mean = poses.vector_sums(train, []).select(poses.mean_vector(F.col("sums"), F.col("n")).alias("guess"))
    return test.select("sample_id").join(F.broadcast(mean), F.lit(True))  # one row


def predictions(family: Family, model: str, predict: Predictor | SufficientFitter | RowsFitter, baselines: tuple[Baseline, ...] = BASELINES) -> tuple[DataFrame, list[str]]:
    """(predictor, fold, sample_id, guess) of the model and of the baselines that can be had.

    A fitter fits all folds in one plan; a plain predictor is asked fold by fold.
    """
    said, names = None, [model]
    if isinstance(predict, SufficientFitter | RowsFitter):
        said = predict.predictions(family).select(F.lit(model).alias("predictor"), "fold", "sample_id", "guess")
    else:
        for fold in family.names():
            part = predict(family.side(fold, "train"), family.side(fold, "test")).select(F.lit(model).alias("predictor"), F.lit(fold).alias("fold"), "sample_id", "guess")
            said = part if said is None else said.unionByName(part)
    for baseline in baselines:
        part = baseline.fit_predict(family)
        if part is not None:
            names.append(baseline.name)
            said = said.unionByName(part.select(F.lit(baseline.name).alias("predictor"), "fold", "sample_id", "guess"))
    return said, names


def fold_metrics(family: Family, said: DataFrame, threshold_mm: float = 20.0) -> DataFrame:
    """(predictor, fold, samples, mpjpe, ...) with the error after a similarity fit as ``pa_mpjpe``."""
    met = said.join(family.test().select("fold", "sample_id", "pose"), ["fold", "sample_id"])
    errors = met.select("predictor", "fold", poses.joint_errors(F.col("guess"), F.col("pose"), Alignment.ROOT).alias("err"), poses.procrustes(F.col("guess"), F.col("pose")).alias("fit"), "pose")
    errors = errors.withColumn("fit", poses.mean_of(poses.joint_errors(F.col("fit"), F.col("pose"), Alignment.NONE)))
    fitted = errors.groupBy("predictor", "fold").agg(F.avg("fit").alias("pa_mpjpe"))
    return poses.metrics(errors, ["predictor", "fold"], threshold_mm).join(fitted, ["predictor", "fold"])


def baseline_metrics(samples: DataFrame, threshold_mm: float = 20.0) -> DataFrame:
    """(split, predictor, fold, samples, mpjpe, ...) of the three baselines in all folds of all four families.

    Means of all folds come from one table of sums by person, session, device and side of a tail, and meet every sample
    where it is read; neighbours are met where they are found. What is shuffled are the blocks of the search, once, and
    sums.
    """
    families = [Family.of(samples, split) for split in Split]
    tails = next(f for f in families if not f.by_unit)
    rows = tails.samples.join(tails.small(tails.tails), "skey", "left").withColumn("tested", F.struct("ts", "sample_id") >= F.col("tail"))
    sums = poses.vector_sums(rows, ["participant", "who", "skey", "device", "tested"])

    def sides(frame: DataFrame) -> DataFrame:
        """Each row once for each family: of what is in ``scope``, its folds leave out ``unit``, if ``asks``."""
        each = []
        for f in families:
            unit, within = poses.unit_of(f.split) if f.by_unit else ("tested", ["skey"])
            fold, asks = (unit, F.lit(True)) if f.by_unit else ("skey", F.col("tested"))
            each.append(F.struct(F.lit(f.split.name.lower()).alias("split"), (F.col(within[0]) if within else F.lit("")).alias("scope"), F.col(unit).cast("string").alias("unit"), F.col(fold).alias("fold"), asks.alias("asks")))
        return frame.withColumn("side", F.explode(F.array(*each))).select("*", "side.*").drop("side")

    def left_out(within: list[str], name: str) -> DataFrame:
        return tails.small(poses.left_out_means(sides(sums), "unit", ["split", "scope", *within], True).withColumnRenamed("mean_pose", name))

    asking = sides(rows.select("participant", "who", "skey", "device", "tested", "pose")).where("asks")
    met = asking.join(left_out([], "overall"), ["split", "scope", "unit"]).join(left_out(["participant"], "own"), ["split", "scope", "participant", "unit"], "left")
    guesses = F.array(*[F.struct(F.lit(b.name).alias("predictor"), g.alias("guess")) for b, g in ((MeanPose, F.col("overall")), (SubjectMean, F.coalesce("own", "overall")))])
    said = [met.select("split", "fold", "pose", F.explode(guesses).alias("x")).select("split", "fold", "pose", "x.*")]
    if has_features(tails.samples):
        said.append(nearest_of(families).withColumn("predictor", F.lit(NearestNeighbour.name)))
    errors = [s.select("split", "predictor", "fold", poses.joint_errors(F.col("guess"), F.col("pose")).alias("err")) for s in said]
    return poses.metrics(reduce(DataFrame.unionByName, errors), ["split", "predictor", "fold"], threshold_mm)


#: Numbers of a row, each the mean over samples, so that folds pool by their numbers of samples.
NUMBERS = ("mpjpe", "mpjpe_excl_root", "pa_mpjpe", "fingertips", "rest", "pck", "pck_excl_root")


def pooled(folds: list[dict]) -> dict:
    """All folds of a predictor as one, with the spread of its folds."""
    n = sum(f["samples"] for f in folds)
    out = {k: sum(f[k] * f["samples"] for f in folds) / n for k in NUMBERS} | {"samples": n}
    out["per_joint"] = [sum(f["per_joint"][j] * f["samples"] for f in folds) / n for j in range(poses.N_JOINTS)]
    by = sorted(f["mpjpe"] for f in folds)
    middle = (by[len(by) // 2] + by[(len(by) - 1) // 2]) / 2
    out["folds"] = f"{len(by)} folds: {by[0]:.2f} / {middle:.2f} / {by[-1]:.2f} mm (least, median, most)"
    return out


def stamped(protocol: Protocol, *notes: str) -> Protocol:
    """A protocol with notes added to its own, separated by semicolons."""
    return replace(protocol, notes="; ".join(n for n in (protocol.notes, *notes) if n))


@dataclass
class Experiment:
    """The report of one split, the reports of its folds, and the predictions behind them."""

    report: Report
    folds: dict[str, Report]
    said: DataFrame
    notes: dict[str, str] = field(default_factory=dict)

    def as_dict(self) -> dict:
        return {"report": json.loads(self.report.as_json()), "folds": {k: json.loads(r.as_json()) for k, r in self.folds.items()}, "notes": self.notes}

    def write(self, folder: str) -> None:
        """report.txt and report.json, the same under folds/NN for every fold, and predictions as Parquet."""
        for at, report in [(Path(folder), self.report), *((Path(folder) / "folds" / f"{i:02d}", r) for i, r in enumerate(self.folds.values()))]:
            at.mkdir(parents=True, exist_ok=True)
            (at / "report.txt").write_text(report.text() + "\n")
            (at / "report.json").write_text(report.as_json() + "\n")
        write_predictions(self.said, self.report.protocol.split, f"{folder}/predictions")


def measure(samples: DataFrame, split: Split, protocol: Protocol, model: str, predict: Predictor, builder: FoldBuilder | None = None, baselines: tuple[Baseline, ...] = BASELINES, waivers: tuple[Waiver, ...] = ()) -> Experiment:
    """One family: the model and the baselines refitted in every fold, pooled, and guarded, under a protocol of its split."""
    require_protocol(protocol, split)
    family = Family.of(samples, split, builder)
    said, names = predictions(family, model, predict, baselines)
    numbers: dict[str, dict[str, dict]] = {n: {} for n in names}
    for r in fold_metrics(family, said).collect():  # a row for each predictor and fold
        numbers[r["predictor"]][r["fold"]] = r.asDict()
    wanted = {r["fold"]: r["count"] for r in family.test().groupBy("fold").count().collect()}
    report, folds, notes = Report(), {f: Report() for f in sorted(wanted)}, {}
    for name in names:
        kind = "model" if name == model else "baseline"
        if {f: x["samples"] for f, x in numbers[name].items()} != wanted:
            raise ExperimentError(f"{name} did not predict every test sample once")
        for fold, x in numbers[name].items():
            folds[fold].add(Row(name, kind, Measurement(x["mpjpe"], "mm", protocol, x["samples"]), {k: x[k] for k in NUMBERS[1:]} | {"per_joint": x["per_joint"]}))
        x = pooled(list(numbers[name].values()))
        notes[name] = x["folds"]
        report.add(Row(name, kind, Measurement(x["mpjpe"], "mm", protocol, x["samples"]), {k: x[k] for k in NUMBERS[1:]} | {"per_joint": x["per_joint"]}))
    report.attach(run_guards(family, said.where(F.col("predictor") == model), protocol, waivers))
    return Experiment(report, folds, said, notes)


def cross_user(samples: DataFrame, protocol: Protocol, model: str, predict: Predictor, **options) -> Experiment:
    return measure(samples, Split.CROSS_USER, protocol, model, predict, **options)


def run_suite(samples: DataFrame, protocol: Protocol, model: str, predict: Predictor, **options) -> ReportSet:
    """All four families, each under the protocol with its own split and nothing else replaced.

    A family that the data cannot give is an absence; leakage is never caught.
    """
    out = ReportSet()
    for split in Split:
        try:
            done = measure(samples, split, replace(protocol, split=split), model, predict, **options)
        except ValueError as e:
            out.absences[split] = str(e)
            continue
        out.add(done.report)
        out.experiments[split] = done
    return out


def write_suite(reports: ReportSet, folder: str) -> None:
    root = Path(folder)
    for split, done in reports.experiments.items():
        done.write(str(root / "splits" / split.name.lower()))
    root.mkdir(parents=True, exist_ok=True)
    (root / "report.txt").write_text(f"{reports.headline()}\n\n{reports.table()}\n")
    (root / "report.json").write_text(reports.as_json() + "\n")


def write_predictions(said: DataFrame, split: Split, folder: str) -> None:
    """Predictions as Parquet by split and fold."""
    said.withColumn("split", F.lit(split.name.lower())).write.mode("overwrite").partitionBy("split", "fold").parquet(folder)
