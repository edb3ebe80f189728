"""Normalizers, checkpoints and their provenance. The network itself is injected."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from pathlib import Path

import numpy as np

from tidewave.errors import CheckpointLoadError, NormalizationError, PredictorError, TrainingError
from tidewave.model import Descriptor

SCHEMA, BUNDLE, NORMALIZER = "checkpoint/2", "bundle/2", "normalization/1"


@dataclass(frozen=True)
class Normalizer:
    """Means and population deviations, of channels or of pose coordinates."""

    mean: tuple[float, ...]
    sd: tuple[float, ...]

    def __post_init__(self) -> None:
        if len(self.mean) != len(self.sd) or not np.isfinite([*self.mean, *self.sd]).all() or min(self.sd, default=0) <= 0:
            raise NormalizationError("as many finite means as positive deviations")

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (x - np.array(self.mean)) / np.array(self.sd)

    def undo(self, x: np.ndarray) -> np.ndarray:
        return x * np.array(self.sd) + np.array(self.mean)

    def as_json(self) -> dict:
        return {"schema": NORMALIZER, "mean": list(self.mean), "sd": list(self.sd)}

    @classmethod
    def from_json(cls, data: dict) -> Normalizer:
        if data.get("schema") != NORMALIZER:
            raise NormalizationError(f"unknown schema {data.get('schema')!r}")
        return cls(tuple(data["mean"]), tuple(data["sd"]))


def predictor(backend, features: Normalizer, pose: Normalizer):
    """(b, channels, bins, frames) -> wrist-relative (b, 63) through a backend on standardised values."""

    def predict(x: np.ndarray) -> np.ndarray:
        shape = (1, len(features.mean)) + (1,) * (x.ndim - 2)
        z = (x - np.array(features.mean).reshape(shape)) / np.array(features.sd).reshape(shape)
        y = np.asarray(backend(z))
        if y.shape != (len(x), 63) or not np.isfinite(y).all():
            raise PredictorError(f"backend gave shape {y.shape}")
        y = pose.undo(y).reshape(-1, 21, 3)
        return (y - y[:, :1]).reshape(-1, 63)

    return predict


@dataclass(frozen=True)
class TrainingConfig:
    """Settings of a training run; the network itself is injected."""

    epochs: int
    batch_size: int
    learning_rate: float
    weight_decay: float = 0.0
    seed: int = 0

    def __post_init__(self) -> None:
        if self.epochs < 1 or self.batch_size < 1 or not 0 < self.learning_rate < float("inf") or self.weight_decay < 0:
            raise TrainingError("epochs, batches and the rate are positive, decay is not negative")

    def order(self, epoch: int, samples: int) -> np.ndarray:
        """The seeded order of samples of an epoch."""
        return np.random.default_rng([self.seed, epoch]).permutation(samples)


def require_history(losses: list[float], config: TrainingConfig) -> None:
    """One finite loss for each epoch: training neither stops early nor diverges silently."""
    if len(losses) != config.epochs or not np.isfinite(losses).all():
        raise TrainingError(f"{len(losses)} losses for {config.epochs} epochs")


def fit_normalizers(train) -> tuple[Normalizer, Normalizer]:
    """Normalizers of features and wrist-relative poses of training samples alone, from one pass of vector sums."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    from pyspark.sql import functions as F

    from tidewave.operators import poses

    out = []
    for column in (F.col("features").cast("array<double>"), poses.wrist_relative(F.col("pose"))):
        v = array_to_vector(column)
        row = train.select(v.alias("v")).agg(F.count("*").alias("n"), vector_to_array(Summarizer.mean(F.col("v"))).alias("m"), vector_to_array(Summarizer.std(F.col("v"))).alias("s")).first()
        if row["n"] < 2:
            raise TrainingError("fewer than two training samples")
        out.append(Normalizer(tuple(row["m"]), tuple(max(1e-6, s * ((row["n"] - 1) / row["n"]) ** 0.5) for s in row["s"])))
    return out[0], out[1]


def write_metadata(path: str, model: str, descriptor: Descriptor, protocol, weights: str) -> None:
    """Checkpoint metadata beside exported weights, with their digest."""
    Path(path).write_text(json.dumps({"schema": SCHEMA, "model": model, "weights_sha256": digest(weights), "descriptor": _plain(descriptor), "protocol": protocol.describe()}, indent=2) + "\n")


def read_metadata(path: str, model: str | None = None) -> dict:
    """Metadata of a known schema, of ``model`` if one is given."""
    data = json.loads(Path(path).read_text())
    if data.get("schema") != SCHEMA:
        raise CheckpointLoadError(f"unknown schema {data.get('schema')!r}")
    if model is not None and data["model"] != model:
        raise CheckpointLoadError(f"{data['model']} is not {model}")
    return data


def model_width(model: str) -> int:
    """The width that a model's name states: ``pose-cnn/1,width=W``."""
    family, _, width = model.partition(",width=")
    if family != "pose-cnn/1" or not width.isdigit() or not int(width):
        raise CheckpointLoadError(f"unknown model {model!r}")
    return int(width)


def digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            h.update(part)
    return h.hexdigest()


def _plain(descriptor: Descriptor) -> dict:
    return json.loads(json.dumps(asdict(descriptor)))


def write_bundle(path: str, weights: str, descriptor: Descriptor, model: str, features: Normalizer, pose: Normalizer) -> None:
    Path(path).write_text(json.dumps({"schema": BUNDLE, "model": model, "weights": Path(weights).name, "weights_sha256": digest(weights), "descriptor": _plain(descriptor), "features": features.as_json(), "pose": pose.as_json()}, indent=2) + "\n")


def read_bundle(path: str, descriptor: Descriptor) -> dict:
    """A bundle whose schema, preparation and weights are as expected, checked in this order."""
    data = json.loads(Path(path).read_text())
    if data.get("schema") != BUNDLE:
        raise CheckpointLoadError(f"unknown schema {data.get('schema')!r}")
    expected = _plain(descriptor)
    wrong = [k for k in expected if data["descriptor"].get(k) != expected[k]]
    if wrong:
        raise CheckpointLoadError(f"prepared otherwise: {', '.join(wrong)}")
    weights = Path(path).parent / data["weights"]
    if digest(str(weights)) != data["weights_sha256"]:
        raise CheckpointLoadError("the weights are not those of the bundle")
    return data | {"weights": str(weights), "features": Normalizer.from_json(data["features"]), "pose": Normalizer.from_json(data["pose"])}
