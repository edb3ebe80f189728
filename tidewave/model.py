"""Fixed vocabulary, the chirp, protocols and measurements."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from enum import Enum, IntEnum

from tidewave.errors import PreprocessingMismatchError

SPEED_OF_SOUND = 343.0

# Names of the 21 joints in order.
JOINTS = tuple("wrist thumb_cmc thumb_mcp thumb_ip thumb_tip index_mcp index_pip index_dip index_tip middle_mcp middle_pip middle_dip middle_tip ring_mcp ring_pip ring_dip ring_tip pinky_mcp pinky_pip pinky_dip pinky_tip".split())
TIPS = tuple(i for i, name in enumerate(JOINTS) if name.endswith("_tip"))


class Split(IntEnum):
    """Families of splits, weakest first."""

    WITHIN_SESSION = 0
    CROSS_SESSION = 1
    CROSS_USER = 2
    CROSS_DEVICE = 3

    @property
    def is_honest(self) -> bool:
        return self is not Split.WITHIN_SESSION

    @property
    def is_population(self) -> bool:
        return self in (Split.CROSS_USER, Split.CROSS_DEVICE)


class GroundTruth(str, Enum):
    MOTION_CAPTURE = "motion-capture"
    VIDEO_FITTED = "video-fitted"
    GLOVE = "glove"
    SYNTHETIC = "synthetic"


class Alignment(str, Enum):
    NONE = "none"
    ROOT = "root"
    PROCRUSTES = "procrustes"

    def describe(self) -> str:
        return {"none": "no alignment", "root": "wrist moved to the origin", "procrustes": "similarity fit of each frame"}[self.value]


class Normalisation(str, Enum):
    NONE = "none"
    PEAK = "peak"
    L2 = "l2"


class Phase(str, Enum):
    """Which of its two frames a difference is dated by."""

    LATER = "later"
    EARLIER = "earlier"


class Device(str, Enum):
    SAMSUNG = "samsung"
    XIAOMI = "xiaomi"


class Hand(str, Enum):
    LEFT = "left"
    RIGHT = "right"


class Study(IntEnum):
    ONE = 1
    TWO = 2
    THREE = 3
    FOUR = 4


class GuardName(str, Enum):
    CONCENTRATION = "participant-concentration"
    LABEL_MATCH = "label-match"
    EVALUATION_SIZE = "evaluation-size"


@dataclass(frozen=True)
class Chirp:
    """A linear sweep; the settings of all signal operators."""

    f_start: float = 18000.0
    f_end: float = 21000.0
    duration: float = 0.0125
    rate: int = 48000

    def __post_init__(self) -> None:
        if not (0 < self.f_start < self.f_end <= self.rate / 2) or self.duration <= 0:
            raise ValueError("a chirp needs 0 < f_start < f_end, at most half the rate, and a positive duration")

    @property
    def bandwidth(self) -> float:
        return self.f_end - self.f_start

    @property
    def n_samples(self) -> int:
        return round(self.duration * self.rate)

    @property
    def frame_rate(self) -> float:
        return 1 / self.duration

    @property
    def bin_metres(self) -> float:
        return SPEED_OF_SOUND / (2 * self.rate)

    @property
    def range_resolution(self) -> float:
        return SPEED_OF_SOUND / (2 * self.bandwidth)

    @property
    def max_range(self) -> float:
        return SPEED_OF_SOUND * self.duration / 2

    @property
    def wavelength(self) -> float:
        return SPEED_OF_SOUND / ((self.f_start + self.f_end) / 2)


@dataclass(frozen=True)
class Descriptor:
    """How windows are made; two data sets mix only if these are equal."""

    chirp: Chirp = Chirp()
    crop_bins: int = 60
    window_frames: int = 96
    bin_zero_offset: int = 0
    differential_lag: int = 2
    phase: Phase = Phase.LATER
    normalisation: Normalisation = Normalisation.PEAK
    schema: str = "preprocessing/1"

    def __post_init__(self) -> None:
        if min(self.crop_bins, self.window_frames, self.differential_lag) < 1 or self.bin_zero_offset < 0:
            raise ValueError("sizes and the lag are positive and the offset is not negative")

    def with_(self, **changes) -> Descriptor:
        """A copy with other settings."""
        return replace(self, **changes)

    def differential_column(self, index: int) -> int:
        """The column of the stored differences that belongs to a column of the profiles."""
        return index - self.differential_lag

    def require_match(self, other: Descriptor) -> None:
        wrong = [f"{f}: {getattr(self, f)!r} is not {getattr(other, f)!r}" for f in self.__dataclass_fields__ if getattr(self, f) != getattr(other, f)]
        if wrong:
            raise PreprocessingMismatchError("; ".join(wrong))


@dataclass(frozen=True)
class Protocol:
    """What a number was measured under; no number goes without one."""

    split: Split
    dataset: str
    dataset_version: str
    ground_truth: GroundTruth
    subjects: int
    calibration_minutes: float = 0.0
    held_out_poses: bool = False
    seed: int = 0
    notes: str = ""

    def __post_init__(self) -> None:
        if not self.dataset.strip() or not self.dataset_version.strip() or self.subjects < 1 or self.calibration_minutes < 0:
            raise ValueError("a protocol names its dataset and version, one subject or more, and no negative calibration")

    def at_calibration(self, minutes: float) -> Protocol:
        return replace(self, calibration_minutes=minutes)

    def describe(self) -> str:
        parts = [f"{self.split.name.lower().replace('_', '-')} on {self.dataset} {self.dataset_version}", f"{self.subjects} subjects", f"labels {self.ground_truth.value}", f"{self.calibration_minutes:g} min calibration"]
        return ", ".join(parts + ["held-out poses"] * self.held_out_poses + [self.notes] * bool(self.notes))


@dataclass(frozen=True)
class Measurement:
    value: float
    unit: str
    protocol: Protocol
    samples: int

    def __post_init__(self) -> None:
        if self.samples < 1 or math.isnan(self.value):
            raise ValueError("a measurement is a number over one sample or more")

    def comparable_to(self, other: Measurement) -> bool:
        a, b = self.protocol, other.protocol
        return self.unit == other.unit and (a.split, a.ground_truth, a.calibration_minutes, a.notes) == (b.split, b.ground_truth, b.calibration_minutes, b.notes)


# Clap modes with centre frequency and bandwidth in Hz, and the class each merges into.
CLAP_MODES = {
    "A1+": (500.0, 110.0, "cupped-deep"),
    "A1": (794.0, 180.0, "cupped-natural"),
    "P2": (850.0, 130.0, "cupped-natural"),
    "A1-": (1010.0, 210.0, "flat"),
    "P1": (1063.0, 150.0, "flat"),
    "A2": (1120.0, 240.0, "flat"),
    "A3": (1350.0, 300.0, "fingers-to-palm"),
    "P3": (1562.0, 380.0, "fingers-to-palm"),
}
CLAP_CLASSES = ("cupped-deep", "cupped-natural", "flat", "fingers-to-palm")
CONFUSABLE = (("P1", "A2"), ("P2", "A1"))
PROTOTYPE_SDS = (0.035, 0.13)

# Arm pose freedom and resolution, and bits of one impulse.
ARM_DOF, ARM_RESOLUTION_DEG, ARM_RANGE_DEG = 7, 5.0, 120.0
IMPULSE_BITS, HAND_BITS = (5.0, 10.0), (1.5, 2.0)
