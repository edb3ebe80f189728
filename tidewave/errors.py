"""Errors by what they refuse."""


class TidewaveError(Exception):
    """Base of all errors of this engine."""


class LeakageError(AssertionError):
    """Training and test data overlap; never caught by the engine."""


class ExperimentError(TidewaveError):
    """An experiment is inconsistent."""


class GuardViolation(TidewaveError):
    """A guard failed and no valid waiver covers it."""


class IntegrityError(TidewaveError):
    """Files differ from their manifest."""


class DatasetError(TidewaveError):
    """A session tree or its records are malformed."""


class MissingLandmarksError(DatasetError):
    """Landmarks are absent or incomplete."""


class PreprocessingMismatchError(TidewaveError):
    """Data was prepared in another way than expected."""


class WireError(TidewaveError):
    """A wire frame is malformed."""


class TruncatedFrameError(WireError):
    """The stream ended inside a frame."""


class SessionError(TidewaveError):
    """A capture session ended badly; ``packets`` counts what arrived before."""

    def __init__(self, message: str, packets: int = 0):
        super().__init__(message)
        self.packets = packets


class SynchronizationError(TidewaveError):
    """Samples cannot be aligned to chirps."""


class LiveCaptureError(TidewaveError):
    """A live capture breaks its contract."""


class CaptureProcessingError(TidewaveError):
    """Frames cannot form a window."""


class WireFormatError(TidewaveError):
    """A JSON frame has another type or version."""


class InferenceError(TidewaveError):
    """A predictor got or gave wrong values."""


class NormalizationError(TidewaveError):
    """Statistics of a normalizer are unusable."""


class PredictorError(TidewaveError):
    """A backend returned a wrong shape or values that are not finite."""


class CheckpointLoadError(TidewaveError):
    """A checkpoint does not belong to what is asked of it."""


class ModelUnavailableError(TidewaveError):
    """No backend for the model is installed."""


class TrainingError(TidewaveError):
    """Training data or settings are unusable."""


class LandmarkPreparationError(TidewaveError):
    """A video gave no complete landmarks."""


class ResonanceFitError(TidewaveError):
    """No resonance could be fitted."""


class OverclaimError(TidewaveError):
    """A claim goes beyond what the channel can carry."""


class ClassMergeError(TidewaveError):
    """A merged class was asked to be told apart again."""
