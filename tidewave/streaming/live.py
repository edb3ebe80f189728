"""Live capture: chirp synchroniser, window assembler, guards, and their Spark forms.

The state machines are plain classes that take chunks in order. ``aligned_frames`` runs the synchroniser over sorted
partitions of a batch and ``assembled_windows`` the assembler over blocks of frames, holding one batch of rows at a time; ``SyncProcessor`` runs the synchroniser with
state that Spark keeps between micro-batches; ``Pipeline`` is the way of one connection from packets to poses.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidewave.errors import CaptureProcessingError, InferenceError, LiveCaptureError, SynchronizationError
from tidewave.functions import dsp
from tidewave.model import Chirp, Descriptor
from tidewave.operators.frames import BLOCK, blocked
from tidewave.operators.ordering import placed

GAP_S, LEAST_SCORE, CHECK_EVERY, SLIP = 0.030, 0.4, 80, 2
RATE_TOLERANCE, LOCK_TIMEOUT_S = 0.02, 3.0


#: The synchroniser's fields between micro-batches.
SYNC_STATE = "pending binary, start_s double, next_s double, taken long, received long, locked boolean, continuous boolean, frames long, since_check int, last_observed double"


@dataclass
class Synchronizer:
    """Cuts a stream of chunks into chirp-aligned frames.

    A chunk whose time is over 30 ms from the end of the one before it starts anew; slow drift does not, and shows in the
    observed rate, over two seconds or more from the first chunk. Unlocked, the best offset with a
    normalised correlation of 0.4 or more locks. Every 80 frames the lock is scored again on two frames: a slip of
    more than 2 samples is corrected and marks a break, a low score unlocks.
    """

    chirp: Chirp = field(default_factory=Chirp)
    pending: np.ndarray = field(default_factory=lambda: np.zeros(0))
    start_s: float | None = None
    next_s: float | None = None
    taken: int = 0
    received: int = 0
    locked: bool = False
    continuous: bool = False
    frames: int = 0
    since_check: int = 0
    last_observed: float | None = None

    def push(self, samples: np.ndarray, timestamp_s: float, rate: int) -> list[tuple[float, bool, np.ndarray]]:
        if rate != self.chirp.rate:
            raise SynchronizationError(f"rate {rate} is not {self.chirp.rate}")
        x = np.asarray(samples)
        x = x / (np.iinfo(x.dtype).max + 1) if np.issubdtype(x.dtype, np.integer) else x.astype(float)
        if self.next_s is None or abs(timestamp_s - self.next_s) > GAP_S:
            self.pending, self.start_s, self.taken, self.received = np.zeros(0), timestamp_s, 0, 0
            self.locked = self.continuous = False
        elif timestamp_s - self.start_s >= 2:
            self.last_observed = self.received / (timestamp_s - self.start_s)
        self.received += len(x)
        self.next_s = timestamp_s + len(x) / rate
        self.pending = np.concatenate([self.pending, x])
        return self._drain()

    def state(self) -> tuple:
        """All that the next chunk depends on, as ``SYNC_STATE``."""
        return (self.pending.astype("<f8").tobytes(), self.start_s, self.next_s, self.taken, self.received, self.locked, self.continuous, self.frames, self.since_check, self.last_observed)

    def restore(self, state: tuple) -> Synchronizer:
        pending, self.start_s, self.next_s, self.taken, self.received, self.locked, self.continuous, self.frames, self.since_check, self.last_observed = state
        self.pending = np.frombuffer(pending, "<f8")
        return self

    def _scores(self, x: np.ndarray, count: int) -> np.ndarray:
        n, ref = self.chirp.n_samples, dsp.reference(self.chirp)
        size = 1 << (len(x) + n).bit_length()
        corr = np.abs(np.fft.ifft(np.fft.fft(x, size) * np.conj(np.fft.fft(dsp.analytic(ref), size))))[:count]
        energy = np.concatenate([[0.0], np.cumsum(x * x)])
        local = np.sqrt(np.maximum(energy[n : n + count] - energy[:count], 0))
        return np.where(local > 0, corr / np.where(local > 0, local * np.linalg.norm(ref), 1), 0.0)

    def _drop(self, k: int) -> None:
        self.pending, self.taken = self.pending[k:], self.taken + k

    def _drain(self) -> list[tuple[float, bool, np.ndarray]]:
        out, n = [], self.chirp.n_samples
        while True:
            if not self.locked:
                count = len(self.pending) - n + 1
                if count < 1:
                    return out
                score = self._scores(self.pending, count)
                best = int(score.argmax())
                if score[best] < LEAST_SCORE:
                    self._drop(len(self.pending) - (n - 1))
                    return out
                # a frame is scored best only when a whole period has been seen
                if count < n:
                    return out
                best = int(score[:n].argmax()) if score[:n].max() >= LEAST_SCORE else best
                self._drop(best)
                self.locked, self.continuous, self.since_check = True, False, 0
            if self.since_check >= CHECK_EVERY:
                if len(self.pending) < 2 * n:
                    return out
                score = self._scores(self.pending[: 2 * n], n)
                best = int(score.argmax())
                if score[best] < LEAST_SCORE:
                    self.locked = self.continuous = False
                    continue
                slip = best if best <= n // 2 else best - n
                if abs(slip) > SLIP:
                    self._drop(slip % n)
                    self.continuous = False
                self.since_check = 0
            if len(self.pending) < n:
                return out
            out.append((self.start_s + self.taken / self.chirp.rate, self.continuous, self.pending[:n].astype(np.float32)))
            self._drop(n)
            self.frames += 1
            self.since_check += 1
            self.continuous = True

    def status(self) -> dict:
        need = self.chirp.n_samples
        if self.locked:
            why = "locked" if self.continuous else "locked anew; the next frame marks a break"
        elif not self.received:
            why = "no samples"
        else:
            why = f"waiting for {need - len(self.pending)} more samples" if len(self.pending) < need else "no chirp found"
        return {"locked": self.locked, "frames": self.frames, "pending": len(self.pending), "observed_rate": self.last_observed, "reason": why}


@dataclass
class LiveGuard:
    """Refuses a stream whose rate is wrong or that stays unlocked for over 3 s."""

    chirp: Chirp = field(default_factory=Chirp)
    unlocked_since: float | None = None

    def check(self, sync: Synchronizer, declared_rate: int, now_s: float) -> None:
        if declared_rate != self.chirp.rate:
            raise LiveCaptureError(f"declared rate {declared_rate} is not {self.chirp.rate}")
        if sync.last_observed is not None and abs(sync.last_observed / self.chirp.rate - 1) > RATE_TOLERANCE:
            raise LiveCaptureError(f"observed rate {sync.last_observed:.0f}")
        if sync.locked:
            self.unlocked_since = None
        else:
            self.unlocked_since = now_s if self.unlocked_since is None else self.unlocked_since
            if now_s - self.unlocked_since > LOCK_TIMEOUT_S:
                raise LiveCaptureError("unlocked for too long")


@dataclass
class Assembler:
    """Windows of profiles and their changes from the profile before.

    A frame that does not continue the one before it, by its mark or by a time that does not grow, clears all and is
    dropped itself; the next one then has nothing before it.
    """

    length: int
    previous: np.ndarray | None = None
    pairs: deque = field(default_factory=deque)
    last_s: float | None = None

    def push(self, profile: np.ndarray, timestamp_s: float, continuous: bool) -> np.ndarray | None:
        x = np.asarray(profile, np.float32)
        if not np.isfinite(timestamp_s) or not np.isfinite(x).all():
            raise CaptureProcessingError("a profile or its time is not finite")
        follows = continuous and (self.last_s is None or timestamp_s > self.last_s)
        self.last_s = timestamp_s
        if not follows:
            self.previous = None
            self.pairs.clear()
            return None
        before, self.previous = self.previous, x
        if before is None:
            return None
        self.pairs.append((x, x - before))
        if len(self.pairs) > self.length:
            self.pairs.popleft()
        return normalised(np.concatenate([*(a for a, _ in self.pairs), *(b for _, b in self.pairs)])) if len(self.pairs) == self.length else None


def normalised(window: np.ndarray) -> np.ndarray:
    top = np.abs(window).max()
    return (window / top if top > 0 else window).astype(np.float32)


ALIGNED = "stream_id string, frame_no long, timestamp_s double, continuous boolean, samples array<float>"


def _by_stream(rows: DataFrame, order: list[str]) -> DataFrame:
    """Each stream whole in one partition, in order: a state machine then takes it batch by batch, never as a whole."""
    return rows.repartition("stream_id").sortWithinPartitions("stream_id", *order)


def _runs(batches: Iterator[pd.DataFrame], keys: list[str] | None = None) -> Iterator[tuple[str, pd.DataFrame]]:
    """Runs of rows of one stream, or of equal ``keys``, as batches hold them."""
    keys = keys or ["stream_id"]
    for data in batches:
        edges = np.flatnonzero((data[keys] != data[keys].shift()).any(axis=1).to_numpy())
        for a, b in zip(edges, [*edges[1:], len(data)], strict=True):
            yield data["stream_id"].iloc[a], data.iloc[a:b]


def aligned_frames(packets: DataFrame, chirp: Chirp) -> DataFrame:
    """Frames of packets (stream_id, seq, timestamp_ns, sample_rate, samples), each stream in order of time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, sync, done = None, None, 0
        for name, data in _runs(batches):
            if name != stream:
                stream, sync, done = name, Synchronizer(chirp), 0
            rows = []
            for ns, rate, x in zip(data["timestamp_ns"], data["sample_rate"], data["samples"], strict=True):
                rows += sync.push(np.asarray(x, np.int16), ns / 1e9, int(rate))
            yield pd.DataFrame([(name, done + i, t, c, f) for i, (t, c, f) in enumerate(rows)], columns=["stream_id", "frame_no", "timestamp_s", "continuous", "samples"])
            done += len(rows)

    return _by_stream(packets.select("stream_id", "seq", "timestamp_ns", "sample_rate", "samples"), ["timestamp_ns", "seq"]).mapInPandas(run, ALIGNED)


def assembled_windows(frames: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """Windows of frames (stream_id, frame_no, timestamp_s, continuous, samples), each stream in order of frames.

    What the assembler says at a frame follows from that one and the ``length + 1`` before it: those of the window, the
    one that the first change is from, and the time that this one must grow from. So frames are dealt by their places
    into blocks of ``block``, each with the ``length + 1`` frames before it, and no task holds a stream.
    """
    near = frames.select("stream_id", "frame_no", "timestamp_s", "continuous", "samples")
    dealt = blocked(placed(near, [F.col("stream_id"), F.col("frame_no")], "_place"), "_place", length + 1, block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, a = None, None
        for name, data in _runs(batches, ["_block", "stream_id"]):
            if (data["_block"].iloc[0], name) != at:
                at, a = (data["_block"].iloc[0], name), Assembler(length)
            rows = []
            for no, t, c, x, home in data[["frame_no", "timestamp_s", "continuous", "samples", "_home"]].itertuples(index=False):
                if (w := a.push(np.asarray(x), t, c)) is not None and home:
                    rows.append((name, no, t, w))
            yield pd.DataFrame(rows, columns=["stream_id", "frame_no", "timestamp_s", "window"])

    return dealt.repartition("_block").sortWithinPartitions("_block", "_place").mapInPandas(run, "stream_id string, frame_no long, timestamp_s double, window array<float>")


@dataclass
class Processor:
    """Aligned frames to windows: range profile, crop, difference, window; the live form of the batch plans."""

    descriptor: Descriptor = field(default_factory=Descriptor)

    def __post_init__(self) -> None:
        self.assembler = Assembler(self.descriptor.window_frames)

    def push(self, frame: np.ndarray, timestamp_s: float, continuous: bool) -> np.ndarray | None:
        d = self.descriptor
        profile = dsp.matched_filter(np.asarray(frame, float)[None], d.chirp)[0]
        return self.assembler.push(profile[d.bin_zero_offset : d.bin_zero_offset + d.crop_bins], timestamp_s, continuous)


@dataclass
class Pipeline:
    """Capture to poses: packets in, pose lines out. ``clock`` gives the time at which a pose is made."""

    predictor: Callable[[np.ndarray], np.ndarray] | None = None
    model_id: str = "none"
    descriptor: Descriptor = field(default_factory=Descriptor)
    emit: Callable[[dict], None] = print
    clock: Callable[[], float] = time.time
    calibration_minutes: float = 0.0

    def __post_init__(self) -> None:
        self.sync, self.guard, self.health = Synchronizer(self.descriptor.chirp), LiveGuard(self.descriptor.chirp), DuplexHealth()
        self.processor = Processor(self.descriptor)

    def packet(self, samples: np.ndarray, timestamp_ns: int, rate: int) -> None:
        self.health.push(len(samples), timestamp_ns, rate)
        for t, continuous, frame in self.sync.push(samples, timestamp_ns / 1e9, rate):
            window = self.processor.push(frame, t, continuous)
            if window is None:
                continue
            if self.predictor is None:
                self.emit({"type": "capture", "version": 1, "timestamp_s": t, "sample_rate": rate, "shape": [2, self.descriptor.crop_bins, self.descriptor.window_frames], "features": [float(v) for v in window]})
                continue
            pose = checked(self.predictor, window[None])[0]
            self.emit({"type": "pose", "version": 1, "timestamp_s": self.clock(), "source_timestamp_s": t, "model_id": self.model_id, "calibration_minutes": self.calibration_minutes, "frame": "wrist-relative", "joints": pose.reshape(21, 3).tolist()})
        self.guard.check(self.sync, rate, timestamp_ns / 1e9)


@dataclass
class DuplexHealth:
    """What a capture must keep: one rate, frames of one size but the last, and times that follow from the samples."""

    rate: int | None = None
    size: int | None = None
    start_ns: int | None = None
    samples: int = 0
    breaks: int = 0
    worst_s: float = 0.0
    short: bool = False

    def push(self, n: int, timestamp_ns: int, rate: int) -> None:
        if self.rate is not None and rate != self.rate:
            raise LiveCaptureError(f"the rate changed from {self.rate} to {rate}")
        if self.short or self.size is not None and n > self.size:
            raise LiveCaptureError(f"a frame of {n} samples after frames of {self.size}")
        if self.start_ns is not None:
            off = abs((timestamp_ns - self.start_ns) / 1e9 - self.samples / rate)
            self.worst_s = max(self.worst_s, off)
            if off > GAP_S:
                self.breaks += 1
                self.start_ns, self.samples = timestamp_ns, 0
        self.rate, self.size = rate, self.size or n
        self.short = n < self.size
        self.start_ns = timestamp_ns if self.start_ns is None else self.start_ns
        self.samples += n

    def status(self) -> dict:
        return {"rate": self.rate, "frame_samples": self.size, "breaks": self.breaks, "worst_s": self.worst_s, "continuous": self.breaks == 0}


def health(packets: DataFrame, gap_s: float = GAP_S) -> DataFrame:
    """(stream_id, packets, rates, sizes, breaks): the same questions to packets at rest, as windows by stream.

    A packet breaks off where its time is over ``gap_s`` from the end of the one before.
    """
    w = Window.partitionBy("stream_id").orderBy("timestamp_ns", "seq")
    n = F.size("samples")
    end = F.lag(F.col("timestamp_ns") / 1e9 + n / F.col("sample_rate")).over(w)
    seen = packets.select("stream_id", "sample_rate", n.alias("n"), F.coalesce((F.abs(F.col("timestamp_ns") / 1e9 - end) > gap_s).cast("long"), F.lit(0)).alias("broken"), F.lead("seq").over(w).isNotNull().alias("inner"))
    return seen.groupBy("stream_id").agg(F.count("*").alias("packets"), F.countDistinct("sample_rate").alias("rates"), F.countDistinct(F.when(F.col("inner"), F.col("n"))).alias("sizes"), F.sum("broken").alias("breaks"))


class SyncProcessor(StatefulProcessor):
    """The synchroniser for ``transformWithStateInPandas``, keyed by stream."""

    def __init__(self, chirp: Chirp):
        self.chirp = chirp

    def init(self, handle) -> None:
        self.state = handle.getValueState("sync", SYNC_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sync = Synchronizer(self.chirp)
        if self.state.exists():
            sync.restore(self.state.get())
        data = pd.concat(list(rows)).sort_values(["timestamp_ns", "seq"])
        first, out = sync.frames, []
        for ns, rate, x in zip(data["timestamp_ns"], data["sample_rate"], data["samples"], strict=True):
            out += sync.push(np.asarray(x, np.int16), ns / 1e9, int(rate))
        self.state.update(sync.state())
        yield pd.DataFrame([(key[0], first + i, t, c, f) for i, (t, c, f) in enumerate(out)], columns=["stream_id", "frame_no", "timestamp_s", "continuous", "samples"])

    def close(self) -> None:
        pass


def synchronise_stream(packets: DataFrame, chirp: Chirp) -> DataFrame:
    """Aligned frames of a streaming DataFrame of packets."""
    return packets.groupBy("stream_id").transformWithStateInPandas(SyncProcessor(chirp), ALIGNED, "Append", "None")


def checked(predictor, x: np.ndarray) -> np.ndarray:
    """Wrist-relative poses (b, 63) of ``predictor`` on finite windows."""
    if not np.isfinite(x).all():
        raise InferenceError("windows that are not finite")
    y = np.asarray(predictor(x), np.float32)
    if y.shape != (len(x), 63) or not np.isfinite(y).all():
        raise InferenceError(f"poses of shape {y.shape}")
    y = y.reshape(-1, 21, 3)
    return (y - y[:, :1]).reshape(-1, 63)


def infer(windows: DataFrame, predictor, model_id: str, size: int) -> DataFrame:
    """Wrist-relative poses of windows (stream_id, timestamp_s, window) by ``predictor`` (b, size) -> (b, 63)."""

    def run(batches):
        for data in batches:
            x = np.stack(data["window"].to_numpy()) if len(data) else np.zeros((0, size))
            if x.shape[1] != size or not np.isfinite(x).all():
                raise InferenceError(f"windows of shape {x.shape}")
            y = checked(predictor, x)
            yield pd.DataFrame({"stream_id": data["stream_id"], "source_timestamp_s": data["timestamp_s"], "model_id": model_id, "pose": list(y)})

    return windows.mapInPandas(run, "stream_id string, source_timestamp_s double, model_id string, pose array<float>")


def chirp_packets(spark: SparkSession, streams: DataFrame, chirps: int, chunk: int = 701, lead: int = 137) -> DataFrame:
    """Synthetic packets of repeated chirps with a lead of silence for each row of ``streams`` (user_id)."""
    wave = np.concatenate([np.zeros(lead), np.tile(dsp.reference(Chirp()), chirps)])
    pcm = np.round(wave * 20000).astype(int).tolist()
    size = len(pcm)
    parts = streams.select(F.col("user_id").cast("string").alias("stream_id"), F.explode(F.sequence(F.lit(0), F.lit((size - 1) // chunk))).alias("seq"))
    return parts.select("stream_id", F.col("seq").cast("long").alias("seq"), F.round(F.col("seq") * chunk * 1e9 / 48000).cast("long").alias("timestamp_ns"), F.lit(48000).alias("sample_rate"), F.slice(F.lit(pcm).cast("array<smallint>"), F.col("seq") * chunk + 1, F.lit(chunk)).alias("samples"))
