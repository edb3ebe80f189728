"""Packets to windows inside one stateful operator: synchroniser, profiles, differences, windows, and refusals as rows.

``Capture`` is the way of one stream. ``capture_stream`` runs it over a streaming DataFrame with typed state that Spark
keeps: a value of counters and pending samples, and a list of the frames of the window that is filling. Event-time
timers, by when packets arrived, end streams: one that falls silent for ``LOCK_TIMEOUT_S`` gives one row and leaves no
state behind, and so does one that was refused. ``capture_batch`` runs the same over packets at rest, each stream as one sorted partition, batch by batch.

Rows: ``window`` (with the time of its last frame), ``refused`` (a wrong or changing rate, no chirp for too long, data
that are not finite) and ``silent``. A refused stream gives one such row, and no more until it has been silent.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from tidewave.errors import CaptureProcessingError, LiveCaptureError, SynchronizationError
from tidewave.functions import dsp
from tidewave.model import Descriptor
from tidewave.streaming.live import LOCK_TIMEOUT_S, SYNC_STATE, Assembler, LiveGuard, Synchronizer, _by_stream, _runs

ROWS = "stream_id string, kind string, timestamp_s double, window_no long, window array<float>, reason string, observed_rate double"
COLUMNS = [c.split(" ")[0] for c in ROWS.split(", ")]
COUNTERS = f"{SYNC_STATE}, unlocked_since double, windows long, refused string, last_s double, previous binary"
RING = "profile binary, change binary"
PACKETS = ["stream_id", "seq", "timestamp_ns", "sample_rate", "samples"]


class Capture:
    """One stream from packets to rows; its state is two plain tuples."""

    def __init__(self, descriptor: Descriptor, counters: tuple | None = None, ring: list[tuple] = ()):
        self.descriptor = descriptor
        self.sync, self.guard, self.assembler = Synchronizer(descriptor.chirp), LiveGuard(descriptor.chirp), Assembler(descriptor.window_frames)
        self.windows, self.refused = 0, None
        if counters is not None:
            *mine, self.guard.unlocked_since, self.windows, self.refused, self.assembler.last_s, previous = counters
            self.sync.restore(tuple(mine))
            self.assembler.previous = None if previous is None else np.frombuffer(previous, "<f4")
            self.assembler.pairs = deque((np.frombuffer(a, "<f4"), np.frombuffer(b, "<f4")) for a, b in ring)

    def counters(self) -> tuple:
        previous = self.assembler.previous
        return (*self.sync.state(), self.guard.unlocked_since, self.windows, self.refused, self.assembler.last_s, None if previous is None else previous.astype("<f4").tobytes())

    def ring(self) -> list[tuple]:
        return [(a.astype("<f4").tobytes(), b.astype("<f4").tobytes()) for a, b in self.assembler.pairs]

    def push(self, samples: np.ndarray, timestamp_ns: int, rate: int) -> list[tuple]:
        """(kind, timestamp_s, window_no, window, reason, observed_rate) of a packet."""
        if self.refused is not None:
            return []
        d, out = self.descriptor, []
        try:
            frames = self.sync.push(samples, timestamp_ns / 1e9, rate)
            if frames:
                profiles = dsp.matched_filter(np.stack([f for _, _, f in frames]).astype(float), d.chirp)[:, d.bin_zero_offset : d.bin_zero_offset + d.crop_bins]
                for (t, continuous, _), profile in zip(frames, profiles, strict=True):
                    window = self.assembler.push(profile, t, continuous)
                    if window is not None:
                        out.append(("window", t, self.windows, window, None, self.sync.last_observed))
                        self.windows += 1
            self.guard.check(self.sync, rate, timestamp_ns / 1e9 + len(samples) / rate)
        except (CaptureProcessingError, LiveCaptureError, SynchronizationError) as e:
            self.refused = str(e)
            out.append(("refused", timestamp_ns / 1e9, None, None, self.refused, self.sync.last_observed))
        return out


def _rows(stream: str, found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame([(stream, *r) for r in found], columns=COLUMNS)


def _pushed(capture: Capture, data: pd.DataFrame) -> list[tuple]:
    out = []
    for ns, rate, x in zip(data["timestamp_ns"], data["sample_rate"], data["samples"], strict=True):
        out += capture.push(np.asarray(x, np.int16), int(ns), int(rate))
    return out


class CaptureProcessor(StatefulProcessor):
    """``Capture`` keyed by stream, with a timer at the last packet's arrival and the timeout."""

    def __init__(self, descriptor: Descriptor, timeout_s: float = LOCK_TIMEOUT_S):
        self.descriptor, self.timeout_ms = descriptor, int(timeout_s * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.counters, self.ring = handle.getValueState("counters", COUNTERS), handle.getListState("ring", RING)
        self.heard = handle.getValueState("heard", "until_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(["timestamp_ns", "seq"])
        capture = Capture(self.descriptor, self.counters.get(), list(self.ring.get())) if self.counters.exists() else Capture(self.descriptor)
        found = _pushed(capture, data)
        self.counters.update(capture.counters())
        if ring := capture.ring():
            self.ring.put(ring)
        elif self.ring.exists():
            self.ring.clear()
        before = self.heard.get()[0] if self.heard.exists() else None
        until = int(max(before or 0, data["arrived"].max().value // 1_000_000 + self.timeout_ms))
        if until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
            self.heard.update((until,))
        yield _rows(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        _, *rest = self.counters.get() if self.counters.exists() else (None,)
        observed = rest[SYNC_STATE.split(", ").index("last_observed double") - 1] if rest else None
        for state in (self.counters, self.ring, self.heard):
            state.clear()
        yield _rows(key[0], [("silent", at / 1000, None, None, f"no packet for {self.timeout_ms / 1000:g} s", observed)])

    def close(self) -> None:
        pass


def capture_stream(packets: DataFrame, descriptor: Descriptor, delay: str = "1 second", timeout_s: float = LOCK_TIMEOUT_S) -> DataFrame:
    """Rows of a streaming DataFrame of packets (stream_id, seq, timestamp_ns, sample_rate, samples, arrived).

    Packets that arrived ``delay`` before the latest of all streams are dropped, which their stream sees as a gap.
    Needs the RocksDB state store.
    """
    timed = packets.select(*PACKETS, "arrived").withWatermark("arrived", delay)
    return timed.groupBy("stream_id").transformWithStateInPandas(CaptureProcessor(descriptor, timeout_s), ROWS, "Append", "EventTime")


def capture_batch(packets: DataFrame, descriptor: Descriptor) -> DataFrame:
    """Rows of packets at rest, each stream in order of time; streams that end are not silent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, capture = None, None
        for name, data in _runs(batches):
            if name != stream:
                stream, capture = name, Capture(descriptor)
            yield _rows(name, _pushed(capture, data))

    return _by_stream(packets.select(*PACKETS), ["timestamp_ns", "seq"]).mapInPandas(run, ROWS)
