"""Signal kernels in numpy, and the Arrow functions that run them on array columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewave.model import SPEED_OF_SOUND, Chirp


def tukey(u: np.ndarray, alpha: float = 0.25) -> np.ndarray:
    """Tukey window at places u of [0, 1); flat between cosine flanks of alpha / 2 each."""
    if not 0 <= alpha <= 1:
        raise ValueError("alpha lies between 0 and 1")
    u = np.asarray(u, float)
    edge = np.minimum(u, 1 - u)
    flank = 0.5 * (1 - np.cos(2 * np.pi * edge / alpha)) if alpha else np.ones_like(u)
    return np.where((u < 0) | (u >= 1), 0.0, np.where(edge < alpha / 2, flank, 1.0))


def chirp_at(t: np.ndarray, chirp: Chirp, alpha: float = 0.25) -> np.ndarray:
    """The windowed sweep at times t, 0 outside its duration."""
    t = np.asarray(t, float)
    wave = np.sin(2 * np.pi * (chirp.f_start * t + 0.5 * chirp.bandwidth / chirp.duration * t * t))
    return np.where((t >= 0) & (t < chirp.duration), wave * tukey(t / chirp.duration, alpha), 0.0)


def reference(chirp: Chirp, alpha: float = 0.25) -> np.ndarray:
    return chirp_at(np.arange(chirp.n_samples) / chirp.rate, chirp, alpha)


def analytic(x: np.ndarray) -> np.ndarray:
    """The signal without its negative frequencies, along the last axis."""
    n = x.shape[-1]
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x, axis=-1) * gain, axis=-1)


def envelope(x: np.ndarray) -> np.ndarray:
    return np.abs(analytic(np.asarray(x, float)))


def correlate(frames: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Correlation with ``ref`` at lags 0 to len - 1, in units of the reference's energy."""
    n = frames.shape[-1]
    size = 1 << (n + len(ref) - 2).bit_length()
    spectrum = np.fft.fft(frames, size, axis=-1) * np.conj(np.fft.fft(ref, size))
    return np.fft.ifft(spectrum, axis=-1)[..., :n] / (ref.real**2).sum()


def matched_filter(frames: np.ndarray, chirp: Chirp, bins: int | None = None) -> np.ndarray:
    out = np.abs(correlate(frames, analytic(reference(chirp))))
    bins = bins or out.shape[-1]
    return np.pad(out[..., :bins], [(0, 0)] * (out.ndim - 1) + [(0, max(0, bins - out.shape[-1]))])


def simulate(chirp: Chirp, ranges: np.ndarray, amplitudes: np.ndarray, snr_db: float | None = None, seed: int = 0) -> np.ndarray:
    """One frame of echoes from point reflectors; echoes later than a frame wrap into it."""
    t = np.arange(chirp.n_samples) / chirp.rate
    out = np.zeros(chirp.n_samples)
    for r, a in zip(ranges, amplitudes, strict=True):
        if r < 0 or not np.isfinite(a):
            raise ValueError("ranges are not negative and amplitudes finite")
        out += a * chirp_at((t - 2 * r / SPEED_OF_SOUND) % chirp.duration, chirp)
    if snr_db is not None:
        out = out + np.random.default_rng(seed).normal(0, np.sqrt((out**2).mean() / 10 ** (snr_db / 10)), len(out))
    return out


def simulate_recording(chirp: Chirp, tracks: list[tuple[np.ndarray, float]], frames: int, snr_db: float | None = None, seed: int = 0) -> np.ndarray:
    """(frames, samples) from tracks of (range of each frame, amplitude); the noise is drawn once over the whole."""
    clean = np.stack([simulate(chirp, np.array([r[i] for r, _ in tracks]), np.array([a for _, a in tracks])) for i in range(frames)])
    if snr_db is None:
        return clean
    return clean + np.random.default_rng(seed).normal(0, np.sqrt((clean**2).mean() / 10 ** (snr_db / 10)), clean.shape)


def floor_of(x: np.ndarray, block: int = 96) -> float:
    x = np.abs(np.asarray(x, float))
    if not len(x):
        return 0.0
    low = [np.quantile(b, 0.1) for b in np.array_split(x, max(1, len(x) // block))]
    return float(min(np.median(low) * np.sqrt(2 * np.log(2)) / np.sqrt(-2 * np.log(0.9)), x.max()))


def local_maxima(x: np.ndarray) -> list[int]:
    """Places higher than what stands on both sides; a flat top counts at its middle."""
    x = np.asarray(x)
    if len(x) < 3:
        return []
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    last = np.append(first[1:], len(x)) - 1
    level = x[first]
    top = np.zeros(len(level), bool)
    top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return ((first + last) // 2)[top].tolist()


def prominence(x: np.ndarray, at: int) -> float:
    """Height over the higher of the lowest places on each side, up to something higher."""
    higher = np.flatnonzero(x > x[at])
    left, right = higher[higher < at], higher[higher > at]
    low = x[left[-1] + 1 if len(left) else 0 : at + 1].min(), x[at : right[0] if len(right) else len(x)].min()
    return float(x[at] - max(low))


def subbin(x: np.ndarray, i: int) -> float:
    if not 0 < i < len(x) - 1:
        return 0.0
    a, b, c = np.log(np.maximum(x[i - 1 : i + 2], 1e-300))
    bend = a - 2 * b + c
    return float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5)) if bend < 0 else 0.0


def peaks(x: np.ndarray, bin_metres: float, offset: float = 0.0, ratio: float = 4.0, share: float = 0.3, most: int | None = None) -> list[dict]:
    """Peaks over the noise floor with enough prominence, largest first; both ends can be peaks."""
    x = np.asarray(x, float)
    if len(x) < 3 or x.max() <= 0:
        return []
    floor, padded, out = floor_of(x), np.concatenate([[0.0], x, [0.0]]), []
    for at in local_maxima(padded):
        if (floor <= 0 or padded[at] >= ratio * floor) and prominence(padded, at) >= share * x.max():
            i = at - 1
            d = subbin(x, i)
            a = float(x[i])
            if 0 < i < len(x) - 1:
                l, c, r = np.log(np.maximum(x[i - 1 : i + 2], 1e-300))
                a = float(np.exp(c - 0.25 * (l - r) * d))
            out.append({"bin_index": i, "range_m": offset + (i + d) * bin_metres, "amplitude": a, "peak_to_noise": a / floor if floor > 0 else float("inf")})
    out.sort(key=lambda p: (-p["amplitude"], p["bin_index"]))
    return out[:most]


# Expressions: the same signals as columns


def tukey_column(u: Column, alpha: float = 0.25) -> Column:
    edge = F.least(u, 1 - u)
    flank = 0.5 * (1 - F.cos(2 * np.pi * edge / alpha)) if alpha else F.lit(1.0)
    return F.when((u < 0) | (u >= 1), 0.0).otherwise(F.when(edge < alpha / 2, flank).otherwise(1.0))


def chirp_column(t: Column, chirp: Chirp, alpha: float = 0.25) -> Column:
    """The windowed sweep at times t, 0 outside its duration."""
    wave = F.sin(2 * np.pi * (chirp.f_start * t + 0.5 * chirp.bandwidth / chirp.duration * t * t))
    return F.when((t >= 0) & (t < chirp.duration), wave * tukey_column(t / chirp.duration, alpha)).otherwise(0.0)


def reflector_delay(range_m: Column) -> Column:
    """Seconds until an echo from ``range_m`` returns; a negative range is an error."""
    return F.when(range_m >= 0, 2 * range_m / SPEED_OF_SOUND).otherwise(F.raise_error(F.lit("a range is negative")))


def echoes_column(reflectors: Column, chirp: Chirp) -> Column:
    """One frame of echoes of an array of (range_m, amplitude), without noise; late echoes wrap into it."""

    def at(k: Column) -> Column:
        t = k / chirp.rate
        one = lambda r: r["amplitude"] * chirp_column(F.pmod(t - reflector_delay(r["range_m"]), F.lit(chirp.duration)), chirp)
        return F.aggregate(reflectors, F.lit(0.0), lambda s, r: s + one(r))

    return F.transform(F.sequence(F.lit(0), F.lit(chirp.n_samples - 1)), at)


def pcm(samples: Column, bits: int = 16) -> Column:
    """Integer samples as numbers from -1 to below 1."""
    return F.transform(samples, lambda v: v / float(1 << (bits - 1)))


# Arrow functions


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def matched_filter_column(samples: Column, chirp: Chirp, bins: int | None = None) -> Column:
    """Frames of one length to range profiles."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(list(matched_filter(_matrix(column), chirp, bins)) if len(column) else [], pa.list_(pa.float64()))

    return run(samples)


def _bound(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def floor_column(x: Column, block: int = 96) -> Column:
    """``floor_of`` as an expression: tenths of blocks, their median scaled to a half-normal's, at most the largest."""
    size = F.abs
    n = F.size(x)
    k = F.greatest(F.lit(1), F.floor(n / block).cast("int"))
    each, more = F.floor(n / k).cast("int"), n % k
    sorted_block = lambda b: F.array_sort(F.transform(F.slice(x, b * each + F.least(b, more) + 1, each + F.when(b < more, 1).otherwise(0)), size))

    def at(v: Column, share: float) -> Column:
        place = (F.size(v) - 1) * F.lit(share)
        low = F.floor(place).cast("int")
        return F.get(v, low) + (F.coalesce(F.get(v, low + 1), F.get(v, low)) - F.get(v, low)) * (place - low)

    tenths = F.array_sort(F.transform(F.sequence(F.lit(0), k - 1), lambda b: _bound(sorted_block(b), lambda v: at(v, 0.1))))
    scale = float(np.sqrt(2 * np.log(2)) / np.sqrt(-2 * np.log(0.9)))
    return F.when(n > 0, F.least(_bound(tenths, lambda v: at(v, 0.5)) * F.lit(scale), F.array_max(F.transform(x, size)))).otherwise(0.0)


def peaks_column(samples: Column, bin_metres: float, offset: float = 0.0, ratio: float = 4.0, share: float = 0.3, most: int | None = None) -> Column:
    """``peaks`` as an expression: array<struct<bin_index, range_m, amplitude, peak_to_noise>>, largest first.

    Runs of equal values are one place each; a top is a run above both neighbours. Its prominence goes down to the
    higher of the lowest runs on each side, up to the nearest higher run.
    """

    def found(x: Column, floor: Column, top: Column, padded: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(padded) - 1), lambda i: (i == 0) | (F.get(padded, i) != F.get(padded, i - 1)))
        runs = F.struct(starts.alias("first"), F.transform(starts, lambda i: F.get(padded, i)).alias("level"))

        def tops(r: Column) -> Column:
            level, last = r["level"], F.size(r["level"]) - 1
            high = F.filter(F.sequence(F.lit(0), last), lambda i: (i > 0) & (i < last) & (F.get(level, i) > F.get(level, i - 1)) & (F.get(level, i) > F.get(level, i + 1)) & ((floor <= 0) | (F.get(level, i) >= ratio * floor)))

            def prominence(i: Column) -> Column:
                above = F.filter(F.sequence(F.lit(0), last), lambda q: F.get(level, q) > F.get(level, i))
                left, right = F.coalesce(F.array_max(F.filter(above, lambda q: q < i)), F.lit(-1)), F.coalesce(F.array_min(F.filter(above, lambda q: q > i)), last + 1)
                lows = _bound(F.struct(left.alias("l"), right.alias("r")), lambda e: F.greatest(F.array_min(F.slice(level, e["l"] + 2, i - e["l"])), F.array_min(F.slice(level, i + 1, e["r"] - i))))
                return F.get(level, i) - lows

            kept = F.filter(high, lambda i: prominence(i) >= share * top)
            # the middle of a run, counted without the zero in front
            return F.transform(kept, lambda i: F.floor((F.get(r["first"], i) + F.get(r["first"], i + 1) - 1) / 2).cast("int") - 1)

        return F.transform(_bound(runs, tops), lambda i: refined(x, floor, i))

    def refined(x: Column, floor: Column, i: Column) -> Column:
        log = lambda k: F.log(F.greatest(F.get(x, k), F.lit(1e-300)))
        inside = (i > 0) & (i < F.size(x) - 1)
        logs = F.when(inside, F.struct(log(i - 1).alias("l"), log(i).alias("c"), log(i + 1).alias("r")))

        def of(v: Column) -> Column:
            bend = v["l"] - 2 * v["c"] + v["r"]
            shift = F.when(inside & (bend < 0), F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (v["l"] - v["r"]) / bend))).otherwise(0.0)
            return _bound(shift, lambda s: _bound(F.when(inside, F.exp(v["c"] - 0.25 * (v["l"] - v["r"]) * s)).otherwise(F.get(x, i)), lambda a: F.struct(i.cast("int").alias("bin_index"), (offset + (i + s) * bin_metres).alias("range_m"), a.alias("amplitude"), F.when(floor > 0, a / floor).otherwise(float("inf")).alias("peak_to_noise"))))

        return _bound(logs, of)

    def whole(x: Column) -> Column:
        zero = F.array(F.lit(0.0))
        about = F.struct(floor_column(x).alias("floor"), F.array_max(x).alias("top"), F.concat(zero, x, zero).alias("padded"))
        order = lambda a, b: F.when(a["amplitude"] > b["amplitude"], -1).when(a["amplitude"] < b["amplitude"], 1).otherwise(a["bin_index"] - b["bin_index"])
        peaks_ = _bound(about, lambda v: F.when((F.size(x) >= 3) & (v["top"] > 0), F.array_sort(found(x, v["floor"], v["top"], v["padded"]), order)).otherwise(F.array().cast("array<struct<bin_index:int,range_m:double,amplitude:double,peak_to_noise:double>>")))
        return peaks_ if most is None else F.slice(peaks_, 1, most)

    return _bound(samples.cast("array<double>"), whole)


def simulate_column(reflectors: Column, chirp: Chirp, snr_db: float | None = None) -> Column:
    """Frames from arrays of (range_m, amplitude); noise is seeded by the place in a batch's values."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for row in column.to_pylist():
            r, a = np.array([x["range_m"] for x in row]), np.array([x["amplitude"] for x in row])
            seed = int(abs(hash((tuple(r.tolist()), tuple(a.tolist()))))) % 2**32
            out.append(simulate(chirp, r, a, snr_db, seed).tolist())
        return pa.array(out, pa.list_(pa.float64()))

    return run(reflectors)


def profiles(recording, keys: list[str], chirp: Chirp, start_s: float = 0.0, hop: int | None = None, bins: int | None = None):
    """Range profiles of a recording (keys, pos, value): keys, frame_id, samples, timestamp_s, bin_metres."""
    from tidewave.operators import frames as fr

    cut = fr.segment(recording, keys, chirp.n_samples, hop)
    step = (hop or chirp.n_samples) / chirp.rate
    return cut.select(*keys, "frame_id", matched_filter_column(F.col("samples"), chirp, bins).cast("array<float>").alias("samples"), (F.lit(start_s) + F.col("frame_id") * step).alias("timestamp_s"), F.lit(chirp.bin_metres).alias("bin_metres"))
