"""Impulses: detection, resonance fit, features, class table and what the channel carries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.errors import ClassMergeError, OverclaimError, ResonanceFitError
from tidewave.model import ARM_DOF, ARM_RANGE_DEG, ARM_RESOLUTION_DEG, CLAP_MODES, PROTOTYPE_SDS, Measurement, Protocol


def detect(x: np.ndarray, rate: int, frame_ms: float = 4, hop_ms: float = 2, floor_s: float = 0.5, threshold_db: float = 10, refractory_ms: float = 120, pre_ms: float = 2, window_ms: float = 40, early_ms: float = 8, late_ms: float = 40, decay_db: float = 6, rise_ms: float = 12, rise_db: float = 6) -> list[dict]:
    """Impulses of one signal: onsets over a trailing median level that rise and decay fast enough.

    A sequential test: each onset keeps its distance from the last accepted one.
    """
    x = np.asarray(x, float)
    x = x - x.mean() if len(x) else x
    ms = lambda t: max(1, round(t * rate / 1000))
    frame, hop = ms(frame_ms), ms(hop_ms)
    if len(x) < frame:
        return []
    energy = np.concatenate([[0.0], np.cumsum(x * x)])
    starts = np.arange(0, len(x) - frame + 1, hop)
    level = 20 * np.log10(np.sqrt((energy[starts + frame] - energy[starts]) / frame) + 1e-20)
    width = max(1, round(floor_s * 1000 / hop_ms))
    padded = np.concatenate([np.full(width - 1, level[0]), level])
    floor = np.median(np.lib.stride_tricks.sliding_window_view(padded, width), axis=1)
    power = lambda a, b: (energy[b] - energy[a]) / (b - a) if 0 <= a < b <= len(x) else 1e-20
    db = lambda p, q: 10 * np.log10((p + 1e-20) / (q + 1e-20))
    out, last = [], -(10**12)
    for k in np.flatnonzero(level - floor >= threshold_db):
        if k and level[k - 1] - floor[k - 1] >= threshold_db:
            continue
        a = int(starts[k])
        b = min(len(x), a + frame + ms(early_ms))
        peak = a + int(np.abs(x[a:b]).argmax())
        if peak - last < ms(refractory_ms) or peak - ms(pre_ms) < 0 or peak - ms(pre_ms) + ms(window_ms) > len(x):
            continue
        early = power(peak, min(len(x), peak + ms(early_ms)))
        decay = db(early, power(min(len(x), peak + ms(late_ms)), min(len(x), peak + ms(late_ms) + ms(early_ms))))
        rise = db(early, power(max(0, peak - ms(rise_ms) - ms(early_ms)), max(0, peak - ms(rise_ms))))
        if decay < decay_db or rise < rise_db:
            continue
        last = peak
        w = x[peak - ms(pre_ms) : peak - ms(pre_ms) + ms(window_ms)]
        out.append({"idx": peak, "time_s": peak / rate, "peak_amplitude": float(abs(x[peak])), "onset_strength_db": float(level[k] - floor[k]), "decay_db": float(decay), "rise_db": float(rise), "window": w.tolist(), "pre_samples": ms(pre_ms)})
    return out


EVENTS = "rec_id string, idx long, time_s double, peak_amplitude double, onset_strength_db double, decay_db double, rise_db double, window array<double>, pre_samples int"


def impulses(recordings: DataFrame, **options) -> DataFrame:
    """Events of recordings (rec_id, sample_rate, samples), one recording a row."""

    def run(batches):
        for batch in batches:
            rows = [{"rec_id": r, **e} for r, rate, x in zip(batch["rec_id"], batch["sample_rate"], batch["samples"], strict=True) for e in detect(np.array(x), int(rate), **options)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EVENTS.split(", ")])

    return recordings.select("rec_id", "sample_rate", "samples").mapInPandas(run, EVENTS)


def fit_poles(x: np.ndarray, order: int = 2, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of an impulse response, by repeated prefiltered least squares; poles inside the circle."""
    a, n = np.concatenate([[1.0], np.zeros(order)]), len(x)
    b = np.zeros(2)
    impulse = np.zeros(n)
    impulse[0] = 1

    def by_poles(v: np.ndarray) -> np.ndarray:
        """All-pole filter: convolution with its impulse response, which is a sum of powers of its poles."""
        poles = np.roots(a).astype(complex)
        if not poles.any():
            return v
        poles = poles * (1 + 1e-7 * np.arange(len(poles)))  # no two are equal
        share = [p ** (order - 1) / np.prod([p - q for j, q in enumerate(poles) if j != i]) if p else 0 for i, p in enumerate(poles)]
        response = (np.array(share)[:, None] * poles[:, None] ** np.arange(n)).sum(0).real
        size = 1 << (2 * n - 1).bit_length()
        return np.fft.irfft(np.fft.rfft(v, size) * np.fft.rfft(response, size), size)[:n]

    for _ in range(rounds):
        y, u = by_poles(x), by_poles(impulse)
        shift = lambda v, k: np.concatenate([np.zeros(k), v[: n - k]])
        m = np.stack([*(-shift(y, k) for k in range(1, order + 1)), *(shift(u, k) for k in range(2))], axis=1)
        p, *_ = np.linalg.lstsq(m, y, rcond=None)
        roots = np.roots(np.concatenate([[1.0], p[:order]]))
        roots = np.where(np.abs(roots) > 1, 1 / np.conj(roots), roots)
        a, b = np.real(np.poly(roots)), p[order:]
    return b, a


def resonance(window: np.ndarray, rate: int, low: float = 200, high: float = 4000, order: int = 2) -> dict:
    """Dominant resonance of one impulse from its peak on."""
    x = np.asarray(window, float)
    x = x[int(np.abs(x).argmax()) :] if len(x) else x
    if len(x) < 16 or not np.isfinite(x).all() or not x.any():
        raise ResonanceFitError("too few or silent samples")
    x = x - x.mean()
    fade = max(1, round(0.15 * len(x)))
    x[-fade:] *= 0.5 * (1 + np.cos(np.pi * np.arange(1, fade + 1) / fade))
    b, a = fit_poles(x, order)
    poles = np.roots(a)
    found = []
    for p in poles[poles.imag > 0]:
        r, f = abs(p), np.angle(p) * rate / (2 * np.pi)
        if low <= f <= high and 0 < r < 1:
            residue = np.polyval(b, p) / np.prod([p - q for q in poles if q != p])
            found.append((abs(residue) / (1 - r), f, r))
    if not found:
        raise ResonanceFitError("no pole in the band")
    _, f, r = max(found)
    alpha = -np.log(r) * rate
    n = np.arange(len(x))
    basis = np.stack([r**n * np.cos(2 * np.pi * f * n / rate), r**n * np.sin(2 * np.pi * f * n / rate)], axis=1)
    c, *_ = np.linalg.lstsq(basis, x, rcond=None)
    return {"centre_frequency_hz": float(f), "bandwidth_hz": float(alpha / np.pi), "decay_rate_s": float(alpha), "pole_radius": float(r), "energy": float((x * x).sum()), "residual": float(((x - basis @ c) ** 2).sum() / (x * x).sum()), "order": order}


def resonances(events: DataFrame, rate: int) -> DataFrame:
    """Fits of events (rec_id, idx, window); a failure keeps its row with a reason."""
    names = ["centre_frequency_hz", "bandwidth_hz", "decay_rate_s", "pole_radius", "energy", "residual"]

    def run(batches):
        for batch in batches:
            rows = []
            for rec, idx, w in zip(batch["rec_id"], batch["idx"], batch["window"], strict=True):
                try:
                    fit, reason = resonance(np.array(w), rate), None
                except ResonanceFitError as e:
                    fit, reason = {}, str(e)
                rows.append([rec, idx, *(fit.get(n) for n in names), reason])
            yield pd.DataFrame(rows, columns=["rec_id", "idx", *names, "reason"])

    return events.select("rec_id", "idx", "window").mapInPandas(run, "rec_id string, idx long, " + ", ".join(f"{n} double" for n in names) + ", reason string")


# The class table and the channel, as plans


def fit_classes(rows: DataFrame, label: str, features: list[str], least: float = 1e-6) -> DataFrame:
    """(label, n, mean_i, var_i): class means and the pooled population variance within classes."""
    by = rows.groupBy(label).agg(F.count("*").alias("n"), *[F.avg(f).alias(f"mean_{i}") for i, f in enumerate(features)], *[F.var_pop(f).alias(f"_v{i}") for i, f in enumerate(features)])
    every = Window.partitionBy()
    for i in range(len(features)):
        by = by.withColumn(f"var_{i}", F.greatest(F.lit(least), F.sum(F.col(f"_v{i}") * F.col("n")).over(every) / F.sum("n").over(every))).drop(f"_v{i}")
    return by


def predict_classes(rows: DataFrame, classes: DataFrame, key: list[str], features: list[str], label: str) -> DataFrame:
    """(key, predicted, posterior): the class with the largest score and its share of exp(score), uniform prior.

    The class table has one row for each class; it is checked to be small and joined to every row as one array, so that
    rows are never multiplied or shuffled. Of equal scores the first class in order wins.
    """
    if classes.count() > 1000:
        raise ValueError("more than 1000 classes")
    fields = [c for i in range(len(features)) for c in (f"mean_{i}", f"var_{i}")]
    table = classes.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("_class"), *fields))).alias("_classes"))
    score = lambda c: sum((-0.5 * (F.col(f) - c[f"mean_{i}"]) * (F.col(f) - c[f"mean_{i}"]) / c[f"var_{i}"] for i, f in enumerate(features)), F.lit(0.0))
    scored = rows.join(F.broadcast(table), F.lit(True)).withColumn("_scores", F.transform("_classes", score)).withColumn("_top", F.array_max("_scores"))
    best = F.element_at("_classes", F.array_position("_scores", F.col("_top")).cast("int"))["_class"]
    posterior = 1 / F.aggregate("_scores", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    return scored.select(*key, best.alias("predicted"), posterior.alias("posterior"))


def chance(classes: int) -> float:
    return 1 / classes


def features_of(frequency_hz, bandwidth_hz) -> list:
    """(log10 f, log10 bw) of a resonance, floored at 1e-12; its energy goes along but is never classified on."""
    floor = lambda c: F.log10(F.greatest(c, F.lit(1e-12)))
    return [floor(frequency_hz).alias("f0"), floor(bandwidth_hz).alias("f1")]


def merged_class(mode):
    """The class a mode merges into; an unknown mode is an error."""
    table = F.create_map(*[F.lit(x) for m, (_, _, c) in CLAP_MODES.items() for x in (m, c)])
    return F.coalesce(table[mode], F.raise_error(F.concat(F.lit("unknown mode: "), F.coalesce(mode, F.lit("null")))).cast("string"))


def expand_class(name: str):
    """A class cannot be told back into the modes that merge into it."""
    raise ClassMergeError(f"{name} stands for {sum(c == name for _, _, c in CLAP_MODES.values())} modes")


def prototypes(spark: SparkSession) -> DataFrame:
    """(label, n, mean_i, var_i) of the merged classes: means of their modes' logarithms, spreads fixed."""
    modes = spark.createDataFrame([(c, f, b) for f, b, c in CLAP_MODES.values()], "label string, f double, bw double")
    by = modes.select("label", *features_of(F.col("f"), F.col("bw"))).groupBy("label").agg(F.count("*").alias("n"), F.avg("f0").alias("mean_0"), F.avg("f1").alias("mean_1"))
    return by.withColumns({f"var_{i}": F.lit(sd * sd) for i, sd in enumerate(PROTOTYPE_SDS)})


def measured(matrix: DataFrame, protocol: Protocol) -> dict[str, Measurement]:
    """Accuracy and capacity of a confusion matrix as measurements under a protocol; an empty matrix is refused."""
    row = capacity(matrix).first()
    if row is None or not row["samples"]:
        raise ValueError("the confusion matrix is empty")
    return {"accuracy": Measurement(row["accuracy"], "share", protocol, row["samples"]), "capacity": Measurement(row["bits"], "bit", protocol, row["samples"])}


def gap(bits, dof: int = ARM_DOF, resolution_deg: float = ARM_RESOLUTION_DEG, range_deg: float = ARM_RANGE_DEG) -> dict:
    """What ``bits`` lack of an arm pose: need, deficit, feasibility, events needed and the resolution within reach."""
    need = F.lit(pose_bits(dof, resolution_deg, range_deg))
    return {"need": need, "deficit": need - bits, "feasible": bits >= need, "events_needed": F.when(bits > 0, F.ceil(need / bits)), "resolution_deg": range_deg / F.pow(F.lit(2.0), bits / dof)}


def confusion(pairs: DataFrame, true: str, predicted: str) -> DataFrame:
    """(true_label, pred_label, n), dense over the labels that occur on each side."""
    counts = pairs.groupBy(F.col(true).alias("true_label"), F.col(predicted).alias("pred_label")).agg(F.count("*").alias("n"))
    rows, cols = counts.select("true_label").distinct(), counts.select("pred_label").distinct()
    return rows.join(F.broadcast(cols), F.lit(True)).join(counts, ["true_label", "pred_label"], "left").fillna(0, ["n"])


def capacity(matrix: DataFrame) -> DataFrame:
    """Mutual information in bits and what goes with it, from (true_label, pred_label, n)."""
    every, by_true, by_pred = Window.partitionBy(), Window.partitionBy("true_label"), Window.partitionBy("pred_label")
    p = matrix.select("true_label", "pred_label", "n", F.sum("n").over(every).alias("t"), F.sum("n").over(by_true).alias("r"), F.sum("n").over(by_pred).alias("c"))
    share = F.col("n") / F.col("t")
    bits = F.when(F.col("n") > 0, share * F.log2(F.col("n") * F.col("t") / (F.col("r") * F.col("c")))).otherwise(0.0)
    entropy = lambda m: -F.sum(F.when(F.col("n") > 0, share * F.log2(F.col(m) / F.col("t"))).otherwise(0.0))
    out = p.agg(F.greatest(F.lit(0.0), F.sum(bits)).alias("bits"), entropy("r").alias("h_true"), entropy("c").alias("h_pred"), F.log2(F.countDistinct("true_label").cast("double")).alias("ceiling"), (F.sum(F.when(F.col("true_label").cast("string") == F.col("pred_label").cast("string"), F.col("n")).otherwise(0)) / F.max("t")).alias("accuracy"), F.max("t").alias("samples"))
    return out.withColumn("efficiency", F.when(F.col("ceiling") > 0, F.col("bits") / F.col("ceiling")).otherwise(0.0)).withColumn("residual_entropy", F.col("h_true") - F.col("bits"))


def pose_bits(dof: int = ARM_DOF, resolution_deg: float = ARM_RESOLUTION_DEG, range_deg: float = ARM_RANGE_DEG) -> float:
    return dof * float(np.log2(range_deg / resolution_deg))


def refuse_overclaim(bits: float, claimed: float) -> None:
    if claimed > bits:
        raise OverclaimError(f"{claimed:g} bits are claimed, the channel carries {bits:.2f}")
