"""Recordings, frames and windows as DataFrame plans.

Frames are arrays in one row. Frames of a recording are built by position, never by sorting a whole recording in one
task: a sample at position p belongs to frames that start at multiples of ``hop``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.errors import CaptureProcessingError, PreprocessingMismatchError
from tidewave.model import SPEED_OF_SOUND, Normalisation


def segment(samples: DataFrame, keys: list[str], n: int, hop: int | None = None) -> DataFrame:
    """(keys, frame_id, samples): frames of ``n`` from (keys, pos, value); a trailing part of a frame is dropped."""
    hop = hop or n
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - n) / hop) + 1)
    dealt = samples.withColumn("frame_id", F.explode(F.sequence(first.cast("long"), F.floor(F.col("pos") / hop).cast("long")))) if hop < n else samples.withColumn("frame_id", F.floor(F.col("pos") / hop).cast("long")).where(F.col("pos") - F.col("frame_id") * hop < n)
    return dealt.groupBy(*keys, "frame_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("x")).where(F.size("x") == n).select(*keys, "frame_id", F.col("x.value").alias("samples"))


def normalise(x: Column, kind: Normalisation) -> Column:
    """Divided by its peak or norm; silent or endless data is left alone."""
    if kind is Normalisation.NONE:
        return x
    scale = F.array_max(F.transform(x, F.abs)) if kind is Normalisation.PEAK else F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return _with_bound(scale, lambda s: F.when((s > 0) & (s < float("inf")) & ~F.isnan(s), F.transform(x, lambda v: v / s)).otherwise(x))


def _with_bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value worked out once: inside a lambda an expression would be worked out for each element."""
    return F.element_at(F.transform(F.array(value), of), 1)


def crop(x: Column, near: float, far: float, bin_metres: float, offset: Column | float = 0.0) -> tuple[Column, Column]:
    """The part of a profile between two ranges, and the range of its first bin; an empty part is an error."""
    offset = offset if isinstance(offset, Column) else F.lit(float(offset))
    low = F.greatest(F.lit(0), ((F.lit(near) - offset) / bin_metres).cast("int"))
    high = F.least(F.size(x), ((F.lit(far) - offset) / bin_metres).cast("int"))
    part = F.when(high > low, F.slice(x, low + 1, high - low)).otherwise(F.raise_error(F.lit("the crop is empty")))
    return part, offset + low * bin_metres


def bin_range(index: Column, bin_metres: float, offset: float = 0.0) -> Column:
    return F.lit(offset) + index * bin_metres


BLOCK = 4096


def blocked(frames: DataFrame, order: str, halo: int, block: int = BLOCK) -> DataFrame:
    """Frames dealt into blocks ``_block`` of ``block`` frame numbers, each with the ``halo`` frames before it.

    A window over (keys, _block) then needs no whole recording in one task; rows of the halo are not ``_home``.
    """
    own = F.floor(F.col(order) / block)
    dealt = frames.withColumn("_block", F.explode(F.sequence(own, F.floor((F.col(order) + halo) / block))))
    return dealt.withColumn("_home", F.col("_block") == own)


def differences(frames: DataFrame, keys: list[str], order: str, lag: int = 1, block: int = BLOCK) -> DataFrame:
    """Each frame minus the one ``lag`` numbers before, where that exists; rows belong to the later frame."""
    earlier = Window.partitionBy(*keys, "_block").orderBy(order).rangeBetween(-lag, -lag)
    met = blocked(frames, order, lag, block).withColumn("_before", F.first("samples").over(earlier))
    return met.where(F.col("_home") & F.col("_before").isNotNull()).withColumn("samples", F.zip_with("samples", "_before", lambda a, b: a - b)).drop("_before", "_block", "_home")


def causal_windows(frames: DataFrame, keys: list[str], order: str, length: int, stride: int = 1, lag: int = 1, block: int = BLOCK, diff: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """Windows of ``length`` frames that end at each frame: profiles, then differences, divided by one peak.

    The difference of a frame is to the frame right before it, or what column ``diff`` holds. Windows start at frame
    ``lag`` of a recording, the first with a stored difference, and every ``stride`` after it; a window with a missing
    frame or difference is left out. Columns ``carry`` of a window are those of its last frame.
    """
    carry = carry or []
    first = frames.groupBy(*keys).agg(F.min(order).alias("_first"))
    w = Window.partitionBy(*keys, "_block").orderBy(order)
    as_float = lambda c: F.transform(c, lambda v: v.cast("float"))
    stored = [as_float(diff).alias("d")] if diff else []
    seen = blocked(frames.select(*keys, order, *carry, as_float("samples").alias("x"), *stored), order, length, block)
    if not diff:
        seen = seen.withColumn("b", F.first("x").over(w.rangeBetween(-1, -1))).withColumn("d", F.zip_with("x", "b", lambda a, c: a - c.cast("float")))
    back = w.rowsBetween(-(length - 1), 0)
    lists = seen.select(*keys, order, *carry, "_home", F.collect_list(F.when(F.col("d").isNotNull(), F.col("x"))).over(back).alias("xs"), F.collect_list("d").over(back).alias("ds"), F.first(order).over(back).alias("_from"))
    whole = (F.size("xs") == length) & (F.col("_from") == F.col(order) - (length - 1))
    start = F.col(order) - (length - 1) - lag - F.col("_first")
    flat = F.concat(F.flatten("xs"), F.flatten("ds"))
    kept = lists.where(F.col("_home") & whole).join(first, keys).where((start >= 0) & (start % stride == 0)).select(*keys, order, *carry, flat.alias("window"))
    peak = F.array_max(F.transform("window", F.abs))
    return kept.withColumn("window", _with_bound(peak, lambda s: F.when(s > 0, F.transform("window", lambda v: (v / s).cast("float"))).otherwise(F.col("window"))))


def trailing_median(rows: DataFrame, keys: list[str], order: str, value: str, width: int, name: str, block: int = BLOCK) -> DataFrame:
    """Rows with the median over the last ``width`` numbers, their own included; the first value stands before the start."""
    first = rows.groupBy(*keys).agg(F.min_by(value, order).alias("_first"), F.min(order).alias("_start"))
    back = Window.partitionBy(*keys, "_block").orderBy(order).rangeBetween(-(width - 1), 0)
    seen = blocked(rows, order, width - 1, block).withColumn("_seen", F.collect_list(value).over(back)).where("_home").join(first, keys)
    before = F.greatest(F.lit(0), F.lit(width - 1) - (F.col(order) - F.col("_start"))).cast("int")
    seen = seen.withColumn("_seen", F.array_sort(F.concat(F.array_repeat("_first", before), "_seen")))
    at = lambda k: F.element_at("_seen", F.floor(k / 2).cast("int") + 1)
    return seen.withColumn(name, (at(F.size("_seen")) + at(F.size("_seen") - 1)) / 2).drop("_seen", "_first", "_start", "_block", "_home")


def frame_at(frames: DataFrame, keys: list[str], order: str, index: int, rate: float) -> DataFrame:
    """One frame of each recording with its time; a negative index counts from the end, one beyond gives no row."""
    size = frames.groupBy(*keys).agg((F.max(order) + 1).alias("_n"))
    at = F.when(F.lit(index) < 0, F.col("_n") + index).otherwise(F.lit(index))
    return frames.join(size, keys).where(F.col(order) == at).withColumn("timestamp_s", F.col(order) / rate).drop("_n")


def descriptor_crop(x: Column, offset: int, bins: int) -> Column:
    """Bins [offset, offset + bins) of a profile; one that is too short is an error."""
    return F.when(F.size(x) >= offset + bins, F.slice(x, offset + 1, bins)).otherwise(F.raise_error(F.lit("the profile is shorter than the crop")))


def paired(originals: DataFrame, diffs: DataFrame, keys: list[str], lag: int) -> DataFrame:
    """(keys, frame, samples, diff): column j of the differences belongs to column j + ``lag`` of the originals."""
    later = diffs.select(*keys, (F.col("frame") + lag).alias("frame"), F.col("samples").alias("diff"))
    return originals.join(later, [*keys, "frame"])


def require_pairs(pairs: DataFrame, lag: int) -> None:
    """Originals but the first ``lag`` have their difference, of the same length and time, marked as a difference."""
    wrong = pairs.where(~F.col("differential") | (F.size("samples") != F.size("diff")) | (F.col("timestamp_s") != F.col("diff_timestamp_s"))).limit(1).count()
    if wrong:
        raise CaptureProcessingError("a frame's second part is not its difference")


def as_of(probes: DataFrame, labels: DataFrame, keys: list[str], ts: str, value: str) -> DataFrame:
    """Probes with the value of the latest label at or before them; probes without one are dropped.

    One sort by key and time over both sides; labels stand before probes of the same time.
    """
    both = probes.withColumns({"_probe": F.lit(1), "_v": F.lit(None).cast(labels.schema[value].dataType)}).unionByName(labels.select(*keys, ts, F.lit(0).alias("_probe"), F.col(value).alias("_v")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(ts, "_probe").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where(f"_probe = 1 AND {value} IS NOT NULL").drop("_probe", "_v")


def stab(points: DataFrame, intervals: DataFrame, keys: list[str], ts: str, bucket_seconds: int) -> DataFrame:
    """Points with the first interval (start_s, end_s, label) that holds them: start <= t < end.

    Both sides meet in time buckets by equality, so no side is compared with all of the other.
    """
    bucket = lambda c: F.floor(c / bucket_seconds)
    spread = intervals.withColumn("_b", F.explode(F.sequence(bucket(F.col("start_s")), bucket(F.col("end_s")))))
    met = points.withColumn("_b", bucket(F.col(ts))).join(spread, [*keys, "_b"]).where((F.col(ts) >= F.col("start_s")) & (F.col(ts) < F.col("end_s")))
    return met.groupBy(*points.columns).agg(F.min(F.struct("start_s", "label", "end_s")).alias("m")).select(*points.columns, F.col("m.label").alias("label"), F.col("m.start_s").alias("start_s"))


def gap_segments(rows: DataFrame, keys: list[str], ts: str, order: str, most_seconds: float) -> DataFrame:
    """Rows with the number of their segment; a gap of more than ``most_seconds`` starts the next."""
    w = Window.partitionBy(*keys).orderBy(ts, order)
    return rows.withColumn("_new", F.coalesce((F.col(ts) - F.lag(ts).over(w) > most_seconds).cast("int"), F.lit(0))).withColumn("segment", F.sum("_new").over(w)).drop("_new")


def sync_frame(t: Column, gt_sync: Column | float, audio_sync: Column | float, rate: int, frame_length: int) -> Column:
    """Frame of a video time, halves to even."""
    return F.bround(((t - gt_sync) * rate + audio_sync) / frame_length).cast("long")


def sync_time(frame: Column, gt_sync: Column | float, audio_sync: Column | float, rate: int, frame_length: int) -> Column:
    return (frame * frame_length - audio_sync) / rate + gt_sync


def noise_floor(values: DataFrame, keys: list[str], block: int = 96) -> DataFrame:
    """(keys, floor) from (keys, bin, value, n): block quantiles, their median scaled to a half-normal's median, capped.

    The first blocks are the larger ones when bins do not divide evenly.
    """
    import math

    scale = math.sqrt(2 * math.log(2)) / math.sqrt(-2 * math.log(0.9))
    k = F.greatest(F.lit(1), F.floor(F.col("n") / block))
    size, more = F.floor(F.col("n") / k), F.col("n") % k
    number = F.when(F.col("bin") < more * (size + 1), F.floor(F.col("bin") / (size + 1))).otherwise(more + F.floor((F.col("bin") - more * (size + 1)) / size))
    low = values.withColumn("_block", number).groupBy(*keys, "_block").agg(F.percentile(F.abs("value"), 0.1).alias("q"), F.max(F.abs("value")).alias("top"))
    return low.groupBy(*keys).agg(F.least(F.median("q") * scale, F.max("top")).alias("floor"))


def strongest_peak(frames: DataFrame, bin_metres: float, offset: float = 0.0) -> DataFrame:
    """Frames with their first largest bin, refined by a parabola through the logarithms of its neighbours."""
    x = F.col("samples")
    at = (F.array_position(x, F.array_max(x)) - 1).cast("int")
    seen = frames.withColumn("bin", at).withColumn("_n", F.size("samples"))
    ln = lambda d: F.log(F.greatest(F.element_at("samples", F.col("bin") + 1 + d), F.lit(1e-300)))
    inner = (F.col("bin") > 0) & (F.col("bin") < F.col("_n") - 1)
    for name, d in (("_l", -1), ("_c", 0), ("_r", 1)):
        seen = seen.withColumn(name, F.when(inner, ln(d)))
    bend = F.col("_l") - 2 * F.col("_c") + F.col("_r")
    delta = F.when(inner & (bend < 0), F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("_l") - F.col("_r")) / bend))).otherwise(0.0)
    out = seen.withColumn("delta", delta)
    amplitude = F.when(inner, F.exp(F.col("_c") - 0.25 * (F.col("_l") - F.col("_r")) * F.col("delta"))).otherwise(F.array_max(x))
    return out.withColumn("range_m", F.lit(offset) + (F.col("bin") + F.col("delta")) * bin_metres).withColumn("amplitude", amplitude).drop("_n", "_l", "_c", "_r")


def strong_enough(peaks: DataFrame, floors: DataFrame, keys: list[str], ratio: float = 4.0) -> DataFrame:
    """Peaks with their ratio to the noise floor; bin, range and amplitude are null for silent frames and weak peaks."""
    met = peaks.join(floors, keys, "left").withColumn("peak_to_noise", F.when(F.col("floor") > 0, F.col("amplitude") / F.col("floor")))
    fine = (F.col("amplitude") > 0) & (F.col("peak_to_noise").isNull() | (F.col("peak_to_noise") >= ratio))
    return met.withColumns({c: F.when(fine, F.col(c)) for c in ("bin", "range_m", "amplitude", "peak_to_noise")}).drop("floor")


def bin_zero(values: DataFrame, keys: list[str], bins: int = 40) -> DataFrame:
    """(keys, offset): among the first bins the first with the largest median over time."""
    medians = values.where(F.col("bin") < bins).groupBy(*keys, "bin").agg(F.median(F.abs("value")).alias("m"))
    return medians.groupBy(*keys).agg(F.min_by("bin", F.struct(-F.col("m"), "bin")).alias("offset"))


#: Lags that are tried, columns they are tried on, and the residual of a match.
LAGS, LAG_COLUMNS, LAG_RESIDUAL = range(1, 5), 256, 1e-3


def measured_lag(values: DataFrame, diffs: DataFrame, lags: range = LAGS, tolerance: float = LAG_RESIDUAL, columns: int = LAG_COLUMNS) -> DataFrame:
    """(lag, residual): how well the change into column j + lag of ``values`` (frame, bin, value) gives column j of
    ``diffs`` (frame, bin, d).

    ``diffs`` counts frames from its own first. Measured on the first ``columns`` differences.
    """
    out, diffs = None, diffs.where(F.col("frame") < columns)
    before = values.select((F.col("frame") + 1).alias("frame"), "bin", F.col("value").alias("b"))
    change = values.join(before, ["frame", "bin"]).select("frame", "bin", (F.col("value") - F.col("b")).alias("e"))
    for lag in lags:
        part = diffs.join(change.withColumn("frame", F.col("frame") - lag), ["frame", "bin"]).agg((F.sqrt(F.sum((F.col("d") - F.col("e")) ** 2)) / F.sqrt(F.sum(F.col("d") ** 2))).alias("residual")).select(F.lit(lag).alias("lag"), "residual")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("matches", F.coalesce(F.col("residual") <= tolerance, F.lit(False)))


def preparation(frames: DataFrame, keys: list[str], order: str, lag: int, bins: int = 40) -> DataFrame:
    """(keys, offset, lag) measured for every recording of (keys, order, samples, diff) at once.

    ``diff`` is the stored difference at ``order - lag``. ``offset`` is the bin of the largest median; ``lag`` the only
    lag whose changes give the stored differences, null where none or several do or a difference is all zero. Medians
    look at all frames, lags at the first 256 stored differences of each recording.
    """
    near = frames.select(*keys, F.posexplode(F.slice("samples", 1, bins)).alias("bin", "value"))
    offsets = bin_zero(near, keys, bins)
    first = frames.groupBy(*keys).agg(F.min(order).alias("_first"))
    early = frames.join(first, keys).withColumn("_at", F.col(order) - F.col("_first")).where(F.col("_at") < LAG_COLUMNS + max(LAGS) + lag)
    w = Window.partitionBy(*keys).orderBy("_at")
    change = early.withColumn("_b", F.lag("samples").over(w)).withColumn("_e", F.zip_with("samples", "_b", lambda a, b: a - b.cast("double")))
    square = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    seen = change.select(*keys, "diff", (F.col("_at") - lag).alias("_j"), *[F.lead("_e", k - lag).over(w).alias(f"_e{k}") for k in LAGS]).where(F.col("diff").isNotNull() & F.col("_j").between(0, LAG_COLUMNS - 1))
    parts = []
    for k in LAGS:
        there = F.col(f"_e{k}").isNotNull()
        far, size = F.sum(F.when(there, square(F.zip_with("diff", f"_e{k}", lambda a, b: a - b)))), F.sum(F.when(there, square("diff")))
        parts += [far.alias(f"far{k}"), size.alias(f"size{k}")]
    sums = seen.groupBy(*keys).agg(*parts)
    silent = F.coalesce(*[F.when(F.col(f"size{k}") <= 0, F.lit(True)) for k in LAGS], F.lit(False))
    matches = F.array_compact(F.array(*[F.when(F.sqrt(F.col(f"far{k}")) <= LAG_RESIDUAL * F.sqrt(F.col(f"size{k}")), F.lit(k)) for k in LAGS]))
    lags = sums.select(*keys, F.when(~silent & (F.size(matches) == 1), matches[0]).alias("lag"))
    return offsets.join(lags, keys, "left")


def preparation_fault(offset: int, lag: int) -> Column:
    """What is wrong with a measured (offset, lag), or null; a lag that cannot be measured is not wrong."""
    shifted = F.when(F.col("offset") != offset, F.concat(F.lit("bin zero is "), F.col("offset").cast("string"), F.lit(f", not {offset}")))
    other = F.when(F.col("lag") != lag, F.concat(F.lit("differences are at lag "), F.col("lag").cast("string"), F.lit(f", not {lag}")))
    return F.coalesce(shifted, other)


def require_preparation(frames: DataFrame, keys: list[str], order: str, offset: int, lag: int) -> None:
    """Refuses recordings whose measured bin zero, or lag where it can be measured, is another."""
    wrong = preparation(frames, keys, order, lag).withColumn("fault", preparation_fault(offset, lag)).where("fault IS NOT NULL").limit(1).collect()
    if wrong:
        raise PreprocessingMismatchError(f"{wrong[0]['fault']} in {[wrong[0][k] for k in keys]}")


def helmholtz_frequency(area: Column, volume: Column, neck: Column) -> Column:
    """Resonance of a cavity with an opening, in Hz."""
    return SPEED_OF_SOUND / (2 * F.pi()) * F.sqrt(area / (volume * neck))


def quality_factor(f: Column, bandwidth: Column) -> Column:
    return F.when(bandwidth > 0, f / bandwidth)


def reverberation_time(decay_rate: Column) -> Column:
    """Seconds until a resonance has fallen by 60 dB."""
    return F.when(decay_rate > 0, F.log(F.lit(1000.0)) / decay_rate)


def helmholtz_ratio(f: Column | float) -> Column:
    f = f if isinstance(f, Column) else F.lit(float(f))
    return F.pow(2 * F.pi() * f / SPEED_OF_SOUND, F.lit(2.0))
