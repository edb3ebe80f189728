"""Session trees on disk: names, records, configuration, and windows with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.errors import MissingLandmarksError
from tidewave.operators import frames as fr
from tidewave.operators.integrity import session_identity

# Device of each study-1 and study-2 folder name, and file endings.
FOLDER = r"^sub(\d+)_([a-z]+)_(left|right)$"
NESTED = r"^sub(\d+)$"
PROFILE_END, DIFF_END, LANDMARK_END = "_fmcw_16bit_profiles.npy", "_fmcw_16bit_diff_profiles.npy", "_landmarks.npy"
CONFIG = "audio struct<config:struct<sampling_rate:int,frame_length:int,n_channels:int,signal:string>,files:array<string>,syncing_poses:array<bigint>>, ground_truth struct<files:array<string>,syncing_poses:array<double>,videos:array<string>>, tasks array<string>"


def parse_paths(files: DataFrame) -> DataFrame:
    """Sessions from paths of profile files; names that do not parse are left out."""
    p = F.col("path")
    digits = lambda pattern: F.nullif(F.regexp_extract(p, pattern, 1), F.lit("")).try_cast("int")
    rest = F.regexp_extract(p, r"(?i)/study[-_ ]?\d/(.*)/[^/]+$", 1)
    stem = F.regexp_replace(F.regexp_extract(p, r"([^/]+)$", 1), PROFILE_END.replace(".", r"\.") + "$", "")
    top, nested = F.split(rest, "/")[0], F.split(rest, "/")
    number = F.regexp_extract(stem, r"^audio(\d+)$", 1)
    rows = files.where(F.endswith(p, F.lit(PROFILE_END))).select(p, digits(r"(?i)/study[-_ ]?(\d)/").alias("study"), digits(r"(?i)/study[-_ ]?\d/sub(\d+)").alias("participant"), F.nullif(F.regexp_extract(top, FOLDER, 2), F.lit("")).alias("device"), F.nullif(F.regexp_extract(top, FOLDER, 3), F.lit("")).alias("hand"), F.when(F.size(nested) > 1, nested[1]).alias("condition"), number.alias("n"), stem.alias("stem")).where((F.col("n") != "") & F.col("participant").isNotNull() & F.col("study").isNotNull())
    rows = rows.withColumn("session_index", F.col("n").cast("int") - 1).drop("n")
    return rows.withColumn("identity", session_identity(*(F.col(c) for c in ("study", "participant", "device", "hand", "condition", "session_index"))))


def scan(spark: SparkSession, folder: str, studies: list[int] | None = None) -> DataFrame:
    """Sessions of a tree, sorted by identity; paths alone are read, no manifest is asked."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{PROFILE_END}").load(folder).select("path")
    rows = parse_paths(files)
    return (rows.where(F.col("study").isin(*studies)) if studies else rows).orderBy("identity")


def side_files(path: Column) -> tuple[Column, Column, Column]:
    """Profile, difference and landmark files of a session by its profile file."""
    stem = F.regexp_replace(path, PROFILE_END.replace(".", r"\.") + "$", "")
    return tuple(F.concat(stem, F.lit(end)) for end in (PROFILE_END, DIFF_END, LANDMARK_END))


def require_one_device(sessions: DataFrame, devices: DataFrame) -> DataFrame:
    """Fails where a folder's device is not the participant's in (study, participant, known_device)."""
    met = sessions.join(devices, ["study", "participant"], "left")
    wrong = F.col("device").isNotNull() & F.col("known_device").isNotNull() & (F.col("device") != F.col("known_device"))
    return met.withColumn("device", F.when(wrong, F.raise_error(F.concat(F.lit("device differs in "), "identity"))).otherwise(F.coalesce("device", "known_device"))).drop("known_device")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONFIG).json(path, multiLine=True)


def sync_pair(config: DataFrame, index: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys and) ground-truth file and sync points of a session; an index beyond the lists is an error."""
    def at(c: str) -> Column:
        return F.when(F.size(c) > index, F.element_at(c, (index + 1).cast("int"))).otherwise(F.raise_error(F.lit(f"no entry in {c}")))

    return config.select(*(keys or []), at("audio.syncing_poses").alias("audio_sync"), at("ground_truth.syncing_poses").alias("gt_sync"), at("ground_truth.files").alias("gt_file"), F.regexp_replace(at("ground_truth.files"), r"\.[^.]+$", "_frame_time.txt").alias("frame_times"))


def gestures(lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys and) (label_id, start_s, end_s, name) from text lines; the name keeps its commas, blank lines are skipped."""
    keys = keys or []
    parts = F.split(F.col("value"), ",", 4)
    good = lines.where(F.trim("value") != "").select(*keys, F.when(F.size(parts) < 4, F.raise_error(F.concat(F.lit("too few fields: "), "value"))).otherwise(parts).alias("p"))
    out = good.select(*keys, F.trim(F.col("p")[0]).cast("int").alias("label_id"), F.trim(F.col("p")[1]).cast("double").alias("start_s"), F.trim(F.col("p")[2]).cast("double").alias("end_s"), F.trim(F.col("p")[3]).alias("name"))
    return out.withColumn("end_s", F.when(F.col("end_s") < F.col("start_s"), F.raise_error(F.lit("a gesture ends before it starts"))).otherwise(F.col("end_s")))


def frame_times(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim("value") != "").select(F.trim(F.split("value", ",")[0]).cast("double").alias("ts_s"))


def labelled_windows(profiles: DataFrame, landmarks: DataFrame, length: int, stride: int, lag: int, rate: int, frame_length: int) -> DataFrame:
    """Causal windows of (session_id, frame_idx, samples, audio_sync, gt_sync) with the latest landmarks at or before
    their end; windows before the first landmarks are dropped."""
    sync = profiles.select("session_id", "audio_sync", "gt_sync").distinct()
    windows = fr.causal_windows(profiles, ["session_id"], "frame_idx", length, stride, lag).join(sync, "session_id")
    timed = windows.withColumn("ts_s", fr.sync_time(F.col("frame_idx"), F.col("gt_sync"), F.col("audio_sync"), rate, frame_length))
    return fr.as_of(timed.select("session_id", "frame_idx", "window", "ts_s"), landmarks, ["session_id"], "ts_s", "joints")


def require_complete(landmarks: DataFrame, frames: int) -> None:
    """A file with one detection missing is refused as a whole."""
    n, bad = landmarks.agg(F.count("*"), F.sum(F.when(F.col("joints").isNull() | (F.size("joints") != 63), 1).otherwise(0))).first()
    if n != frames or bad:
        raise MissingLandmarksError(f"{n} of {frames} frames, {bad or 0} without complete landmarks")
