"""Sessions of a tree as verified profiles, landmarks and labelled windows.

Nothing is read before the manifest vouches for it: ``Corpus`` hashes the files of all sessions in one job, checks the
configurations, and then reads arrays by column ranges in Spark tasks. Plans have the same size and number of jobs for
one session and for thousands.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.errors import DatasetError, IntegrityError, LandmarkPreparationError, MissingLandmarksError
from tidewave.model import Descriptor, GroundTruth, Protocol, Split
from tidewave.operators import frames as fr
from tidewave.operators import poses
from tidewave.operators.integrity import listing, relative_to, statuses
from tidewave.operators.ordering import shared_folder
from tidewave.sources import npy, session_arrays, sessions

RATE, FRAME = 48000, 600


def require_config(config: DataFrame) -> None:
    """The sampling rate and the frame length of a session's configuration are those of the sensor."""
    row = config.select("audio.config.sampling_rate", "audio.config.frame_length").first()
    if row is None or (row[0], row[1]) != (RATE, FRAME):
        raise DatasetError(f"rate {row and row[0]} and frame length {row and row[1]} are not {RATE} and {FRAME}")


def dataset_protocol(dataset: str, version: str, split: Split, subjects: int, **options) -> Protocol:
    """The protocol of this dataset; its labels are fitted to video, which nobody may state otherwise."""
    if "ground_truth" in options:
        raise ValueError("the ground truth of a dataset is not a parameter")
    return Protocol(split, dataset, version, GroundTruth.VIDEO_FITTED, subjects, **options)


@dataclass
class Corpus:
    """A session tree below ``folder`` with its manifest (path, size_bytes, sha256), as plans over all its sessions.

    ``catalogue`` verifies every file once, in one job however many sessions there are; what follows reads arrays of
    sessions without a fault only. ``studies`` and ``participants`` leave other sessions out before anything is hashed.
    """

    spark: SparkSession
    folder: str
    manifest: DataFrame
    descriptor: Descriptor = field(default_factory=Descriptor)
    studies: list[int] | None = None
    participants: list[int] | None = None

    def __post_init__(self) -> None:
        session_arrays.register(self.spark)
        self._catalogue: str | None = None

    def sessions(self, studies: list[int] | None = None) -> DataFrame:
        """Sessions by scan, whether or not the manifest knows them, sorted by identity."""
        rows = sessions.scan(self.spark, self.folder, studies or self.studies)
        return rows.where(F.col("participant").isin(*self.participants)) if self.participants else rows

    def _relative(self, path: str) -> str:
        return path.partition(self.folder.rstrip("/") + "/")[2]

    def _configs(self) -> DataFrame:
        """(directory, sampling_rate, frame_length, audio, ground_truth) of every configuration below the folder."""
        files = self.spark.read.schema(sessions.CONFIG).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "config.json").json(self.folder)
        directory = F.regexp_replace(relative_to(self.folder, F.col("_metadata.file_path")), "/?config.json$", "")
        return files.select(directory.alias("directory"), "audio.config.sampling_rate", "audio.config.frame_length", "audio", "ground_truth")

    def catalogue(self) -> DataFrame:
        """One row a session with its files, synchronisation, and what is wrong with it; written once.

        ``fault`` is of profiles, differences or configuration, ``times_fault`` of gestures and frame times or of entries
        that the configuration does not have, ``landmarks_fault`` of a sidecar; null where all is well. ``ordinal`` numbers sessions by
        identity.
        """
        if self._catalogue is None:
            path = f"{shared_folder(self.spark)}/catalogue-{uuid.uuid4().hex}"
            self._plan().write.parquet(path)
            self._catalogue = path
        return self.spark.read.parquet(self._catalogue)

    def _plan(self) -> DataFrame:
        found = self.sessions().withColumn("path", relative_to(self.folder, F.col("path")))
        paths = dict(zip(("profiles", "diffs", "landmarks"), sessions.side_files(F.col("path")), strict=True))
        directory = F.regexp_replace("path", "/?[^/]+$", "")
        below = lambda name: F.concat(F.col("directory"), F.lit("/"), name)
        found = found.withColumns({"directory": directory, **paths}).drop("path", "stem").join(self._configs(), "directory", "left")
        at = lambda c: F.get(F.col(c), F.col("session_index"))
        records = at("ground_truth.files")
        found = found.withColumns({"audio_sync": at("audio.syncing_poses"), "gt_sync": at("ground_truth.syncing_poses"), "config": below(F.lit("config.json")), "records": below(records), "times": below(F.concat(F.regexp_replace(records, r"(_records)?[.][^.]+$", ""), F.lit("_frame_time.txt")))})
        kinds = ("profiles", "diffs", "config", "records", "times", "landmarks")
        each = found.select("identity", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("path")) for k in kinds])).alias("f")).select("identity", "f.*")
        # only files that some session asks for are hashed
        asked = each.where("path IS NOT NULL").select("path").distinct()
        files = statuses(self.manifest.join(asked, "path", "left_semi"), listing(self.spark, self.folder).join(asked, "path", "left_semi"))
        met = each.join(files, "path", "left").withColumn("status", F.coalesce("status", F.when(F.col("kind") != "landmarks", F.lit("missing"))))
        fault = lambda *of: F.min(F.when(F.col("kind").isin(*of) & (F.col("status") != "ok"), F.concat("kind", F.lit(" "), "status", F.lit(": "), F.coalesce("path", F.lit("no entry")))))
        of = lambda kind, c: F.max(F.when((F.col("kind") == kind) & (F.col("status") == "ok"), F.col(c)))
        by = met.groupBy("identity").agg(fault("profiles", "diffs", "config").alias("fault"), fault("records", "times").alias("times_fault"), fault("landmarks").alias("landmarks_fault"), of("profiles", "full").alias("profiles"), of("profiles", "size_now").alias("profiles_size"), of("diffs", "full").alias("diffs"), of("landmarks", "full").alias("landmarks"), of("landmarks", "size_now").alias("landmarks_size"), of("times", "full").alias("times"))
        wrong = F.when(~F.col("sampling_rate").eqNullSafe(RATE) | ~F.col("frame_length").eqNullSafe(FRAME), F.concat_ws(" ", F.lit("rate"), F.coalesce(F.col("sampling_rate").cast("string"), F.lit("unknown")), F.lit("and frame length"), F.coalesce(F.col("frame_length").cast("string"), F.lit("unknown")), F.lit(f"are not {RATE} and {FRAME}")))
        unsynced = F.when(F.col("audio_sync").isNull() | F.col("gt_sync").isNull(), F.lit("no synchronisation at the session's index"))
        about = found.select("study", "participant", "device", "hand", "condition", "session_index", "identity", "directory", "audio_sync", "gt_sync", wrong.alias("_wrong"), unsynced.alias("_unsynced"))
        out = about.join(by, "identity").withColumns({"fault": F.coalesce("fault", "_wrong"), "times_fault": F.coalesce("times_fault", "_unsynced"), "ordinal": F.row_number().over(Window.orderBy("identity"))})  # a row a session
        return out.drop("_wrong", "_unsynced")

    def _read(self, which: str, columns: str | None = None, faults: str = "fail", only: dict | None = None) -> DataFrame:
        self.catalogue()
        reader = self.spark.read.format("session_arrays").options(catalogue=self._catalogue, which=which, rows=FRAME, lag=self.descriptor.differential_lag, faults=faults, only=json.dumps(only or {}))
        return (reader.schema(columns) if columns else reader).load()

    def frames(self, faults: str = "fail", **only: list) -> DataFrame:
        """(session columns, frame_idx, samples, diff) of all sessions; with ``skip`` those with a fault are left out.

        ``study=[1]``, ``participant=[1, 3]`` and the like leave other sessions out before the scan is planned.
        """
        return self._read("profiles", faults=faults, only=only)

    def measured(self, faults: str = "fail") -> DataFrame:
        """(identity, offset, lag, fault) as ``frames.preparation`` measures every session's arrays."""
        d = self.descriptor
        rows = self._read("profiles", "identity string, frame_idx bigint, samples array<float>, diff array<float>", faults)
        return fr.preparation(rows, ["identity"], "frame_idx", d.differential_lag).withColumn("fault", fr.preparation_fault(d.bin_zero_offset, d.differential_lag))

    def prepared_frames(self, faults: str = "fail") -> DataFrame:
        """``frames`` whose sessions were measured and found to be as the descriptor says; others fail in the plan."""
        measured = self.measured(faults).select("identity", F.concat("fault", F.lit(" in "), "identity").alias("_fault"))
        met = self.frames(faults).join(measured, "identity")
        return met.withColumn("samples", F.when(F.col("_fault").isNotNull(), F.raise_error(F.col("_fault"))).otherwise(F.col("samples"))).drop("_fault")

    def poses(self, faults: str = "fail") -> DataFrame:
        """(identity, frame_no, joints) of the sidecars of all sessions; an incomplete one fails."""
        return poses_of(self._read("landmarks", "identity string, frame_idx bigint, joints array<float>", faults).withColumnRenamed("frame_idx", "frame_no"))

    def frame_times(self) -> DataFrame:
        """(identity, frame_no, ts_s) from the verified lists of all sessions; blank lines are not counted."""
        lists = self.spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*_frame_time.txt").text(self.folder, wholetext=True)
        lists = lists.select(relative_to(self.folder, F.col("_metadata.file_path")).alias("path"), "value")
        known = self.catalogue().where("times IS NOT NULL").select("identity", relative_to(self.folder, F.col("times")).alias("path"))
        lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
        rows = known.join(lists, "path").select("identity", F.posexplode(lines).alias("frame_no", "line"))
        return rows.select("identity", F.col("frame_no").cast("bigint").alias("frame_no"), F.trim(F.split("line", ",")[0]).cast("double").alias("ts_s"))

    def examples(self, stride: int = 1, faults: str = "fail") -> DataFrame:
        """(sample_id, participant, session, device, ts, frame_idx, window, joints): labelled windows of all sessions.

        A window has the latest landmarks at or before its end; those before the first are dropped. Sessions without
        landmarks, frame times or synchronisation fail (or are left out with ``skip``). Moments are labelled before
        arrays are read, by sessions and numbers alone. ``sample_id`` is the session's number and the frame's.
        """
        d, known = self.descriptor, self.catalogue()
        missing = F.coalesce("fault", "times_fault", "landmarks_fault", F.when(F.col("landmarks").isNull(), F.lit("no landmarks beside it")))
        known = known.withColumn("_missing", F.concat("identity", F.lit(": "), missing))
        if faults == "skip":
            known = known.where("_missing IS NULL")
        sync = known.select("identity", "ordinal", F.when(F.col("_missing").isNotNull(), F.raise_error(F.col("_missing"))).otherwise(F.col("audio_sync")).alias("audio_sync"), "gt_sync")
        moments = self._read("profiles", "identity string, frame_idx bigint", faults).join(sync, "identity")
        moments = moments.select("identity", "ordinal", "frame_idx", fr.sync_time(F.col("frame_idx"), F.col("gt_sync"), F.col("audio_sync"), RATE, FRAME).alias("ts_s"))
        marks = self.poses(faults).join(self.frame_times(), ["identity", "frame_no"]).select("identity", "ts_s", "joints")
        labels = fr.as_of(moments, marks, ["identity"], "ts_s", "joints").select("identity", "ordinal", "frame_idx", "ts_s", "joints")
        cut = lambda c: fr.descriptor_crop(F.col(c), d.bin_zero_offset, d.crop_bins)
        rows = self.prepared_frames(faults).withColumns({"samples": cut("samples"), "diff": F.when(F.col("diff").isNotNull(), cut("diff"))})
        rows = rows.join(labels, ["identity", "frame_idx"], "left").withColumn("about", F.struct("study", "participant", "device", "ordinal", "ts_s", "joints"))
        windows = fr.causal_windows(rows, ["identity"], "frame_idx", d.window_frames, stride, d.differential_lag, diff="diff", carry=["about"]).where("about.joints IS NOT NULL")
        device = F.coalesce("about.device", F.lit("unknown-device"))
        return windows.select((F.col("about.ordinal") * F.lit(1 << 32) + F.col("frame_idx")).alias("sample_id"), poses.study_participant(F.col("about.study"), F.col("about.participant")).alias("participant"), F.col("identity").alias("session"), device.alias("device"), F.col("about.ts_s").alias("ts"), "frame_idx", "window", F.col("about.joints").alias("joints"))

    def dataset(self, features: bool = False, limit: int | None = None, stride: int = 1, faults: str = "fail") -> DataFrame:
        """Samples for evaluation: (sample_id, participant, session, device, ts, pose) and, if asked for, the windows.

        Poses have their wrist at the origin. ``limit`` takes the first samples in the order of sessions and frames.
        """
        if limit is not None and limit < 1:
            raise ValueError("a limit is positive")
        rows = self.examples(stride, faults)
        rows = rows.orderBy("sample_id").limit(limit) if limit else rows
        pose = poses.wrist_relative(F.col("joints").cast("array<double>")).alias("pose")
        return rows.select("sample_id", "participant", "session", "device", "ts", pose, *([F.col("window").cast("array<double>").alias("features")] if features else []))

    # One session of the tree, by the path of its profiles

    def _one(self, path: str) -> tuple[str, Row]:
        found = self.sessions().where(F.endswith("path", F.lit(self._relative(path)))).select("identity").first()
        row = self.catalogue().where(F.col("identity") == found["identity"]).first() if found else None
        if row is None:
            raise DatasetError(f"no session at {path}")
        return row["identity"], row

    def profiles(self, path: str) -> DataFrame:
        """(session_id, frame_idx, samples, diff) of one session's two files, verified; the first lag frames have none."""
        identity, row = self._one(path)
        if row["fault"]:
            raise DatasetError(row["fault"]) if row["fault"].startswith("rate") else IntegrityError(row["fault"])
        rows = self.frames(identity=[identity]).where(F.col("diff").isNotNull())
        return rows.select(F.lit(self._relative(path)).alias("session_id"), "frame_idx", "samples", "diff")

    def prepared(self, path: str) -> DataFrame:
        """``profiles`` after their bin zero and lag were measured and found to be the descriptor's."""
        identity, row = self._one(path)
        found = self.profiles(path)
        d = self.descriptor
        rows = self.frames(identity=[identity])
        fr.require_preparation(rows, ["identity"], "frame_idx", d.bin_zero_offset, d.differential_lag)
        return found

    def landmarks(self, path: str) -> DataFrame | None:
        """(frame_no, joints) of a session's sidecar; None without one, which then must not be in the manifest."""
        identity, row = self._one(path)
        if row["landmarks_fault"]:
            raise IntegrityError(row["landmarks_fault"])
        if row["landmarks"] is None:
            return None
        return self._read("landmarks", only={"identity": [identity]}).select(F.col("frame_idx").alias("frame_no"), "joints")

    def labelled(self, path: str, audio_sync: int, gt_sync: float, frame_times: DataFrame, stride: int = 1) -> DataFrame:
        """Windows of a session, measured first, with the latest landmarks at or before their end."""
        marks = self.landmarks(path)
        if marks is None:
            raise MissingLandmarksError(f"no landmarks beside {path}")
        d = self.descriptor
        cut = lambda c: fr.descriptor_crop(F.col(c), d.bin_zero_offset, d.crop_bins)
        rows = self.prepared(path).select("session_id", "frame_idx", cut("samples").alias("samples"), cut("diff").alias("diff"))
        # the frames without a difference are gone, so windows may start at the first that is left
        windows = fr.causal_windows(rows, ["session_id"], "frame_idx", d.window_frames, stride, 0, diff="diff")
        timed = windows.withColumn("ts_s", fr.sync_time(F.col("frame_idx"), F.lit(float(gt_sync)), F.lit(audio_sync), RATE, FRAME))
        labels = poses_of(marks).join(frame_times, "frame_no").select(F.lit(self._relative(path)).alias("session_id"), "ts_s", "joints")
        return fr.as_of(timed.select("session_id", "frame_idx", "window", "ts_s"), labels, ["session_id"], "ts_s", "joints")


def poses_of(landmarks: DataFrame) -> DataFrame:
    """Landmarks with complete poses; a missing or incomplete one fails, as no pose may be made up."""
    fine = F.coalesce((F.size("joints") == 63) & F.forall("joints", lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(False))
    return landmarks.withColumn("joints", F.when(fine, F.col("joints")).otherwise(F.raise_error(F.lit("landmarks are missing or incomplete"))))


def require_features(samples: DataFrame) -> DataFrame:
    """Samples as they are; missing features are refused and never replaced by labels."""
    if "features" not in samples.columns or samples.where("features IS NULL").limit(1).count():
        raise DatasetError("samples without features")
    return samples


#: Frames of a video -> (frame_no, joints or null).
LandmarkDetector = Callable[[DataFrame], DataFrame]


def write_sidecars(found: DataFrame) -> DataFrame:
    """(target, frames): (target, frame_no, joints) written as one .npy matrix (frames, 63) for each target path.

    A target is written in one task, which holds one session's landmarks, under another name and moved when it is whole.
    """

    def write(data: pa.Table) -> pa.Table:
        target = data["target"][0].as_py()
        order = np.argsort(data["frame_no"].to_numpy(), kind="stable")
        values = data["joints"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(order), -1)[order]
        out = io.BytesIO()
        np.save(out, values)
        store, inner = fs.FileSystem.from_uri(target if "://" in target else f"file://{target.removeprefix('file:')}")
        part = f"{inner}.{uuid.uuid4().hex}"
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        with store.open_output_stream(part) as file:
            file.write(out.getvalue())
        store.move(part, inner)
        return pa.table({"target": [target], "frames": pa.array([len(order)], pa.int64())})

    return found.select("target", "frame_no", F.col("joints").cast("array<float>").alias("joints")).groupBy("target").applyInArrow(write, "target string, frames bigint")


def prepare_landmarks(video: DataFrame, frame_times: DataFrame, detector: LandmarkDetector, folder: str, provenance: dict, stem: str = "audio001") -> DataFrame:
    """Landmarks of a video through an injected detector, as the sidecar that ``Corpus`` reads, with where they come from.

    One missing detection, another number of frames than of times, or a sidecar that is there already fails the whole
    file. The detector runs once; what it found is written before it is looked at.
    """
    spark = video.sparkSession
    kept = f"{shared_folder(spark)}/landmarks-{uuid.uuid4().hex}"
    detector(video).select("frame_no", "joints").write.parquet(kept)
    found = spark.read.parquet(kept)
    n, bad = found.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("joints").isNull() | (F.size("joints") != 63) | F.exists("joints", lambda v: v.isNull() | F.isnan(v)), 1).otherwise(0)), F.lit(0))).first()
    times = frame_times.count()
    if n != times or bad:
        raise LandmarkPreparationError(f"{n} frames for {times} times, {bad} without complete landmarks")
    target = f"{folder}/{stem}{sessions.LANDMARK_END}"
    store, inner = fs.FileSystem.from_uri(target if "://" in target else f"file://{target.removeprefix('file:')}")
    if store.get_file_info(inner).type is not fs.FileType.NotFound:
        raise LandmarkPreparationError(f"{target} is there already")
    write_sidecars(found.withColumn("target", F.lit(target))).collect()  # one row
    with store.open_output_stream(inner.removesuffix(".npy") + ".json") as file:
        file.write(json.dumps({"schema": "landmarks/1", "frames": n, **provenance}, sort_keys=True).encode())
    npy.register(spark)
    return spark.read.format("npy_columns").option("path", target).option("axis", "rows").load().select(F.col("frame_idx").alias("frame_no"), F.col("samples").alias("joints"))
