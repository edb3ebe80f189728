import datetime as dt
import time
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave import registry
from tidewave.errors import ExperimentError, IntegrityError, LeakageError
from tidewave.model import Descriptor, GroundTruth, Measurement, Normalisation, Protocol, Split
from tidewave.operators import integrity, poses
from tidewave.operators import frames as fr
from tidewave.plans import fitting, suite
from tidewave.plans.guards import Binding, Finding, GuardName, GuardReport, Report, Row, Waiver, run_guards

P = Protocol(Split.CROSS_USER, "synthetic", "1", GroundTruth.SYNTHETIC, 6)


def test_leakage_is_raised(spark, sf):
    s = registry.samples(spark, sf)
    folded = poses.folds(s, Split.CROSS_USER)
    poses.require_no_leakage(folded, s, Split.CROSS_USER)
    with pytest.raises(LeakageError):
        poses.require_no_leakage(folded.unionByName(folded.withColumn("role", F.lit("train"))), s, Split.CROSS_USER)


def people(spark, n=6, sessions=2, per=8, devices=3, seed=7, noise=0.001):
    """Balanced people on rotating devices, each with a hand of their own; features say the finger curls."""
    r = np.random.default_rng(seed)
    rows = []
    for p in range(n):
        hand = r.normal(0, 0.05, (21, 3))
        for s in range(sessions):
            for t in range(per):
                curl = r.uniform(0, 1, 5)
                pose = hand + np.repeat(np.append(0, np.repeat(curl, 4))[:, None], 3, axis=1) * 0.03 + r.normal(0, noise, (21, 3))
                rows.append((len(rows), f"P{p:02d}", f"S{s}", f"D{(p + s) % devices}", float(t), (pose - pose[0]).ravel().tolist(), curl.tolist()))
    return spark.createDataFrame(rows, "sample_id long, participant string, session string, device string, ts double, pose array<double>, features array<double>")


def perfect(train, test):
    return test.select("sample_id", F.transform("pose", lambda v: v + 0.001).alias("guess"))


def test_a_good_model_gets_a_headline_across_users(spark, tmp_path):
    """Concentration looks at all folds together, so that a fold of one person does not block by itself."""
    s = people(spark).cache()
    done = suite.cross_user(s, P, "good", perfect)
    assert done.report.refusals() == [] and done.report.headline().startswith("good: 0.0")
    assert {r.name for r in done.report.rows} == {"good", "mean-pose", "subject-mean", "nearest-neighbour"}
    assert set(done.report.beaten()) == {"mean-pose", "subject-mean", "nearest-neighbour"}
    assert sorted(done.folds) == [f"p{i:02d}" for i in range(6)] and all(len(f.rows) == 4 for f in done.folds.values())
    assert "MPJPE20" in done.report.table() and "fingertips" in done.report.text() and "6 folds" in done.notes["good"]
    done.write(str(tmp_path))
    assert (tmp_path / "folds" / "05" / "report.json").exists() and "NO HEADLINE" not in (tmp_path / "report.txt").read_text()
    assert spark.read.parquet(str(tmp_path / "predictions")).count() == 4 * s.count()
    # the same numbers by hand: the mean of the others, sample by sample
    rows = s.collect()
    errors = []
    for r in rows:
        mean = np.mean([x["pose"] for x in rows if x["participant"] != r["participant"]], axis=0).reshape(21, 3)
        errors.append(1000 * np.linalg.norm((mean - mean[0]) - np.array(r["pose"]).reshape(21, 3), axis=1).mean())
    assert abs(next(r for r in done.report.rows if r.name == "mean-pose").mpjpe.value - np.mean(errors)) < 1e-6


def test_guards_block_copies_and_lone_people(spark):
    s = people(spark)
    copies = s.unionByName(s.where("participant = 'P00'").withColumns({"participant": F.lit("P77"), "sample_id": F.col("sample_id") + 1000}))
    report = suite.cross_user(copies, P, "good", perfect).report
    assert [f.guard for f in report.guards.blocking] == [GuardName.LABEL_MATCH] and "NO HEADLINE" in report.headline()
    assert set(report.guards.findings[1].detail["failed"]) == {"p00", "p77"}
    lone = s.where("participant <> 'P01' OR ts < 1").where("participant IN ('P00', 'P01')").unionByName(s.where("participant = 'P02' AND ts < 1"))
    assert GuardName.CONCENTRATION in [f.guard for f in suite.cross_user(lone, P, "good", perfect).report.guards.blocking]


def test_suite_measures_or_refuses(spark, sf, tmp_path):
    s = people(spark, per=4)
    out = suite.run_suite(s, P, "good", perfect)
    assert set(out.reports) == set(Split) and out.absence(Split.CROSS_USER) is None
    assert all(f.passed for f in out.reports[Split.CROSS_USER].guards.findings)
    # every device holds people that others hold too, so their labels match by design
    assert [f.guard for f in out.reports[Split.CROSS_DEVICE].guards.blocking] == [GuardName.LABEL_MATCH]
    suite.write_suite(out, str(tmp_path))
    assert (tmp_path / "splits" / "cross_session" / "report.txt").exists() and "guards block" in (tmp_path / "report.json").read_text()
    apart = s.where("(participant IN ('P00', 'P03') AND session = 'S0') OR (participant NOT IN ('P00', 'P03'))").withColumn("device", F.concat(F.lit("D"), (F.substring("participant", 3, 1).cast("int") % 3).cast("string")))
    assert suite.measure(apart, Split.CROSS_DEVICE, replace(P, split=Split.CROSS_DEVICE), "good", perfect).report.refusals() == []
    few = suite.run_suite(s.where("participant = 'P00' AND device = 'D0'").drop("features"), P, "good", perfect)
    assert few.absence(Split.CROSS_USER) and few.headline().startswith("NO HEADLINE") and "nearest-neighbour" not in few.reports[Split.WITHIN_SESSION].table()


def test_baselines_of_own_folds(spark):
    """A fold builder's folds give what the family's own do."""
    s = people(spark, n=4, per=3)
    own = suite.measure(s, Split.CROSS_USER, P, "mean", suite.fold_means).report
    built = suite.measure(s, Split.CROSS_USER, P, "mean", suite.fold_means, builder=lambda x: poses.folds(x, Split.CROSS_USER)).report
    assert [(r.name, round(r.mpjpe.value, 9)) for r in own.rows] == [(r.name, round(r.mpjpe.value, 9)) for r in built.rows]
    assert [f.passed for f in own.guards.findings] == [f.passed for f in built.guards.findings]
    for split in (Split.CROSS_USER, Split.CROSS_SESSION, Split.CROSS_DEVICE):
        want = {(r["fold"], r["sample_id"]) for r in poses.folds(s, split).where("role = 'test'").collect()}
        assert {(r["fold"], r["sample_id"]) for r in suite.Family.of(s, split).test().collect()} == want and want
    with pytest.raises(LeakageError):
        suite.Family.of(s.unionByName(s.where("sample_id = 0").withColumn("device", F.lit("D9"))), Split.CROSS_DEVICE)
    with pytest.raises(ExperimentError):
        suite.measure(s, Split.WITHIN_SESSION, replace(P, split=Split.WITHIN_SESSION), "x", suite.fold_means, builder=lambda x: poses.folds(x, Split.WITHIN_SESSION).unionByName(poses.folds(x, Split.WITHIN_SESSION)))


def test_calibration_sweep(spark):
    from tidewave.plans import calibration

    s = people(spark, n=3, sessions=3, per=40).cache()
    test = s.where("session = 'S2'").select(F.col("participant").alias("fold"), "sample_id", F.lit("test").alias("role"))
    others = s.where("session = 'S0'").select("sample_id", F.col("participant").alias("p")).join(s.select(F.col("participant").alias("fold")).distinct(), F.col("fold") != F.col("p")).select("fold", "sample_id", F.lit("train").alias("role"))
    folded = test.unionByName(others)
    curve = calibration.sweep(s, folded, suite.fold_means, P, 6.0)
    assert [p.requested for p in curve.points] == [0, 1, 2, 20] and curve.zero_shot.achieved == 0 and curve.two_minutes.achieved == 2
    assert curve.at(20.0).truncated and curve.at(20.0).achieved == 8.0 and curve.at(3.0) is None
    assert curve.monotone and curve.gain > 0 and curve.best.requested == 20 and "asked for 20" in curve.text() and '"monotone": true' in curve.as_json()
    with pytest.raises(ValueError):
        calibration.sweep(s, poses.folds(s, Split.CROSS_USER), suite.fold_means, P, 6.0)


def test_fold_tables_and_identities(spark):
    names = spark.createDataFrame([("Straße ",), ("STRASSE",), ("ﬁn",), ("FIN",), ("Σοφός",), ("σοφόσ",)], "n string").select(poses.identity(F.col("n")).alias("i")).collect()
    assert [names[k]["i"] == names[k + 1]["i"] for k in (0, 2, 4)] == [True] * 3


def test_reports_refuse():
    report = Report()
    assert report.refusals() == ["no rows"]
    report.add(Row("m", "model", Measurement(10.0, "mm", P, 5)))
    assert "no baseline" in report.refusals() and "the guards were not run" in report.refusals()
    report.add(Row("b", "baseline", Measurement(10.5, "mm", P, 5)))
    with pytest.raises(ExperimentError):
        report.add(Row("c", "baseline", Measurement(10.5, "mm", P.at_calibration(2), 5)))
    report.guards = GuardReport(tuple(Finding(g, True, "") for g in GuardName), Binding(P.split, P.dataset, P.dataset_version, 8, 4, "f"))
    assert report.refusals() == [] and "does NOT clearly beat b" in report.headline()


def test_waivers():
    reason = "the second recording session was lost when the watch restarted in the field"
    w = Waiver(GuardName.CONCENTRATION, reason, "someone", dt.date.today() + dt.timedelta(days=5))
    assert not Finding(GuardName.CONCENTRATION, False, "", {}, w).blocking
    assert Finding(GuardName.LABEL_MATCH, False, "", {}, w).blocking
    with pytest.raises(ValueError):
        Waiver(GuardName.CONCENTRATION, "too short", "x", dt.date.today())


def test_procrustes_takes_out_a_similarity_but_no_reflection(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((21, 3))
    q, _ = np.linalg.qr(r.standard_normal((3, 3)))
    q *= np.sign(np.linalg.det(q))
    rows = [(0, (x @ q * 1.7 + 3).ravel().tolist(), x.ravel().tolist()), (1, (x * [1, 1, -1]).ravel().tolist(), x.ravel().tolist())]
    d = spark.createDataFrame(rows, "i int, p array<double>, t array<double>")
    fit = d.select("i", "t", poses.procrustes(F.col("p"), F.col("t")).alias("f"))
    e = {r["i"]: r["e"] for r in fit.select("i", poses.mean_of(poses.joint_errors(F.col("f"), F.col("t"), poses.Alignment.NONE)).alias("e")).collect()}
    assert e[0] < 1e-6 < 1 < e[1]


def test_manifest_round_trip(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.TXT").write_text("one")
    (tmp_path / "a" / "y.mp4").write_text("no")
    files = integrity.tree(spark, str(tmp_path / "a"))
    out = tmp_path / "m.json"
    integrity.write_manifest(integrity.manifest(files), str(out), "d")
    kept = integrity.read_manifest(spark, str(out))
    integrity.require_ok(integrity.verify(kept, files))
    (tmp_path / "a" / "x.TXT").write_text("two")
    with pytest.raises(IntegrityError, match="content changed: x.TXT"):
        integrity.require_ok(integrity.verify(kept, integrity.tree(spark, str(tmp_path / "a"))))


def test_npy_source(spark, tmp_path):
    from tidewave.sources import npy

    x = np.arange(30, dtype=np.float32).reshape(3, 10)
    npy.register(spark)
    for name, data in (("c", x), ("f", np.asfortranarray(x))):
        np.save(tmp_path / f"{name}.npy", data)
        for axis, want in (("columns", x.T), ("rows", x)):
            got = spark.read.format("npy_columns").option("path", str(tmp_path / f"{name}.npy")).option("axis", axis).option("columns_per_partition", 4).load().orderBy("frame_idx").collect()
            assert [r["samples"] for r in got] == want.tolist()
    np.save(tmp_path / "d.npy", x.astype(float))
    with pytest.raises(Exception, match="not 32-bit floats"):
        spark.read.format("npy_columns").option("path", str(tmp_path / "d.npy")).load().count()


def session_tree(root, frames=40, rate=48000):
    """One session with a static and a moving peak, its differences at lag 2, landmarks and a configuration."""
    import json

    r = np.random.default_rng(0)
    x = r.normal(0, 0.1, (600, frames)).astype(np.float32)
    x[3] += 40
    x[12 + (np.arange(frames) % 7), np.arange(frames)] += 8
    at = root / "Study-1" / "sub1_samsung_left"
    at.mkdir(parents=True)
    np.save(at / "audio001_fmcw_16bit_profiles.npy", x)
    np.save(at / "audio001_fmcw_16bit_diff_profiles.npy", np.diff(x, axis=1)[:, 1:])
    np.save(at / "audio001_landmarks.npy", r.normal(0, 1, (5, 63)).astype(np.float32))
    (at / "config.json").write_text(json.dumps({"audio": {"config": {"sampling_rate": rate, "frame_length": 600}, "files": ["a"], "syncing_poses": [0]}, "ground_truth": {"files": ["g.npy"], "syncing_poses": [0.0]}}))
    return x


def test_corpus_reads_only_what_the_manifest_vouches_for(spark, tmp_path):
    from tidewave.errors import DatasetError, MissingLandmarksError, PreprocessingMismatchError
    from tidewave.sources.corpus import Corpus, dataset_protocol

    x = session_tree(tmp_path)
    kept = integrity.manifest(integrity.tree(spark, str(tmp_path))).cache()
    d = Descriptor(crop_bins=20, window_frames=4, bin_zero_offset=3)
    c = Corpus(spark, str(tmp_path), kept, d)
    path = c.sessions().first()["path"]
    rows = c.prepared(path).orderBy("frame_idx").collect()
    assert [r["frame_idx"] for r in rows] == list(range(2, 40)) and np.allclose(rows[5]["diff"], x[:, 7] - x[:, 6])
    assert c.landmarks(path).count() == 5
    times = spark.createDataFrame([(i, i * 0.1) for i in range(5)], "frame_no long, ts_s double")
    windows = c.labelled(path, 0, 0.0, times).collect()
    assert windows and all(len(r["window"]) == 2 * 4 * 20 for r in windows)
    with pytest.raises(PreprocessingMismatchError, match="bin zero"):
        Corpus(spark, str(tmp_path), kept, d.with_(bin_zero_offset=4)).prepared(path)
    with pytest.raises(PreprocessingMismatchError, match="lag"):
        Corpus(spark, str(tmp_path), kept, d.with_(differential_lag=1)).prepared(path)
    with pytest.raises(IntegrityError, match="not in the manifest"):
        Corpus(spark, str(tmp_path), kept.where("path NOT LIKE '%diff%'"), d).profiles(path)
    without = Corpus(spark, str(tmp_path), kept.where("path NOT LIKE '%landmarks%'"), d)
    with pytest.raises(IntegrityError, match="not in the manifest"):
        without.landmarks(path)
    (tmp_path / "Study-1" / "sub1_samsung_left" / "audio001_landmarks.npy").unlink()
    without = Corpus(spark, str(tmp_path), kept.where("path NOT LIKE '%landmarks%'"), d)
    assert without.landmarks(path) is None
    with pytest.raises(MissingLandmarksError):
        without.labelled(path, 0, 0.0, times)
    assert dataset_protocol("d", "1", Split.CROSS_USER, 3).ground_truth is GroundTruth.VIDEO_FITTED
    other = tmp_path / "other"
    session_tree(other, rate=44100)
    with pytest.raises(DatasetError, match="44100"):
        Corpus(spark, str(other), integrity.manifest(integrity.tree(spark, str(other))), d).profiles(str(other / "Study-1" / "sub1_samsung_left" / "audio001_fmcw_16bit_profiles.npy"))


def test_landmark_preparation_is_all_or_nothing(spark, tmp_path):
    from tidewave.errors import LandmarkPreparationError
    from tidewave.sources.corpus import prepare_landmarks

    video = spark.createDataFrame([(i,) for i in range(4)], "frame_no long")
    times = video.select("frame_no", (F.col("frame_no") / 30).alias("ts_s"))
    seen = lambda v: v.select("frame_no", F.array_repeat(F.lit(0.5), 63).alias("joints"))
    out = prepare_landmarks(video, times, seen, str(tmp_path / "a"), {"detector": "x"})
    assert out.count() == 4 and "x" in spark.read.text(str(tmp_path / "a" / "audio001_landmarks.json")).first()[0]
    with pytest.raises(LandmarkPreparationError):
        prepare_landmarks(video, times, lambda v: seen(v).withColumn("joints", F.when(F.col("frame_no") > 0, F.col("joints"))), str(tmp_path / "b"), {})
    with pytest.raises(LandmarkPreparationError):
        prepare_landmarks(video.limit(3), times, seen, str(tmp_path / "b"), {})


def test_windows_in_blocks_equal_whole_recordings(spark):
    """Differences, windows and trailing medians do not depend on where blocks begin, also behind missing frames."""
    r = np.random.default_rng(0)
    rows = [(k, i, r.normal(0, 1, 4).tolist(), float(r.normal())) for k in "ab" for i in range(5, 60) if (k, i) != ("a", 30)]
    f = spark.createDataFrame(rows, "k string, i long, samples array<double>, v double")
    plain = lambda d: sorted(map(str, d.collect()))
    for make in (lambda b: fr.differences(f, ["k"], "i", 3, block=b).select("k", "i", "samples"), lambda b: fr.causal_windows(f, ["k"], "i", 5, 2, 2, block=b), lambda b: fr.trailing_median(f, ["k"], "i", "v", 6, "m", block=b).select("k", "i", "m")):
        assert plain(make(4)) == plain(make(7)) == plain(make(4096))
    got = {(x["k"], x["i"]) for x in fr.differences(f, ["k"], "i", 3, block=4).collect()}
    assert ("a", 33) not in got and ("a", 34) in got and len(got) == 2 * 52 - 1 - 1
    mine = [v for k, i, _, v in rows if k == "b"]
    medians = {x["i"]: x["m"] for x in fr.trailing_median(f, ["k"], "i", "v", 6, "m", block=4).where("k = 'b'").collect()}
    padded = [mine[0]] * 5 + mine
    assert all(abs(medians[5 + n] - np.median(padded[n : n + 6])) < 1e-12 for n in range(len(mine)))


def test_training_settings_and_metadata(spark, tmp_path):
    from tidewave.errors import CheckpointLoadError, TrainingError
    from tidewave.plans import checkpoint as cp

    with pytest.raises(TrainingError):
        cp.TrainingConfig(0, 8, 0.1)
    c = cp.TrainingConfig(3, 8, 0.1, seed=4)
    assert (c.order(1, 9) == c.order(1, 9)).all() and (c.order(1, 9) != c.order(2, 9)).any()
    with pytest.raises(TrainingError):
        cp.require_history([1.0, float("nan"), 0.5], c)
    s = people(spark, n=2, per=4)
    features, pose = cp.fit_normalizers(s)
    x = np.array([r["features"] for r in s.collect()])
    assert np.allclose(features.mean, x.mean(0)) and np.allclose(features.sd, x.std(0)) and pose.sd[0] == 1e-6
    (tmp_path / "w").write_bytes(b"w")
    cp.write_metadata(str(tmp_path / "m.json"), "pose-cnn/1,width=32", Descriptor(), P, str(tmp_path / "w"))
    assert cp.model_width(cp.read_metadata(str(tmp_path / "m.json"))["model"]) == 32
    for wrong in (lambda: cp.read_metadata(str(tmp_path / "m.json"), "other"), lambda: cp.model_width("other")):
        with pytest.raises(CheckpointLoadError):
            wrong()


def test_sessions_and_gestures(spark, tmp_path):
    from tidewave.sources import sessions

    for p in ("Study-1/sub1_samsung_left/audio001", "Study-1/sub2_xiaomi_right/audio003", "Study-4/sub1/normal/audio002", "Study-1/junk/x"):
        f = tmp_path / f"{p}_fmcw_16bit_profiles.npy"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"x")
    got = [r["identity"] for r in sessions.scan(spark, str(tmp_path)).collect()]
    assert got == ["study1/p01/samsung/left/none/s000", "study1/p02/xiaomi/right/none/s002", "study4/p01/unknown-device/unknown-hand/normal/s001"]
    lines = spark.createDataFrame([("3, 0.5,1.5, wave, slowly ",), ("",)], "value string")
    assert [tuple(r) for r in sessions.gestures(lines).collect()] == [(3, 0.5, 1.5, "wave, slowly")]


def test_as_of_takes_equal_times_and_drops_early_probes(spark):
    p = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("a", 0.5, 3)], "k string, t double, i int")
    v = spark.createDataFrame([("a", 1.0, 10), ("a", 1.5, 11)], "k string, t double, v int")
    assert {(r["i"], r["v"]) for r in fr.as_of(p, v, ["k"], "t", "v").collect()} == {(1, 10), (2, 11)}


def test_descriptor_mismatch():
    from tidewave.errors import PreprocessingMismatchError

    with pytest.raises(PreprocessingMismatchError, match="crop_bins"):
        Descriptor().require_match(Descriptor(crop_bins=10))


def test_bundle(tmp_path):
    from tidewave.errors import CheckpointLoadError
    from tidewave.plans import checkpoint as cp

    (tmp_path / "w.bin").write_bytes(b"weights")
    n = cp.Normalizer((0.0, 1.0), (1.0, 2.0))
    cp.write_bundle(str(tmp_path / "b.json"), str(tmp_path / "w.bin"), Descriptor(), "pose", n, n)
    assert cp.read_bundle(str(tmp_path / "b.json"), Descriptor())["features"] == n
    with pytest.raises(CheckpointLoadError):
        cp.read_bundle(str(tmp_path / "b.json"), Descriptor(crop_bins=5))
    (tmp_path / "w.bin").write_bytes(b"other")
    with pytest.raises(CheckpointLoadError):
        cp.read_bundle(str(tmp_path / "b.json"), Descriptor())


def test_stream_equals_batch(spark, tmp_path):
    """The stateful synchroniser over files gives the frames of the batch form."""
    from tidewave.model import Chirp
    from tidewave.streaming import live

    packets = live.chirp_packets(spark, spark.createDataFrame([(1,), (2,)], "user_id long"), 6)
    packets.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {(r["stream_id"], r["frame_no"]): r["timestamp_s"] for r in live.aligned_frames(packets, Chirp()).collect()}
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = live.synchronise_stream(spark.readStream.schema(packets.schema).parquet(str(tmp_path / "in")), Chirp())
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["stream_id"], r["frame_no"]): r["timestamp_s"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == batch and len(got) == 12


def test_pool_refusals_and_shuffled_tail(spark, sf):
    s = registry.samples(spark, sf)
    users = poses.folds(s, Split.CROSS_USER)
    with pytest.raises(ValueError):
        poses.require_pool(poses.calibration(s, users, [1.0], 6.0), users, [1.0])
    folded = poses.folds(s, Split.WITHIN_SESSION)
    with pytest.raises(LeakageError):
        poses.require_pool(folded.withColumn("participant", F.lit("x")), folded, [1.0])
    other = poses.folds(s, Split.WITHIN_SESSION, contiguous=False)
    assert other.groupBy("role").count().collect() and other.exceptAll(folded).count() > 0
    poses.require_no_leakage(other, s, Split.WITHIN_SESSION)


def errors_of(spark, levels, per=50):
    return spark.createDataFrame([(f"P{i:02d}/S0", float(x)) for i, x in enumerate(levels) for _ in range(per)], "cluster string, error double")


def test_evaluation_size_counts_printed_decimals(spark):
    """Twelve people 3 mm apart do not support two decimals; people 0.002 mm apart do; one cluster fails, and does not raise."""
    wide = poses.evaluation_size(errors_of(spark, 12 + 3 * np.random.default_rng(11).standard_normal(12)), "cluster", 5).first()
    assert wide["clusters"] == 12 and wide["decimals"] < 2 and not wide["passed"]
    fine = errors_of(spark, 12 + 0.002 * np.random.default_rng(5).standard_normal(20))
    assert poses.evaluation_size(fine, "cluster", 5).first()["passed"]
    assert not poses.evaluation_size(fine, "cluster", 5, reported_decimals=4).first()["passed"]
    assert poses.evaluation_size(errors_of(spark, [9.0] * 10), "cluster", 5).first()["passed"]
    one = poses.evaluation_size(errors_of(spark, [9.0]), "cluster", 1).first()
    assert one["clusters"] == 1 and one["sem"] is None and not one["passed"]


def test_protocols_of_another_split_are_refused(spark):
    s = people(spark, n=3, per=2)
    wrong = replace(P, split=Split.WITHIN_SESSION)
    for run in (lambda: suite.cross_user(s, wrong, "x", suite.fold_means), lambda: suite.measure(s, Split.CROSS_USER, wrong, "x", suite.fold_means)):
        with pytest.raises(ExperimentError, match="declares WITHIN_SESSION"):
            run()
    family = suite.Family.of(s, Split.CROSS_USER)
    with pytest.raises(ExperimentError, match="declares WITHIN_SESSION"):
        run_guards(family, perfect(None, family.test()).withColumn("fold", F.lit("p00")), wrong)


def test_guards_are_bound_to_rows(spark):
    """Counts by hand; the same rows give the same fingerprint however they are dealt, other rows or folds another."""
    s = people(spark, n=4, per=3)
    for split, train in ((Split.CROSS_USER, 3 * 24), (Split.CROSS_SESSION, 24)):
        family = suite.Family.of(s, split)
        a, b, mark = family.identity()
        assert (a, b) == (train, 24)
        assert suite.Family.of(s.repartition(7), split).identity() == (a, b, mark)
        built = suite.Family.of(s, split, lambda x, split=split: poses.folds(x, split)).identity()
        assert built[:2] == (a, b)
        assert suite.Family.of(s.where("sample_id <> 3"), split).identity()[2] != mark
        assert suite.Family.of(s.withColumn("device", F.concat("device", F.lit("x"))), split).identity()[2] != mark
    report = suite.cross_user(s, P, "good", perfect).report
    bound = report.guards.binding
    assert (bound.n_train, bound.n_test) == (72, 24) and len(bound.fingerprint) == 64 and bound.fingerprint[:12] in report.text()
    assert bound.disagreement(replace(P, dataset_version="9")) and "version" in bound.disagreement(replace(P, dataset_version="9"))
    with pytest.raises(ExperimentError):
        Binding(Split.CROSS_USER, "d", "1", 0, 3, "f")


def test_whole_windows_are_normalised_once(spark):
    """Windows of 2 x 60 x 96 values: linear in the values, so that 400 rows of 11,520 take seconds."""
    rows = spark.range(400).select("id", F.transform(F.sequence(F.lit(0), F.lit(2 * 60 * 96 - 1)), lambda i: F.sin(i + F.col("id"))).alias("x")).cache()
    rows.count()
    began = time.perf_counter()
    for kind, of in ((Normalisation.PEAK, lambda v: np.abs(v).max()), (Normalisation.L2, np.linalg.norm)):
        got = rows.where("id < 3").select("x", fr.normalise(F.col("x"), kind).alias("y")).collect()
        assert all(np.allclose(np.array(r["x"]) / of(np.array(r["x"])), r["y"]) for r in got)
        rows.select(fr.normalise(F.col("x"), kind).alias("y")).selectExpr("sum(y[7])").collect()
    assert time.perf_counter() - began < 60
    odd = spark.createDataFrame([([0.0, 0.0],), ([float("inf"), 1.0],), ([],), (None,), ([2.0, -4.0],)], "x array<double>").select(fr.normalise(F.col("x"), Normalisation.PEAK).alias("y")).collect()
    assert [r["y"] for r in odd] == [[0.0, 0.0], [float("inf"), 1.0], [], None, [0.5, -1.0]]


def grow_tree(root, sessions, frames=24, bad=()):
    """Sessions of several people and studies with all their files; sessions in ``bad`` have their direct path elsewhere."""
    import json

    r = np.random.default_rng(1)
    names = {}
    for k in range(sessions):
        at = root / ("Study-1/sub%d_%s_left" % (k // 2 + 1, ("samsung", "xiaomi")[k // 2 % 2]) if k % 4 < 2 else "Study-4/sub%d/normal" % (k // 2 + 1))
        at.mkdir(parents=True, exist_ok=True)
        stem = f"audio{k % 2 + 1:03d}"
        x = r.normal(0, 0.1, (600, frames)).astype(np.float32)
        x[9 if k in bad else 3] += 40
        np.save(at / f"{stem}_fmcw_16bit_profiles.npy", x)
        np.save(at / f"{stem}_fmcw_16bit_diff_profiles.npy", np.diff(x, axis=1)[:, 1:])
        np.save(at / f"{stem}_landmarks.npy", r.normal(0, 1, (6, 21, 3)).astype(np.float32))
        (at / "config.json").write_text(json.dumps({"audio": {"config": {"sampling_rate": 48000, "frame_length": 600}, "files": ["a", "b"], "syncing_poses": [0, 600]}, "ground_truth": {"files": ["s0_records.txt", "s1_records.txt"], "syncing_poses": [0.05, 0.0]}}))
        for i in range(2):
            (at / f"s{i}_records.txt").write_text("0,0.0,0.1,a\n")
            (at / f"s{i}_frame_time.txt").write_text("".join(f"{0.05 * j},x\n\n" for j in range(6)))
        names[str(at.relative_to(root)), k % 2] = x
    return names


def jobs(spark, name, run):
    """What ``run`` gives and how many jobs it took."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_corpus_of_many_sessions_is_one_plan(spark, tmp_path):
    """Windows, labels and metadata by hand; the number of jobs does not follow the number of sessions."""
    from tidewave.sources.corpus import FRAME, RATE, Corpus

    d = Descriptor(crop_bins=20, window_frames=4, bin_zero_offset=3)
    took = {}
    for n in (8, 24):
        root = tmp_path / str(n)
        arrays = grow_tree(root, n)
        kept = integrity.manifest(integrity.tree(spark, str(root))).cache()
        kept.count()
        corpus = Corpus(spark, str(root), kept, d)
        got, took[n] = jobs(spark, f"corpus-{n}", lambda c=corpus: c.examples(stride=3).collect())
        assert len({r["session"] for r in got}) == n and len({r["sample_id"] for r in got}) == len(got)
    assert took[8] == took[24]
    by = {}
    known = {r["identity"]: r for r in corpus.catalogue().collect()}
    assert sorted(known) == [i for i, _ in sorted(((i, r["ordinal"]) for i, r in known.items()), key=lambda x: x[1])]
    for r in got:
        by.setdefault(r["session"], []).append(r)
    for identity, rows in by.items():
        k = known[identity]
        x = arrays[k["directory"], k["session_index"]]
        marks = np.load(k["landmarks"].removeprefix("file:")).reshape(6, 63)
        want = []
        for end in range(2 + 3, x.shape[1], 3):
            t = (end * FRAME - k["audio_sync"]) / RATE + k["gt_sync"]
            at = [j for j in range(6) if 0.05 * j <= t]
            if at:
                some = range(end - 3, end + 1)
                w = np.concatenate([*(x[3:23, i] for i in some), *(x[3:23, i] - x[3:23, i - 1] for i in some)])
                want.append((end, w / np.abs(w).max(), marks[at[-1]]))
        rows.sort(key=lambda r: r["frame_idx"])
        assert [r["frame_idx"] for r in rows] == [e for e, _, _ in want]
        assert all(np.allclose(r["window"], w, atol=1e-6) and np.allclose(r["joints"], m) for r, (_, w, m) in zip(rows, want, strict=True))
        assert {(r["participant"], r["device"]) for r in rows} == {(f"study{k['study']}/sub{k['participant']}", k["device"] or "unknown-device")}
    data = corpus.dataset(features=True, limit=5, stride=3).collect()
    assert [r["sample_id"] for r in data] == sorted(r["sample_id"] for r in got)[:5] and all(r["pose"][:3] == [0, 0, 0] and len(r["features"]) == 160 for r in data)
    # a corpus feeds the evaluation as it is
    assert suite.Family.of(corpus.dataset(stride=3), Split.CROSS_USER).units().count() == 12


def test_scans_of_sessions_are_pruned(spark, tmp_path):
    """Sessions are left out before anything is opened, and columns that are not asked for are not read."""
    from tidewave.sources.corpus import Corpus

    grow_tree(tmp_path, 8, frames=700)
    kept = integrity.manifest(integrity.tree(spark, str(tmp_path))).cache()
    corpus = Corpus(spark, str(tmp_path), kept, Descriptor(crop_bins=20, window_frames=4, bin_zero_offset=3))
    corpus.catalogue()
    every = corpus.frames()
    one = corpus.frames(study=[1], participant=[1, 3])
    assert one.count() == 4 * 700 and (one.rdd.getNumPartitions(), every.rdd.getNumPartitions()) == (4, 8)
    assert corpus.frames(study=[4], participant=[1]).count() == 0
    # one frame serves several queries
    assert every.where("study = 1").select("identity").union(every.where("study = 4").select("identity")).distinct().count() == 8 == every.select("identity").distinct().count()
    with pytest.raises(Exception, match="not chosen by"):
        corpus.frames(colour=["red"]).count()
    step = corpus._read("profiles", "identity string, frame_idx bigint")
    for f in tmp_path.rglob("*_diff_profiles.npy"):
        f.unlink()
    assert step.count() == 8 * 700 and corpus._read("profiles", "frame_idx bigint, samples array<float>").where("samples[3] > 30").count() == 8 * 700
    with pytest.raises(Exception, match="diff_profiles"):
        every.select(F.sum(F.size("diff"))).collect()
    ranges = spark.read.format("session_arrays").options(catalogue=corpus._catalogue, columns_per_partition=100).schema("identity string, frame_idx bigint").load()
    assert ranges.rdd.getNumPartitions() == 8 * 7 and ranges.distinct().count() == 8 * 700
    only = Corpus(spark, str(tmp_path), kept, Descriptor(), studies=[4], participants=[2])
    assert {(r["study"], r["participant"]) for r in only.catalogue().collect()} == {(4, 2)}


def test_sessions_with_faults_fail_or_are_left_out(spark, tmp_path):
    """Tampered, missing, unlisted and mismeasured sessions by name; the others are used when faults are skipped."""
    from tidewave.sources.corpus import Corpus

    grow_tree(tmp_path, 8, bad=(5,))
    kept = integrity.manifest(integrity.tree(spark, str(tmp_path))).cache()
    kept.count()
    d = Descriptor(crop_bins=20, window_frames=4, bin_zero_offset=3)
    with pytest.raises(Exception, match="bin zero is 9, not 3 in study1/p03"):
        Corpus(spark, str(tmp_path), kept, d).examples().collect()
    wrong = Corpus(spark, str(tmp_path), kept, d).measured().where("fault IS NOT NULL").collect()
    assert [(r["identity"][:10], r["offset"], r["lag"]) for r in wrong] == [("study1/p03", 9, 2)]
    at = tmp_path / "Study-1" / "sub1_samsung_left"
    changed = at / "audio001_fmcw_16bit_profiles.npy"
    data = bytearray(changed.read_bytes())
    data[-1] ^= 1
    changed.write_bytes(data)
    (at / "audio002_landmarks.npy").unlink()
    (tmp_path / "Study-4" / "sub2" / "normal" / "s0_frame_time.txt").write_text("9\n")
    missing = kept.where("path NOT LIKE 'Study-1/sub3%diff%' OR path NOT LIKE '%audio001%'")
    corpus = Corpus(spark, str(tmp_path), missing, d)
    faults = {r["identity"]: (r["fault"], r["times_fault"], r["landmarks_fault"]) for r in corpus.catalogue().collect()}
    said = [next(x for x in f if x) for _, f in sorted(faults.items()) if any(f)]
    assert len(said) == 4 and [any(k in s for s in said) for k in ("content changed", "landmarks missing", "not in the manifest", "times wrong size")] == [True] * 4
    with pytest.raises(Exception, match="content changed|not in the manifest"):
        corpus.frames().select(F.sum(F.col("samples")[0])).collect()
    left = Corpus(spark, str(tmp_path), missing.where("path NOT LIKE 'Study-1/sub3%'"), d).examples(faults="skip")
    assert {r["session"][:10] for r in left.select("session").distinct().collect()} == {"study4/p02", "study4/p04"}


def test_sidecars_are_read_back(spark, tmp_path):
    """Landmarks that are prepared beside a session are the ones that the corpus finds there."""
    from tidewave.errors import LandmarkPreparationError
    from tidewave.sources.corpus import Corpus, prepare_landmarks

    grow_tree(tmp_path, 2)
    at = tmp_path / "Study-1" / "sub1_samsung_left"
    (at / "audio001_landmarks.npy").unlink()
    video = spark.range(6).select(F.col("id").alias("frame_no")).repartition(4)
    seen = lambda v: v.select("frame_no", F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: (F.col("frame_no") * 100 + i).cast("double")).alias("joints"))
    back = prepare_landmarks(video, video, seen, str(at), {"detector": "x"})
    assert sorted((r["frame_no"], r["joints"][5]) for r in back.collect()) == [(i, 100.0 * i + 5) for i in range(6)]
    corpus = Corpus(spark, str(tmp_path), integrity.manifest(integrity.tree(spark, str(tmp_path))), Descriptor(crop_bins=20, window_frames=4, bin_zero_offset=3))
    assert sorted(r["joints"][7] for r in corpus.poses().where("identity LIKE '%s000'").collect()) == [100.0 * i + 7 for i in range(6)]
    with pytest.raises(LandmarkPreparationError, match="already"):
        prepare_landmarks(video, video, seen, str(at), {})


def ridge_rows():
    """A class of its own for workers, which do not import tests."""

    class RidgeRows(fitting.RowsFitter):
        """The ridge over rows, solved directly."""

        def fit_predict(self, train, test):
            table = lambda t, c: np.array(t[c].to_pylist(), float)
            x, y = table(train, "features"), table(train, "pose")
            x = np.hstack([x, np.ones((len(x), 1))])
            shrink = np.diag([1e-6 * len(x)] * (x.shape[1] - 1) + [0.0])
            w = np.linalg.solve(x.T @ x + shrink, x.T @ y)
            z = table(test, "features")
            return np.hstack([z, np.ones((len(z), 1))]) @ w

    return RidgeRows()


def guesses(frame):
    return {(r["fold"], r["sample_id"]): np.array(r["guess"]) for r in frame.collect()}


def test_fits_of_all_folds_are_one_plan(spark):
    """Sums, rows and a plan for each fold give the same guesses, in families by unit and by rows."""
    s = people(spark, n=5, per=4, noise=0.01)
    for split in (Split.CROSS_USER, Split.CROSS_SESSION, Split.WITHIN_SESSION):
        family = suite.Family.of(s, split)
        each = guesses(suite.predictions(family, "m", suite.fold_means, ())[0])
        sums = guesses(suite.predictions(family, "m", fitting.MeanFitter(), ())[0])
        assert each.keys() == sums.keys() and all(np.allclose(each[k], sums[k]) for k in each)
        by_rows, by_sums = guesses(ridge_rows().predictions(family)), guesses(fitting.RidgeFitter(5).predictions(family))
        assert by_rows.keys() == each.keys() == by_sums.keys() and all(np.allclose(by_rows[k], by_sums[k], atol=1e-5) for k in each)
    done = suite.measure(s, Split.CROSS_SESSION, replace(P, split=Split.CROSS_SESSION), "ridge", fitting.RidgeFitter(5))
    assert done.report.best("model").name == "ridge" and done.report.guards.binding.n_test == s.count()


def test_five_hundred_folds_have_the_plan_of_five(spark):
    size = {}
    for n in (5, 500):
        rows = [(i, f"P{i % n:03d}", "S0", "D0", float(i), [float(i % 7)] * 63, [float(i % 5)]) for i in range(2 * n)]
        s = spark.createDataFrame(rows, "sample_id long, participant string, session string, device string, ts double, pose array<double>, features array<double>")
        said, _ = suite.predictions(suite.Family.of(s, Split.CROSS_USER), "m", fitting.MeanFitter(), ())
        size[n] = len(said._jdf.queryExecution().optimizedPlan().toString().splitlines())
        got = guesses(said)
    assert size[5] == size[500] and len(got) == 1000
    total = sum(i % 7 for i in range(1000))
    assert all(abs(g[0] - (total - i % 7 - (i + 500) % 7 if i < 500 else total - i % 7 - (i - 500) % 7) / 998) < 1e-9 for (_, i), g in got.items())


def test_calibration_of_all_folds_and_budgets_is_one_plan(spark):
    from tidewave.plans import calibration

    s = people(spark, n=3, sessions=3, per=40).cache()
    test = s.where("session = 'S2'").select(F.col("participant").alias("fold"), "sample_id", F.lit("test").alias("role"))
    others = s.where("session = 'S0'").select("sample_id", F.col("participant").alias("p")).join(s.select(F.col("participant").alias("fold")).distinct(), F.col("fold") != F.col("p")).select("fold", "sample_id", F.lit("train").alias("role"))
    folded = test.unionByName(others)
    each = calibration.sweep(s, folded, suite.fold_means, P, 6.0)
    sums = calibration.sweep(s, folded, fitting.MeanFitter(), P, 6.0)
    assert [(p.requested, p.achieved, round(p.mpjpe.value, 9)) for p in each.points] == [(p.requested, p.achieved, round(p.mpjpe.value, 9)) for p in sums.points]
    taken = poses.calibration(s, folded, [0.0, 2.0], 6.0)
    a, b = ({(r["budget"], r["fold"], r["sample_id"]): np.array(r["guess"]) for r in f.calibrated(s, folded, taken, [0.0, 2.0]).collect()} for f in (ridge_rows(), fitting.RidgeFitter(5)))
    assert a.keys() == b.keys() and len(a) == 2 * 120 and all(np.allclose(a[k], b[k], atol=1e-5) for k in a)


def test_label_matches_among_many_people(spark):
    """One table of distances with a person's places deleted, against a median for each fold; names in two spellings."""
    from tidewave.operators import people as many

    draw = np.random.default_rng(3)
    for n in (1, 2, 3, 4, 41):
        names = [f"P{i:02d}" for i in range(n)]
        rows = [(i, names[i % n], f"S{i}", "D0", float(i), draw.normal(0, 1, 63).tolist()) for i in range(2 * n)]
        if n == 41:
            rows += [(1000 + i, f"p{i:02d} ", "S9", "D0", 1.0, draw.normal(0, 1, 63).tolist()) for i in (3, 7)]
            rows += [(2000 + i, f"Q{i}", "S9", "D0", 1.0, [0.5] * 63) for i in range(5)]
        s = poses.keyed(spark.createDataFrame(rows, "sample_id long, participant string, session string, device string, ts double, pose array<double>"))
        got = {r["fold"]: r for r in many.left_out_matches(s, block_rows=10).collect()}
        mean = {}
        for r in s.collect():
            mean.setdefault((r["who"], r["participant"]), []).append(np.array(r["pose"]))
        units = sorted({w for w, _ in mean})
        assert sorted(got) == units
        far = lambda a, b: np.sqrt(((a - b).reshape(21, 3) ** 2).sum(1)).mean()
        for u in units:
            test = np.mean([p for (w, _), some in mean.items() if w == u for p in some], axis=0)
            rest = sorted((name, np.mean(some, axis=0)) for (w, name), some in mean.items() if w != u)
            if not rest:
                assert got[u]["nearest"] is None and not got[u]["passed"]
                continue
            d = [far(test, m) for _, m in rest]
            pairs = [far(a, b) for i, (_, a) in enumerate(rest) for _, b in rest[i + 1 :]]
            assert got[u]["nearest"] == rest[int(np.argmin(d))][0] and abs(got[u]["distance"] - min(d)) < 1e-12
            assert (got[u]["typical"] is None) == (not pairs) and (not pairs or abs(got[u]["typical"] - np.median(pairs)) < 1e-12)
            assert got[u]["passed"] == bool(pairs and min(d) / np.median(pairs) > 0.2)


def test_digests_are_trees_that_follow_the_rows(spark, monkeypatch):
    """Levels by hand for keys of very different sizes, in any partitioning; one changed row changes its key's digest alone."""
    import hashlib

    from tidewave.operators import merkle

    monkeypatch.setattr(merkle, "LEAF", 2)
    monkeypatch.setattr(merkle, "DIGITS", 1)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()

    def tree(hashes, deep, path=""):
        if len(path) == deep:
            return sha("".join(sorted(hashes)))
        return sha("".join(sorted(path + c + tree([h for h in hashes if h[len(path)] == c], deep, path + c) for c in sorted({h[len(path)] for h in hashes}))))

    rows = [(k, sha(f"{k}{i}")) for k, n in (("a", 1), ("b", 2), ("c", 20), ("d", 700)) for i in range(n)]
    d = spark.createDataFrame(rows, "k string, h string")
    got = {r["k"]: (r["n"], r["x"]) for r in merkle.tree_digest(d, ["k"], "x").collect()}
    assert got == {k: (n, tree([h for j, h in rows if j == k], deep)) for k, n, deep in (("a", 1, 0), ("b", 2, 0), ("c", 20, 1), ("d", 700, 3))}
    again = {r["k"]: (r["n"], r["x"]) for r in merkle.tree_digest(d.where("k IN ('c', 'd')").repartition(7, "h"), ["k"], "x").collect()}
    assert again == {k: got[k] for k in "cd"}
    changed = {r["k"]: r["x"] for r in merkle.tree_digest(d.withColumn("h", F.when(F.col("h") == rows[30][1], sha("other")).otherwise(F.col("h"))), ["k"], "x").collect()}
    assert changed["d"] != got["d"][1] and changed["c"] == got["c"][1]
    assert merkle.tree_digest(d.limit(0), ["k"], "x").count() == 0 and merkle.tree_digest(d.select("h"), [], "x").first()["n"] == 723
