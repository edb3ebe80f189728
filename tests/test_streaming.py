"""Packets from a log through the stateful capture to lines: restarts, replays, silence and refusals."""

import json
import socket
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.errors import SessionError, WireError
from tidewave.functions import dsp
from tidewave.model import Chirp, Descriptor
from tidewave.streaming import capture, live, packets, wire

C = Chirp()
D = Descriptor(crop_bins=20, window_frames=4)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def pcm(frames, seed=0, lead=137):
    """A moving echo beside the direct path, as 16-bit samples with a silent lead."""
    moving = 0.06 + 0.002 * np.arange(frames)
    x = dsp.simulate_recording(C, [(moving, 0.4), (np.zeros(frames), 1.0)], frames, 30.0, seed).ravel()
    return np.concatenate([np.zeros(lead, np.int16), np.round(x / np.abs(x).max() * 20000).astype(np.int16)])


def frames_of(x, start_s=0.0, chunk=701, rate=48000, declared=None):
    return [wire.encode(x[i : i + chunk], round((start_s + i / rate) * 1e9), declared or C.rate) for i in range(0, len(x), chunk)]


def log(folder, stream, frames, per_segment=8, host_s=1_700_000_000):
    """Logged as if they had arrived at the host, whose clock is another, as they were sent."""
    out = packets.PacketLog(str(folder), stream, per_segment)
    for f in frames:
        out.append(f, host_s * 10**9 + wire.decode(f)[1])
    out.flush()


@pytest.fixture
def store(spark):
    packets.register(spark)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def lines(frame):
    return frame.select(F.to_json(F.struct("stream_id", "kind", F.round("timestamp_s", 6).alias("t"), "window_no", F.transform("window", lambda v: F.round(v.cast("double"), 5)).alias("w"), "reason")).alias("value"))


def drain(spark, at, timeout_s=3.0, delay="1 second"):
    """Runs the capture over all that the log holds now."""
    stream = capture.capture_stream(spark.readStream.format("pcm_packets").load(str(at / "log")), D, delay, timeout_s)
    query = lines(stream).writeStream.format("once_lines").option("checkpointLocation", str(at / "checkpoint")).trigger(availableNow=True).start(str(at / "out"))
    query.awaitTermination()


def said(at):
    return [json.loads(x) for f in sorted((at / "out").glob("batch-*/*.jsonl")) for x in f.read_text().splitlines()]


def windows(rows):
    return sorted((r["stream_id"], r["window_no"], r["t"], r["w"]) for r in rows if r["kind"] == "window")


def test_a_log_is_read_in_parts_and_again(spark, tmp_path):
    packets.register(spark)
    x = pcm(20)
    log(tmp_path, "a", frames_of(x))
    log(tmp_path, "b", frames_of(x[:3000], 2.0), 3)
    log(tmp_path, "b", frames_of(x[:700], 9.0))
    (tmp_path / "b" / "_half").write_bytes(b"rest of a dead writer")
    rows = spark.read.format("pcm_packets").load(str(tmp_path))
    got = {}
    for r in rows.orderBy("stream_id", "seq").collect():
        got.setdefault(r["stream_id"], []).append((r["seq"], r["timestamp_ns"], r["samples"]))
    assert [s for s, _, _ in got["b"]] == list(range(6)) and np.array_equal(np.concatenate([x for _, _, x in got["a"]]), x)
    reader = packets.PacketStreamReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    assert end == {"a": len(got["a"]), "b": 6}
    some = [(b["stream_id"][i].as_py(), b["seq"][i].as_py()) for p in reader.partitions({"a": 5}, {"a": 11, "b": 2}) for b in reader.read(p) for i in range(b.num_rows)]
    assert some == [("a", i) for i in range(5, 11)] + [("b", 0), ("b", 1)] and reader.partitions(end, end) == []
    assert spark.read.format("pcm_packets").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(WireError):
        packets.PacketLog(str(tmp_path), "c").append(b"no frame")
    with pytest.raises(ValueError):
        packets.PacketLog(str(tmp_path), "../c")


def test_a_connection_is_recorded(tmp_path):
    """All frames up to a clean end; at a cut one the whole ones stay and the count is said."""
    sent = frames_of(pcm(10))
    for name, tail in (("clean", b""), ("cut", sent[0][:9])):
        ours, theirs = socket.socketpair()
        thread = threading.Thread(target=lambda c=theirs, t=tail: (c.sendall(b"".join(sent) + t), c.close()))
        thread.start()
        try:
            n = packets.record(ours, packets.PacketLog(str(tmp_path), name, 4))
        except SessionError as e:
            assert name == "cut"
            n = e.packets
        thread.join()
        assert n == len(sent) and packets.PacketLog(str(tmp_path), name).next == n


def test_state_between_chunks_is_whole():
    """A capture that is taken apart and put together after every packet gives what one that lives on gives."""
    whole, parts, state = capture.Capture(D), None, None
    wave = pcm(120)
    wave = np.concatenate([wave[: 90 * 600], wave[90 * 600 + 173 :]])
    for data in frames_of(wave):
        x, ns, rate = wire.decode(data)
        parts = capture.Capture(D, *state) if state else capture.Capture(D)
        a, b = whole.push(x, ns, rate), parts.push(x, ns, rate)
        assert [r[:3] for r in a] == [r[:3] for r in b] and all(np.array_equal(p[3], q[3]) for p, q in zip(a, b, strict=True))
        state = parts.counters(), parts.ring()
    assert whole.windows > 60 and whole.sync.frames >= 118


def test_jitter_is_no_gap_and_drift_is_a_rate():
    """A millisecond of jitter on each of 300 chunks locks once; 44.1 kHz declared as 48 shows in the rate, not as gaps."""
    wave, draw = np.tile(pcm(1, lead=0), 300), np.random.default_rng(11)
    sync = live.Synchronizer(C)
    for i in range(0, len(wave) - 1000, 1000):
        sync.push(wave[i : i + 1000], 0.005 + i / 48000 + draw.uniform(-1e-3, 1e-3), C.rate)
    assert sync.frames >= 296 and abs(sync.last_observed / 48000 - 1) < 0.01
    sync = live.Synchronizer(C)
    for i in range(0, len(wave), 700):
        sync.push(wave[i : i + 700], i / 44100, C.rate)
    assert sync.frames >= 299 and abs(sync.last_observed / 44100 - 1) < 0.001
    out = sync.push(wave[:6000], len(wave) / 44100 + 1.0, C.rate)
    assert not out[0][1] and all(c for _, c, _ in out[1:])


def test_a_restart_in_mid_stream_changes_nothing(store, tmp_path):
    """Two streams, stopped and started again between packets of a window: the same rows as in one batch."""
    spark = store
    for name, seed in (("a", 1), ("b", 2)):
        log(tmp_path / "log", name, frames_of(pcm(40, seed))[:13])
    drain(spark, tmp_path)
    first = windows(said(tmp_path))
    for name, seed in (("a", 1), ("b", 2)):
        log(tmp_path / "log", name, frames_of(pcm(40, seed))[13:])
    drain(spark, tmp_path)
    got = windows(said(tmp_path))
    batch = lines(capture.capture_batch(spark.read.format("pcm_packets").load(str(tmp_path / "log")), D))
    assert got == windows(json.loads(r["value"]) for r in batch.collect())
    assert 0 < len(first) < len(got) and {r[0] for r in got} == {"a", "b"}
    # by hand: frames, profiles, changes, windows
    x = pcm(40, 1).astype(float) / 32768
    lead = round((got[0][2] - 5 * C.duration) * C.rate)
    n = (len(x) - lead) // 600
    profiles = dsp.matched_filter(x[lead : lead + n * 600].reshape(n, 600), C)[:, :20].astype(np.float32)
    mine = [np.array(w) for s, _, _, w in got if s == "a"]
    for k, w in enumerate(mine):
        some = range(2 + k, 6 + k)
        want = np.concatenate([*(profiles[i] for i in some), *(profiles[i] - profiles[i - 1] for i in some)])
        assert np.allclose(w, want / np.abs(want).max(), atol=2e-5)
    assert abs(lead - 137) <= 2 and len(mine) == n - 5


def test_lines_appear_once_when_a_batch_runs_again(store, tmp_path):
    """The query dies after its lines were moved and before it noted so: the batch runs again, no line is there twice."""
    spark = store
    log(tmp_path / "log", "a", frames_of(pcm(30)))
    drain(spark, tmp_path)
    once = said(tmp_path)
    last = max((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    for f in (last, last.parent / f".{last.name}.crc"):
        f.unlink(missing_ok=True)
    drain(spark, tmp_path)
    assert said(tmp_path) == once and windows(once)
    assert list((tmp_path / "out" / "_pending").iterdir()) == []
    writer = packets.LineWriter(str(tmp_path / "lost"))
    part = writer.write(iter([("x",), ("y",)]))
    writer.abort([part, None], 0)
    assert list((tmp_path / "lost" / "_pending").iterdir()) == [] and not (tmp_path / "lost" / "batch-000000000000").exists()


def test_silence_and_refusals_are_rows(store, tmp_path):
    """A stream that falls silent gives one row and no state; wrong rates and noise give one refusal each."""
    spark = store
    good, noise = pcm(40), np.round(np.random.default_rng(5).normal(0, 2000, 6 * 48000)).astype(np.int16)
    # clocks of devices have nothing to do with each other
    log(tmp_path / "log", "quiet", frames_of(good, 5000.0), host_s=1_700_000_000 - 5000)
    log(tmp_path / "log", "declared", frames_of(good, declared=44100))
    log(tmp_path / "log", "noise", frames_of(noise, chunk=4000), 100)
    log(tmp_path / "log", "slow", frames_of(np.tile(pcm(80, lead=0), 4), rate=44100))
    drain(spark, tmp_path)
    rows = said(tmp_path)
    assert {r["stream_id"]: r["reason"].split(" ")[0] for r in rows if r["kind"] == "refused"} == {"declared": "rate", "noise": "unlocked", "slow": "observed"}
    assert len([r for r in rows if r["kind"] == "refused"]) == 3
    # another stream goes on, so that event time passes the others' ends; noise lasted six seconds
    log(tmp_path / "log", "later", frames_of(good, 20.0))
    drain(spark, tmp_path)
    log(tmp_path / "log", "later", frames_of(good, 21.0))
    drain(spark, tmp_path)
    silent = [r for r in said(tmp_path) if r["kind"] == "silent"]
    assert sorted(r["stream_id"] for r in silent) == ["declared", "noise", "quiet", "slow"]
    left = {v: spark.read.format("statestore").option("stateVarName", v).load(str(tmp_path / "checkpoint")).select("key.*").distinct().collect() for v in ("counters", "heard")}
    assert all([r[0] for r in rows] == ["later"] for rows in left.values())


def test_the_synchroniser_alone_keeps_typed_state(store, tmp_path):
    spark = store
    log(tmp_path / "log", "a", frames_of(pcm(30))[:9])
    run = lambda: live.synchronise_stream(spark.readStream.format("pcm_packets").load(str(tmp_path / "log")), C).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    run()
    log(tmp_path / "log", "a", frames_of(pcm(30))[9:])
    run()
    got = [(r["frame_no"], r["continuous"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("frame_no").collect()]
    assert got == [(i, i > 0) for i in range(len(got))] and len(got) >= 29


def test_windows_of_a_stream_do_not_depend_on_blocks(spark, sf):
    """Breaks, times that stand still and missing numbers, against the assembler over each whole stream."""
    draw = np.random.default_rng(3)
    rows = []
    for stream, n in (("a", 90), ("b", 3), ("c", 41)):
        numbers = np.sort(draw.choice(3 * n, n, replace=False)).tolist()
        rows += [(stream, no, float(no - 4 * (k % 17 == 9)), bool(k % 23 != 20), draw.normal(size=5).tolist()) for k, no in enumerate(numbers)]
    want = {}
    for stream in "abc":
        a = live.Assembler(3)
        want |= {(s, no): w.tolist() for s, no, t, c, x in rows if s == stream and (w := a.push(np.array(x, np.float32), t, c)) is not None}
    f = spark.createDataFrame(rows, "stream_id string, frame_no long, timestamp_s double, continuous boolean, samples array<float>")
    for block in (1, 2, 7, 50, 4096):
        got = live.assembled_windows(f, 3, block).collect()
        assert len(got) == len(want) and {(r["stream_id"], r["frame_no"]): r["window"] for r in got} == want
    assert live.assembled_windows(f.limit(0), 3).count() == 0


def test_live_poses_take_the_recording_as_one_stream(spark, sf):
    """Each frame but the first eight, which have no whole window behind them."""
    from tidewave.registry import QUERIES

    frames = sorted(r["frame_id"] for r in QUERIES["segment_frames"](spark, sf).collect())
    assert sorted(r["frame_no"] for r in QUERIES["live_poses"](spark, sf).collect()) == frames[8:]
