import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.errors import CaptureProcessingError, LiveCaptureError, ResonanceFitError, TruncatedFrameError, WireError
from tidewave.functions import clap, dsp
from tidewave.model import Chirp
from tidewave.operators import frames as fr
from tidewave.streaming import live, wire

C = Chirp()


@pytest.mark.parametrize("at", [0.05, 0.11, 0.18, 0.31])
def test_a_reflector_is_found_within_a_fifth_of_a_bin(at):
    profile = dsp.matched_filter(dsp.simulate(C, np.array([at]), np.array([0.7]))[None], C)[0]
    best = dsp.peaks(profile, C.bin_metres)[0]
    assert abs(best["range_m"] - at) < 0.2 * C.bin_metres
    # the part of an echo that wraps past the frame's end is lost to lags from 0 on
    whole = 1 - 2 * at / (343.0 * C.duration)
    assert whole - 0.02 < best["amplitude"] / 0.7 < 1.05


def test_reflectors_apart_are_told_apart():
    ranges = np.array([0.06, 0.2, 0.36])
    profile = dsp.matched_filter(dsp.simulate(C, ranges, np.array([1.0, 0.7, 0.5]))[None], C)[0]
    found = sorted(p["range_m"] for p in dsp.peaks(profile, C.bin_metres) if p["range_m"] < 0.5)
    assert len(found) == 3 and np.abs(np.array(found) - ranges).max() < 3 * C.bin_metres


def test_matched_filter_equals_direct_sum():
    r = np.random.default_rng(0)
    x, ref = r.standard_normal(64), r.standard_normal(8)
    direct = [sum(x[k + i] * ref[i] for i in range(8) if k + i < 64) / (ref**2).sum() for k in range(64)]
    assert np.allclose(dsp.correlate(x, ref).real, direct)


def test_noise_gives_few_peaks_and_silence_none():
    r = np.random.default_rng(1)
    noise = dsp.matched_filter(r.standard_normal((100, 600)), C)
    assert sum(bool(dsp.peaks(x, C.bin_metres)) for x in noise) <= 20
    assert dsp.peaks(np.zeros(600), 1.0) == []


def test_plateau_and_ends():
    assert dsp.local_maxima(np.array([0, 1, 1, 1, 0, 2, 0])) == [2, 5]
    assert dsp.prominence(np.array([0, 3, 1, 2, 0.0]), 3) == 1


@pytest.mark.parametrize("chunk", [103, 701, 985])
def test_synchroniser_finds_frames_behind_a_lead(chunk):
    wave = np.concatenate([np.zeros(137), np.tile(dsp.reference(C), 8)])
    sync, out = live.Synchronizer(C), []
    for i in range(0, len(wave), chunk):
        out += sync.push(wave[i : i + chunk], i / C.rate, C.rate)
    assert len(out) == 8
    assert all(np.allclose(f, dsp.reference(C), atol=1e-6) for _, _, f in out)
    assert abs(out[0][0] - 137 / C.rate) < 1e-9 and not out[0][1] and all(c for _, c, _ in out[1:])


def test_synchroniser_restarts_at_a_gap_and_corrects_a_drop():
    sync = live.Synchronizer(C)
    wave = np.tile(dsp.reference(C), 10)
    a = sync.push(wave, 0.0, C.rate)
    b = sync.push(wave, 5.0, C.rate)
    assert len(a) == len(b) == 10 and not b[0][1]
    sync = live.Synchronizer(C)
    wave = np.tile(dsp.reference(C), 300)
    wave = np.concatenate([wave[: 100 * 600], wave[100 * 600 + 173 :]])
    out = sync.push(wave, 0.0, C.rate)
    assert sum(not c for _, c, _ in out) >= 2 and np.allclose(out[-1][2], dsp.reference(C), atol=1e-6)


def test_white_noise_never_locks():
    sync = live.Synchronizer(C)
    assert sync.push(np.random.default_rng(0).standard_normal(6000), 0.0, C.rate) == [] and not sync.locked
    guard = live.LiveGuard(C)
    guard.check(sync, C.rate, 0.0)
    with pytest.raises(LiveCaptureError):
        guard.check(sync, C.rate, 4.0)


def test_assembler_drops_what_breaks():
    a = live.Assembler(3)
    x = np.ones(4, np.float32)
    assert [a.push(x * i, float(i), True) is not None for i in range(5)] == [False, False, False, True, True]
    assert a.push(x, 9.0, False) is None and a.push(x, 10.0, True) is None
    # a time that does not grow breaks too, and so does a mark on the very first frame
    assert [a.push(x, t, True) is not None for t in (11.0, 12.0, 13.0, 13.0, 14.0, 15.0, 16.0, 17.0)] == [False, False, True, False, False, False, False, True]
    b = live.Assembler(1)
    assert [b.push(x * i, float(i), i > 0) is not None for i in range(4)] == [False, False, True, True]
    with pytest.raises(CaptureProcessingError):
        a.push(x * np.nan, 20.0, True)


def test_wire_round_trip_and_refusals():
    data = wire.encode(np.array([1, -2, 3], np.int16), 5, 48000)
    x, ns, rate = wire.decode(data)
    assert x.tolist() == [1, -2, 3] and (ns, rate) == (5, 48000)
    for bad in (data[:-1], b"XXXX" + data[4:], data + b"0"):
        with pytest.raises(WireError):
            wire.decode(bad)

    class Conn:
        def __init__(self, b):
            self.b = b

        def recv(self, n):
            out, self.b = self.b[:n], self.b[n:]
            return out

    assert wire.receive(Conn(b"")) is None
    with pytest.raises(TruncatedFrameError):
        wire.receive(Conn(data[:10]))


def test_claps_are_detected_and_fitted():
    rate, f, bw = 48000, 1010.0, 210.0
    n = np.arange(int(0.06 * rate))
    one = np.exp(-np.pi * bw * n / rate) * np.sin(2 * np.pi * f * n / rate)
    x = np.random.default_rng(0).normal(0, 1e-4, 3 * rate)
    for at in (rate, 3 * rate // 2, 2 * rate):
        x[at : at + len(one)] += one
    events = clap.detect(x, rate)
    assert len(events) == 3
    fit = clap.resonance(np.array(events[0]["window"]), rate)
    assert abs(fit["centre_frequency_hz"] / f - 1) < 0.03 and abs(fit["bandwidth_hz"] / bw - 1) < 0.3
    with pytest.raises(ResonanceFitError):
        clap.resonance(np.zeros(100), rate)


def test_columns_equal_the_kernels(spark):
    """The sweep and its echoes as expressions against numpy."""
    from pyspark.sql import functions as F

    t = np.arange(-5, 650) / C.rate
    got = [r["v"] for r in spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "i int, t double").orderBy("i").select(dsp.chirp_column(F.col("t"), C).alias("v")).collect()]
    assert np.allclose(got, dsp.chirp_at(t, C), atol=1e-9)
    scene = spark.createDataFrame([([(0.05, 1.0), (0.3, -0.5)],)], "r array<struct<range_m:double,amplitude:double>>")
    frame = scene.select(dsp.echoes_column(F.col("r"), C).alias("x")).first()["x"]
    assert np.allclose(frame, dsp.simulate(C, np.array([0.05, 0.3]), np.array([1.0, -0.5])), atol=1e-9)


def test_peaks_by_definition():
    """Local maxima and prominence against loops that say what they are."""
    r = np.random.default_rng(0)
    for _ in range(300):
        x = r.integers(0, 5, r.integers(0, 25)).astype(float)
        want = []
        for i in range(len(x)):
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if i and x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
                want.append((i + j) // 2)
        assert dsp.local_maxima(x) == want
        for at in want:
            lows = []
            for side in (x[:at][::-1], x[at + 1 :]):
                low = x[at]
                for v in side:
                    if v > x[at]:
                        break
                    low = min(low, v)
                lows.append(low)
            assert dsp.prominence(x, at) == x[at] - max(lows)


def test_peak_list_equals_the_kernel(spark, sf):
    from tidewave import registry

    frames = {r["frame_id"]: np.array(r["samples"]) for r in registry.framed(spark, sf).collect()}
    got = {}
    for r in registry.QUERIES["peak_list"](spark, sf).collect():
        got.setdefault(r["frame_id"], []).append(r["bin_index"])
    for i, x in frames.items():
        floor = np.median([np.quantile(np.abs(b), 0.1) for b in np.array_split(x, max(1, len(x) // 96))]) * np.sqrt(2 * np.log(2)) / np.sqrt(-2 * np.log(0.9))
        padded = np.concatenate([[0.0], x, [0.0]])
        want = [k - 1 for k in dsp.local_maxima(padded) if padded[k] >= 4 * floor and dsp.prominence(padded, k) >= 0.3 * x.max()]
        assert sorted(got.get(i, [])) == sorted(want)


def test_procrustes_errors_equal_numpy(spark, sf):
    """The query's numbers from singular value decompositions one by one."""
    from tidewave import registry

    rows = registry.samples(spark, sf).select("participant", "pose").collect()
    want = {}
    for r in rows:
        t = np.array(r["pose"]).reshape(21, 3)
        p = np.mean([x["pose"] for x in rows if x["participant"] != r["participant"]], axis=0).reshape(21, 3)
        a, b = p - p.mean(0), t - t.mean(0)
        u, s, vt = np.linalg.svd(b.T @ a)
        d = np.array([1, 1, np.sign(np.linalg.det(u @ vt))])
        fit = (s * d).sum() / (a * a).sum() * a @ (u * d @ vt).T + t.mean(0)
        want.setdefault(r["participant"], []).append(1000 * np.linalg.norm(fit - t, axis=1).mean())
    got = {r["fold"]: r["pa_mpjpe"] for r in registry.QUERIES["pa_mpjpe"](spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - np.mean(v)) < 1e-3 for k, v in want.items())


def test_pole_filter_equals_its_recursion():
    x = np.random.default_rng(0).normal(0, 1, 200)
    f, bw, rate = 900.0, 120.0, 8000
    n = np.arange(200)
    y = np.exp(-np.pi * bw * n / rate) * np.cos(2 * np.pi * f * n / rate + 0.3)
    b, a = clap.fit_poles(y)
    assert np.allclose(np.sort(np.abs(np.roots(a))), np.exp(-np.pi * bw / rate), rtol=1e-3)
    assert np.allclose(np.abs(np.angle(np.roots(a))), 2 * np.pi * f / rate, rtol=1e-3) and len(x) == 200


def test_capture_to_poses():
    """Packets of a moving echo through synchroniser, profiles, windows and a predictor, with an injected clock."""
    from tidewave.errors import InferenceError
    from tidewave.model import Descriptor

    d = Descriptor(crop_bins=20, window_frames=4, differential_lag=2)
    wave = np.round(np.tile(dsp.reference(C), 14) * 20000).astype(np.int16)
    for predictor, kind in ((None, "capture"), (lambda x: np.ones((len(x), 63)), "pose")):
        said = []
        p = live.Pipeline(predictor, "m", d, said.append, clock=lambda: 123.0)
        for i in range(0, len(wave), 701):
            p.packet(wave[i : i + 701], round(i / C.rate * 1e9), C.rate)
        assert len(said) == 14 - 2 - 3 and all(r["type"] == kind for r in said)
        if kind == "pose":
            assert said[0]["timestamp_s"] == 123.0 and said[0]["joints"] == [[0.0] * 3] * 21
        else:
            assert said[0]["shape"] == [2, 20, 4] and len(said[0]["features"]) == 160
            assert wire.require_capture(__import__("json").dumps(said[0]))["version"] == 1
    p = live.Pipeline(lambda x: np.full((len(x), 63), np.nan), "m", d, said.append)
    with pytest.raises(InferenceError):
        p.packet(wave, 0, C.rate)


def test_duplex_health():
    h = live.DuplexHealth()
    for i in range(5):
        h.push(600, i * 12_500_000, 48000)
    assert h.status()["continuous"] and h.worst_s < 1e-9
    h.push(600, 5 * 12_500_000 + 50_000_000, 48000)
    assert h.breaks == 1
    h.push(100, 6 * 12_500_000 + 50_000_000, 48000)
    for n, rate in ((600, 48000), (100, 44100)):
        with pytest.raises(LiveCaptureError):
            h.push(n, 0, rate)


def test_lines_and_refusals(tmp_path):
    from tidewave.errors import ClassMergeError, ModelUnavailableError, WireFormatError
    from tidewave.__main__ import load_predictor, port

    for bad in ("no json", "[]", '{"type":"pose","version":1,"shape":[1,1,1],"features":[0]}', '{"type":"capture","version":1,"shape":[2,1,1],"features":[0]}'):
        with pytest.raises(WireFormatError):
            wire.require_capture(bad)
    with open(tmp_path / "x", "w") as f:
        wire.LineSink(f).emit({"a": 1, "b": [2]})
        assert (tmp_path / "x").read_text() == '{"a":1,"b":[2]}\n'
    with pytest.raises(ClassMergeError):
        clap.expand_class("flat")
    with pytest.raises(ModelUnavailableError):
        load_predictor("no_such_module:f", None)
    with pytest.raises(Exception):
        port("0")
    assert load_predictor("math:sqrt", None)(4) == 2 and load_predictor(None, None) is None


@pytest.mark.parametrize("lag, offset", [(1, 0), (2, 0), (2, 4)])
def test_live_and_stored_windows_are_the_same(spark, lag, offset):
    """A moving and two static reflectors: windows of the live way, of the batch plan over stored arrays, and by hand.

    Stored differences are changes from frame to frame without the first ``lag - 1``, so the live way has ``lag - 1``
    windows more, at the start, and the rest are equal.
    """
    from tidewave.model import Descriptor

    n, bins, length = 14, 60, 4
    moving = 0.06 + 0.004 * np.arange(n)
    frames = dsp.simulate_recording(C, [(moving, 0.4), (np.zeros(n), 1.0), (np.full(n, 0.02), 0.3)], n, 25.0, 3)
    d = Descriptor(crop_bins=bins, window_frames=length, bin_zero_offset=offset, differential_lag=lag)
    live_way = live.Processor(d)
    got = {i: w for i, f in enumerate(frames) if (w := live_way.push(f, i / 80, True)) is not None}
    profiles = dsp.matched_filter(frames, C)[:, offset : offset + bins]
    assert sorted(got) == list(range(length, n))
    for end, w in got.items():
        some = range(end - length + 1, end + 1)
        want = np.concatenate([*(profiles[i] for i in some), *(profiles[i] - profiles[i - 1] for i in some)])
        assert np.allclose(w, want / np.abs(want).max(), atol=1e-6)
    stored = np.diff(profiles, axis=0)[lag - 1 :]
    rows = spark.createDataFrame([("a", i, profiles[i].tolist(), stored[i - lag].tolist() if i >= lag else None) for i in range(n)], "k string, i long, samples array<double>, diff array<double>")
    batch = {r["i"]: r["window"] for r in fr.causal_windows(rows, ["k"], "i", length, 1, lag, diff="diff").collect()}
    assert sorted(batch) == sorted(got)[lag - 1 :]
    assert all(np.allclose(got[i], w, atol=1e-6) for i, w in batch.items())


def test_preparation_of_many_recordings(spark):
    """Bin zero and lag of recordings at once, against loops; lags that fit nowhere, twice or on silence are null."""
    draw = np.random.default_rng(4)
    rows, want = [], {}
    for k, (zero, lag, kind) in enumerate([(3, 1, "own"), (0, 2, "own"), (7, 3, "own"), (2, 4, "own"), (5, 2, "noise"), (5, 2, "silent"), (1, 2, "ramp")]):
        x = draw.normal(0, 0.1, (30, 45))
        x[:, zero] += 20
        if kind == "ramp":
            x = np.arange(30)[:, None] * np.ones(45) + 0.0
            x[:, zero] += 50
        stored = {"own": np.diff(x, axis=0)[lag - 1 :], "ramp": np.diff(x, axis=0)[lag - 1 :], "noise": draw.normal(0, 1, (28, 45)), "silent": np.zeros((28, 45))}[kind]
        for declared in (1, 2):
            key = f"{k}-{declared}"
            want[key] = (zero, lag if kind == "own" else None)
            rows += [(key, i, declared, x[i].tolist(), stored[i - declared].tolist() if 0 <= i - declared < len(stored) else None) for i in range(30)]
    table = spark.createDataFrame(rows, "k string, i long, declared int, samples array<double>, diff array<double>")
    for declared in (1, 2):
        got = {r["k"]: (r["offset"], r["lag"]) for r in fr.preparation(table.where(F.col("declared") == declared), ["k"], "i", declared).collect()}
        assert got == {k: v for k, v in want.items() if k.endswith(str(declared))}


def test_peak_expressions_equal_the_kernel(spark):
    """Flat tops, negative values, several blocks, ends, silence and short rows."""
    draw = np.random.default_rng(8)
    rows = [[], [1.0], [2.0, 1.0], [0.0] * 5, [-1.0, -2.0, -3.0], [5.0] * 4]
    rows += [draw.integers(-2, 6, draw.integers(3, 30)).astype(float).tolist() for _ in range(150)]
    rows += [np.abs(draw.normal(0, 1, n)).tolist() for n in (95, 191, 192, 200, 600)]
    table = spark.createDataFrame(list(enumerate(rows)), "i int, x array<double>")
    got = {r["i"]: r["p"] for r in table.select("i", dsp.peaks_column(F.col("x"), 0.5, 0.25).alias("p")).collect()}
    floors = {r["i"]: r["f"] for r in table.select("i", dsp.floor_column(F.col("x")).alias("f")).collect()}
    for i, x in enumerate(rows):
        # amplitudes that are equal but for their last bits may stand in either order
        order = lambda some: sorted(some, key=lambda p: p["bin_index"])
        assert all(a["amplitude"] >= b["amplitude"] for a, b in zip(got[i], got[i][1:], strict=False))
        want, got[i] = order(dsp.peaks(np.array(x), 0.5, 0.25)), order(got[i])
        assert abs(floors[i] - dsp.floor_of(np.array(x))) < 1e-9
        assert [p["bin_index"] for p in got[i]] == [p["bin_index"] for p in want], x
        assert all(np.allclose([a[k] for k in ("range_m", "amplitude", "peak_to_noise")], [b[k] for k in ("range_m", "amplitude", "peak_to_noise")]) for a, b in zip(got[i], want, strict=True))
    assert table.where("i = 160").select(F.size(dsp.peaks_column(F.col("x"), 0.5, most=2)).alias("n")).first()["n"] <= 2


def test_similarity_fits_of_odd_poses(spark):
    """Against a singular value decomposition: turned, mirrored, flat, on a line (by their error), in one point."""
    from tidewave.operators import poses

    draw = np.random.default_rng(2)
    rows = []
    for k in range(60):
        p, t = draw.normal(0, 1, (21, 3)), draw.normal(0, 0.1, (21, 3)) + 5
        if k % 6 == 1:
            q, _ = np.linalg.qr(draw.normal(size=(3, 3)))
            t = 3 * p @ q + 1
        if k % 6 == 2:
            t = p * [1, 1, -1]
        if k % 6 == 3:
            p, t = p * [1, 1, 0], t * [1, 0, 1]
        if k % 6 == 4:
            p, t = np.outer(draw.normal(size=21), draw.normal(size=3)), np.outer(draw.normal(size=21), draw.normal(size=3))
        if k % 12 == 5:
            p = np.ones((21, 3))
        rows.append((k, p.ravel().tolist(), t.ravel().tolist()))
    got = {r["k"]: np.array(r["f"]).reshape(21, 3) for r in spark.createDataFrame(rows, "k int, p array<double>, t array<double>").select("k", poses.similarity_fit(F.col("p"), F.col("t")).alias("f")).collect()}
    for k, p, t in rows:
        p, t = np.array(p).reshape(21, 3), np.array(t).reshape(21, 3)
        a, b = p - p.mean(0), t - t.mean(0)
        u, s, vt = np.linalg.svd(b.T @ a)
        d = np.array([1, 1, np.sign(np.linalg.det(u @ vt))])
        size = (a * a).sum()
        fit = ((s * d).sum() / size if size > 0 else 0) * a @ (u * d @ vt).T + t.mean(0)
        if k % 6 == 4:
            assert abs(((fit - t) ** 2).sum() - ((got[k] - t) ** 2).sum()) < 1e-6
        else:
            assert np.allclose(got[k], fit, atol=1e-6), k % 6
    assert spark.range(1).select(poses.similarity_fit(F.lit(None).cast("array<double>"), F.array(F.lit(1.0))).alias("f")).first()["f"] is None
