"""Further queries: sessions and their records, wire and lines, cavities and classes, folds, guards and calibration.

The same stand-ins as in ``registry``: customers stand for session folders, events for records and packets, documents
for files, embeddings for poses.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions import clap, dsp
from tidewave.model import ARM_RANGE_DEG, CLAP_MODES, CONFUSABLE, IMPULSE_BITS, JOINTS, SPEED_OF_SOUND, Alignment, Chirp, Device, GroundTruth, GuardName, Hand, Normalisation, Phase, Protocol, Split, Study
from tidewave.operators import frames as fr
from tidewave.operators import integrity, poses
from tidewave.plans import suite
from tidewave.registry import BIN, FOLD_DEVICE, FOLD_SESSION, FOLD_TAIL, FOLD_USER, J, LEAVES, R, S, SK, TOP, TREE, framed, query, recording, rounded, samples, table
from tidewave.sources import corpus, sessions
from tidewave.streaming import live, wire

# Files


@query("SELECT count(*) AS files, sum(strlen(coalesce(text, '')))::BIGINT AS size_bytes FROM documents")
def manifest_totals(spark, d):
    docs = table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return integrity.totals(integrity.manifest(docs))


def _changed(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    kept = integrity.manifest(docs.where("doc_id % 11 <> 0").select("path", F.col("text").cast("binary").alias("content")))
    text = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).when((F.col("doc_id") % 17 == 0) & (F.col("text") != ""), F.concat(F.lit("x"), F.substring("text", 2, 2**31 - 1))).otherwise(F.col("text"))
    return kept, docs.where("doc_id % 7 <> 0").select("path", text.cast("binary").alias("content"))


STATUS = f"{TREE}, v AS (SELECT path, CASE WHEN t.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' WHEN strlen(t.text) <> size_bytes THEN 'wrong size' WHEN sha256(t.text) <> h THEN 'content changed' ELSE 'ok' END AS status FROM m FULL JOIN t USING (path))"


@query(f"WITH {STATUS}, o AS (SELECT status, path, row_number() OVER (PARTITION BY status ORDER BY path) AS k, count(*) OVER (PARTITION BY status) AS n FROM v WHERE status <> 'ok') SELECT status || ': ' || string_agg(path, ', ' ORDER BY path) || CASE WHEN n > 5 THEN ' (+' || (n - 5) || ' more)' ELSE '' END AS line FROM o WHERE k <= 5 GROUP BY status, n")
def manifest_described(spark, d):
    """What a verification says: a line for each status with its first five paths."""
    kept, files = _changed(spark, d)
    return spark.createDataFrame([(x,) for x in integrity.describe(integrity.verify(kept, files)).split("\n")], "line string")


@query(f"WITH {TREE} SELECT path, CASE WHEN m.path IS NULL THEN 'not in the manifest' WHEN strlen(t.text) <> size_bytes THEN 'wrong size' WHEN sha256(t.text) <> h THEN 'content changed' ELSE 'ok' END AS status FROM t LEFT JOIN m USING (path)")
def manifest_single_files(spark, d):
    return integrity.verify_files(*_changed(spark, d))


@query("WITH a AS (SELECT doc_id, 'x/' || doc_id || ['.TXT', '.npy', '.mp4', '', '.Json', '.tar.csv'][doc_id % 6 + 1] AS path FROM documents) SELECT path FROM a WHERE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) IN ('.npy', '.json', '.txt', '.csv')")
def manifest_suffix_filter(spark, d):
    ends = F.element_at(F.array(*map(F.lit, (".TXT", ".npy", ".mp4", "", ".Json", ".tar.csv"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return integrity.with_suffix(table(spark, d, "documents").select(F.concat(F.lit("x/"), F.col("doc_id").cast("string"), ends).alias("path")))


# Session trees


K = "k AS (SELECT c_custkey AS k, c_custkey % 4 + 1 AS study, c_custkey % 40 + 1 AS sub, ['samsung', 'xiaomi'][c_custkey % 2 + 1] AS device, ['left', 'right'][c_custkey % 3 // 2 + 1] AS hand, c_custkey % 20 + 1 AS n FROM customer)"
PATHS = K + ", p AS (SELECT *, CASE WHEN k % 17 = 0 THEN '/d/Study-' || study || '/junk/x_fmcw_16bit_profiles.npy' WHEN k % 19 = 0 THEN '/d/Study-' || study || '/sub' || sub || '_' || device || '_' || hand || '/audio' || lpad(n::VARCHAR, 3, '0') || '.png' WHEN study >= 3 THEN '/d/study_' || study || '/sub' || sub || '/normal/audio' || lpad(n::VARCHAR, 3, '0') || '_fmcw_16bit_profiles.npy' ELSE '/d/Study-' || study || '/sub' || sub || '_' || device || '_' || hand || '/audio' || lpad(n::VARCHAR, 3, '0') || '_fmcw_16bit_profiles.npy' END AS path FROM k)"


def session_files(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("k"), (k % 4 + 1).alias("study"), (k % 40 + 1).alias("sub"), F.when(k % 2 == 0, "samsung").otherwise("xiaomi").alias("device"), F.when(k % 3 == 2, "right").otherwise("left").alias("hand"), F.lpad((k % 20 + 1).cast("string"), 3, "0").alias("n"))
    end = F.lit(sessions.PROFILE_END)
    flat = F.concat(F.lit("/d/Study-"), "study", F.lit("/sub"), "sub", F.lit("_"), "device", F.lit("_"), "hand", F.lit("/audio"), "n")
    nested = F.concat(F.lit("/d/study_"), "study", F.lit("/sub"), "sub", F.lit("/normal/audio"), "n", end)
    junk = F.concat(F.lit("/d/Study-"), "study", F.lit("/junk/x"), end)
    return c.select("k", F.when(F.col("k") % 17 == 0, junk).when(F.col("k") % 19 == 0, F.concat(flat, F.lit(".png"))).when(F.col("study") >= 3, nested).otherwise(F.concat(flat, end)).alias("path"))


KNOWN = f"WITH {PATHS} SELECT path, 'study' || study || '/p' || lpad(sub::VARCHAR, 2, '0') || '/' || CASE WHEN study >= 3 THEN 'unknown-device/unknown-hand/normal' ELSE device || '/' || hand || '/none' END || '/s' || lpad((n - 1)::VARCHAR, 3, '0') AS identity, study::INT AS study, (n - 1)::INT AS session_index FROM p WHERE k % 17 <> 0 AND k % 19 <> 0"


@query(KNOWN)
def session_paths(spark, d):
    return sessions.parse_paths(session_files(spark, d)).select("path", "identity", "study", "session_index")


@query(f"{KNOWN} AND study IN (1, 4)")
def session_paths_of_studies(spark, d):
    return sessions.parse_paths(session_files(spark, d)).where(F.col("study").isin(int(Study.ONE), int(Study.FOUR))).select("path", "identity", "study", "session_index")


@query(f"WITH {PATHS}, x AS (SELECT path, replace(path, '_fmcw_16bit_profiles.npy', '') AS stem FROM p WHERE k % 17 <> 0 AND k % 19 <> 0) SELECT path, stem || '_fmcw_16bit_diff_profiles.npy' AS diff, stem || '_landmarks.npy' AS landmarks FROM x")
def session_side_files(spark, d):
    _, diff, marks = sessions.side_files(F.col("path"))
    return sessions.parse_paths(session_files(spark, d)).select("path", diff.alias("diff"), marks.alias("landmarks"))


@query(f"WITH {PATHS} SELECT path, CASE WHEN study >= 3 THEN ['samsung', 'xiaomi'][sub % 2 + 1] ELSE device END AS device FROM p WHERE k % 17 <> 0 AND k % 19 <> 0 AND (study >= 3 OR device = ['samsung', 'xiaomi'][sub % 2 + 1])")
def session_devices(spark, d):
    """Sessions with their person's device, where the folder says none or the same."""
    people = spark.range(1, 41).select(F.explode(F.array(*[F.lit(s) for s in range(1, 5)])).alias("study"), F.col("id").cast("int").alias("participant"), F.when(F.col("id") % 2 == 0, "samsung").otherwise("xiaomi").alias("known_device"))
    found = sessions.parse_paths(session_files(spark, d))
    agree = F.col("device").isNull() | (F.col("device") == F.when(F.col("participant") % 2 == 0, "samsung").otherwise("xiaomi"))
    return sessions.require_one_device(found.where(agree), people).select("path", "device")


LINES = "e AS (SELECT event_id, event_id % 9 AS label, event_id * 0.25::DOUBLE AS a, event_id * 0.25::DOUBLE + event_id % 7 * 0.5::DOUBLE AS b, coalesce(event_type, 'none') AS name FROM events)"


@query(f"WITH {LINES} SELECT event_id, label::INT AS label_id, a AS start_s, b AS end_s, b - a AS duration_s, name || ', again' AS name FROM e WHERE event_id % 10 <> 3")
def gesture_lines(spark, d):
    """Records as text lines, every tenth of them blank, and back."""
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("i"), F.coalesce("event_type", F.lit("none")).alias("name"))
    a = F.col("i") * 0.25
    line = F.when(F.col("i") % 10 == 3, "  ").otherwise(F.concat(F.col("i") % 9, F.lit(" , "), a.cast("string"), F.lit(", "), (a + F.col("i") % 7 * 0.5).cast("string"), F.lit(", "), "name", F.lit(", again ")))
    got = sessions.gestures(e.select(line.alias("value"), "event_id"), ["event_id"])
    return got.select("event_id", "label_id", "start_s", "end_s", (F.col("end_s") - F.col("start_s")).alias("duration_s"), "name")


@query("SELECT event_id * 0.0625::DOUBLE AS ts_s FROM events WHERE event_id % 5 <> 2")
def frame_time_lines(spark, d):
    i = F.col("event_id")
    return sessions.frame_times(table(spark, d, "events").select(F.when(i % 5 == 2, "").otherwise(F.concat((i * 0.0625).cast("string"), F.lit(" , more, fields"))).alias("value")))


@query("SELECT o_orderkey, o_orderkey % 3 AS session, (o_orderkey % 3 * 100 + o_orderkey % 7)::BIGINT AS audio_sync, o_orderkey % 3 * 1.5::DOUBLE AS gt_sync, 'g' || (o_orderkey % 3) || '.npy' AS gt_file, 'g' || (o_orderkey % 3) || '_frame_time.txt' AS frame_times FROM orders")
def config_sync_points(spark, d):
    """Sync points and ground-truth files of sessions from configurations in JSON."""
    k = F.col("o_orderkey")
    three = lambda f: F.array(*[f(i) for i in range(3)])
    audio = F.struct(F.struct(F.lit(48000).alias("sampling_rate"), F.lit(600).alias("frame_length")).alias("config"), three(lambda i: F.lit(i * 100) + k % 7).alias("syncing_poses"))
    truth = F.struct(three(lambda i: F.lit(f"g{i}.npy")).alias("files"), three(lambda i: F.lit(i * 1.5)).alias("syncing_poses"))
    o = table(spark, d, "orders").select("o_orderkey", (k % 3).alias("session"), F.to_json(F.struct(audio.alias("audio"), truth.alias("ground_truth"))).alias("json"))
    read = o.select("o_orderkey", "session", F.from_json("json", sessions.CONFIG).alias("c")).select("o_orderkey", "session", "c.*")
    return sessions.sync_pair(read, F.col("session"), ["o_orderkey", "session"])


@query(f"WITH {S} SELECT sample_id, true AS complete FROM s WHERE sample_id % 9 <> 0 UNION ALL SELECT sample_id, false FROM s WHERE sample_id % 9 = 0")
def landmark_completeness(spark, d):
    pose = F.when(F.col("sample_id") % 27 == 0, F.slice("pose", 1, 60)).when(F.col("sample_id") % 9 == 0, F.concat(F.slice("pose", 1, 62), F.array(F.lit(float("nan"))))).otherwise(F.col("pose"))
    return samples(spark, d).select("sample_id", poses.valid_pose(pose).alias("complete"))


@query(f"WITH {S} SELECT sample_id, round(e[25], 6) AS x, round(e[26], 6) AS y, round(e[27], 6) AS z FROM s")
def joint_by_name(spark, d):
    j = poses.joint(F.col("pose"), JOINTS[8])
    return samples(spark, d).select("sample_id", *[F.round(j[i], 6).alias(n) for i, n in enumerate("xyz")])


@query(f"WITH {R}, w AS (SELECT frame_id, frame_id * 600 AS pos FROM fr), l AS (SELECT event_id AS frame_no, event_id * 0.5::DOUBLE AS t FROM events WHERE event_id % 3 = 0), v AS (SELECT frame_id, (frame_id * 600 - 1234) / 48000.0::DOUBLE + 1.25 AS t FROM fr WHERE frame_id >= 8 AND (frame_id - 8) % 3 = 0) SELECT frame_id AS frame_idx, max(frame_no) AS label FROM v JOIN l ON l.t <= v.t GROUP BY frame_id")
def labelled_windows(spark, d):
    """Windows of a recording with the latest label at or before their end."""
    p = framed(spark, d).select(F.lit("s").alias("session_id"), F.col("frame_id").alias("frame_idx"), F.transform("samples", lambda v: v.cast("float")).alias("samples"), F.lit(1234).alias("audio_sync"), F.lit(1.25).alias("gt_sync"))
    marks = table(spark, d, "events").where("event_id % 3 = 0").select(F.lit("s").alias("session_id"), (F.col("event_id") * 0.5).alias("ts_s"), F.col("event_id").alias("joints"))
    return sessions.labelled_windows(p, marks, 8, 3, 1, 48000, 600).select("frame_idx", F.col("joints").alias("label"))


# Signals


@query(f"WITH {R}, c AS (SELECT frame_id, x[6:35] AS y FROM fr) SELECT frame_id, len(y) AS bins, round(y[1], 6) AS first, round(list_sum(y), 4) AS total FROM c")
def descriptor_crop(spark, d):
    c = framed(spark, d).select("frame_id", fr.descriptor_crop(F.col("samples"), 5, 30).alias("y"))
    return c.select("frame_id", F.size("y").cast("long").alias("bins"), F.round(F.col("y")[0], 6).alias("first"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query(f"WITH {R}, n AS (SELECT max(frame_id) + 1 AS n FROM fr) SELECT frame_id, round(frame_id / 80, 6) AS timestamp_s, round(x[1], 6) AS first FROM fr, n WHERE frame_id IN (n - 2, 3)")
def frames_by_index(spark, d):
    f = framed(spark, d)
    two = fr.frame_at(f, ["rec"], "frame_id", -2, 80.0).unionByName(fr.frame_at(f, ["rec"], "frame_id", 3, 80.0))
    return two.select("frame_id", F.round("timestamp_s", 6).alias("timestamp_s"), F.round(F.col("samples")[0], 6).alias("first"))


@query(f"SELECT event_id, round(0.05 + event_id * {BIN!r}::DOUBLE, 9) AS range_m, round(2 * (event_id * 0.001::DOUBLE) / {SPEED_OF_SOUND}, 12) AS delay_s FROM events")
def bin_ranges(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.round(fr.bin_range(e, BIN, 0.05), 9).alias("range_m"), F.round(dsp.reflector_delay(e * 0.001), 12).alias("delay_s"))


@query(f"WITH {R}, q AS (SELECT frame_id, list_transform(x, lambda v: greatest(-32768, least(32767, round(v * 50)))::SMALLINT) AS s FROM fr) SELECT frame_id, round(list_sum(list_transform(s, lambda v: v / 32768.0::DOUBLE)), 6) AS total, round(list_max(s) / 32768.0::DOUBLE, 6) AS top FROM q")
def pcm_scaling(spark, d):
    s = F.transform("samples", lambda v: F.least(F.lit(32767), F.greatest(F.lit(-32768), F.round(v * 50))).cast("short"))
    x = framed(spark, d).select("frame_id", dsp.pcm(s).alias("x"))
    return x.select("frame_id", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.array_max("x"), 6).alias("top"))


def _sweep_sql(t: str, c: Chirp) -> str:
    u = f"({t}) / {c.duration!r}::DOUBLE"
    edge = f"least({u}, 1 - {u})"
    tukey = f"CASE WHEN {edge} < 0.125 THEN 0.5 * (1 - cos(2 * pi() * {edge} / 0.25)) ELSE 1 END"
    return f"CASE WHEN ({t}) >= 0 AND ({t}) < {c.duration!r}::DOUBLE THEN sin(2 * pi() * ({c.f_start!r}::DOUBLE * ({t}) + 0.5 * {c.bandwidth / c.duration!r}::DOUBLE * ({t}) * ({t}))) * {tukey} ELSE 0 END"


C48 = Chirp()


@query(f"SELECT event_id, round({_sweep_sql('event_id * 0.0000101::DOUBLE - 0.001', C48)}, 6) AS value FROM events")
def chirp_samples(spark, d):
    t = F.col("event_id") * 0.0000101 - 0.001
    return table(spark, d, "events").select("event_id", F.round(dsp.chirp_column(t, C48), 6).alias("value"))


ECHO = "t - 2 * r / {c} - floor((t - 2 * r / {c}) / {d!r}::DOUBLE) * {d!r}::DOUBLE".format(c=f"{SPEED_OF_SOUND}::DOUBLE", d=C48.duration)


@query(f"WITH c AS (SELECT c_custkey AS k, 0.05::DOUBLE + c_custkey % 13 * 0.02::DOUBLE AS r FROM customer WHERE c_custkey % 10 = 0), f AS (SELECT k, i, i / 48000.0::DOUBLE AS t, unnest([1.0::DOUBLE, 0.5::DOUBLE]) AS a, unnest([r, r + 0.06::DOUBLE]) AS r FROM c, range(0, 600) x(i)), e AS (SELECT k, i, sum(a * {_sweep_sql(ECHO, C48)}) AS v FROM f GROUP BY k, i) SELECT k, round(sum(v * v), 4) AS energy, round(max(CASE WHEN i = 300 THEN v END), 5) AS middle FROM e GROUP BY k")
def simulated_frames(spark, d):
    """Frames of two reflectors; every tenth customer is a scene."""
    k = F.col("c_custkey")
    r = F.lit(0.05) + k % 13 * 0.02
    scene = F.array(*[F.struct(x.alias("range_m"), F.lit(a).alias("amplitude")) for x, a in ((r, 1.0), (r + 0.06, 0.5))])
    f = table(spark, d, "customer").where("c_custkey % 10 = 0").select(k.alias("k"), dsp.echoes_column(scene, C48).alias("x"))
    return f.select("k", F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v), 4).alias("energy"), F.round(F.col("x")[300], 5).alias("middle"))


@query(f"WITH {R}, o AS (SELECT frame_id, x, row_number() OVER (ORDER BY frame_id) - 1 AS at FROM fr), p AS (SELECT a.frame_id, list_sum(list_transform(range(1, 51), lambda i: a.x[i] * (a.x[i] - b.x[i]))) AS v FROM o a JOIN o b ON b.frame_id = a.frame_id - 1 WHERE a.frame_id >= 2) SELECT frame_id, round(v, 4) AS product FROM p")
def original_and_difference(spark, d):
    """Columns of a recording paired with the stored differences that belong to them."""
    f = framed(spark, d)
    stored = fr.differences(f, ["rec"], "frame_id").where("frame_id >= 2").select("rec", (F.col("frame_id") - 2).alias("frame"), "samples")
    met = fr.paired(f.withColumnRenamed("frame_id", "frame"), stored, ["rec"], 2)
    return met.select(F.col("frame").alias("frame_id"), F.round(F.aggregate(F.zip_with("samples", "diff", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v), 4).alias("product"))


@query(f"WITH {R}, q AS (SELECT frame_id, list_position(x, list_max(x)) - 1 AS bin, list_max(x) AS top, list_sort(list_transform(x, lambda v: abs(v))) AS a FROM fr), f AS (SELECT frame_id, bin, top, least((a[5] + (a[6] - a[5]) * 0.9::DOUBLE) * {math.sqrt(2 * math.log(2)) / math.sqrt(-2 * math.log(0.9))!r}::DOUBLE, a[50]) AS floor FROM q) SELECT frame_id, CASE WHEN top > 0 AND (floor = 0 OR top >= 20 * floor) THEN bin::INT END AS bin FROM f")
def strong_peaks(spark, d):
    """The largest bin of each frame, null where it does not stand out from the floor twenty times."""
    f = framed(spark, d)
    values = f.select("frame_id", F.size("samples").alias("n"), F.posexplode("samples").alias("bin", "value"))
    top = f.select("frame_id", (F.array_position("samples", F.array_max("samples")) - 1).cast("int").alias("bin"), F.lit(0.0).alias("range_m"), F.array_max("samples").alias("amplitude"))
    return fr.strong_enough(top, fr.noise_floor(values, ["frame_id"]), ["frame_id"], 20.0).select("frame_id", "bin")


# Cavities, modes and the channel


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({SPEED_OF_SOUND} / (2 * pi()) * sqrt(0.0005::DOUBLE / (l_quantity * 0.00001::DOUBLE * 0.02::DOUBLE)), 4) AS frequency_hz, round((200 + l_quantity * 20) / (50 + l_discount * 1000), 6) AS q, round(ln(1000::DOUBLE) / (10 + l_quantity), 6) AS t60_s FROM lineitem")
def resonance_derived(spark, d):
    """Frequency of a cavity forward, quality factor, and the time to fall by 60 dB."""
    f, bw = 200 + F.col("l_quantity") * 20, 50 + F.col("l_discount") * 1000
    forward = fr.helmholtz_frequency(F.lit(0.0005), F.col("l_quantity") * 0.00001, F.lit(0.02))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(forward, 4).alias("frequency_hz"), F.round(fr.quality_factor(f, bw), 6).alias("q"), F.round(fr.reverberation_time(10 + F.col("l_quantity")), 6).alias("t60_s"))


MODES = "(VALUES " + ", ".join(f"('{m}', {f}::DOUBLE, {b}::DOUBLE, '{c}')" for m, (f, b, c) in CLAP_MODES.items()) + ") AS m(mode, f, bw, class)"


@query(f"SELECT class AS label, count(*) AS n, round(avg(log10(f)), 9) AS mean_0, round(avg(log10(bw)), 9) AS mean_1, round(0.035::DOUBLE * 0.035, 9) AS var_0, round(0.13::DOUBLE * 0.13, 9) AS var_1 FROM {MODES} GROUP BY class")
def clap_prototypes(spark, d):
    return rounded(clap.prototypes(spark), "mean_0", "mean_1", "var_0", "var_1", digits=9)


MODE_OF = "SELECT event_id, [" + ", ".join(f"'{m}'" for m in CLAP_MODES) + "][event_id % 8 + 1] AS mode, 400 + event_id % 1300 AS f, 90 + event_id % 310 AS bw FROM events"


@query(f"WITH e AS ({MODE_OF}) SELECT event_id, mode, class, round(log10(e.f), 9) AS f0, round(log10(e.bw), 9) AS f1 FROM e JOIN {MODES} USING (mode)")
def clap_features(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, CLAP_MODES)), (i % 8 + 1).cast("int")).alias("mode"), (400 + i % 1300).cast("double").alias("f"), (90 + i % 310).cast("double").alias("bw"))
    return rounded(e.select("event_id", "mode", clap.merged_class(F.col("mode")).alias("class"), *clap.features_of(F.col("f"), F.col("bw"))), "f0", "f1", digits=9)


@query(f"WITH p AS (SELECT class AS label, avg(log10(f)) AS a, avg(log10(bw)) AS b FROM {MODES} GROUP BY class), e AS ({MODE_OF}), s AS (SELECT event_id, label, -0.5 * ((log10(e.f) - a)**2 / 0.001225::DOUBLE + (log10(e.bw) - b)**2 / 0.0169::DOUBLE) AS s FROM e, p), k AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY s DESC, label) AS k, max(s) OVER (PARTITION BY event_id) AS top FROM s) SELECT event_id, max(CASE WHEN k = 1 THEN label END) AS predicted, round(1 / sum(exp(s - top)), 6) AS posterior, 0.25::DOUBLE AS chance FROM k GROUP BY event_id")
def clap_prototype_classifier(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select("event_id", *clap.features_of((400 + i % 1300).cast("double"), (90 + i % 310).cast("double")))
    return clap.predict_classes(e, clap.prototypes(spark), ["event_id"], ["f0", "f1"], "label").select("event_id", "predicted", F.round("posterior", 6).alias("posterior"), F.lit(clap.chance(4)).alias("chance"))


@query("WITH c AS (SELECT quality AS t, toxic AS p, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), q AS (SELECT t, p, n, sum(n) OVER () AS s, sum(n) OVER (PARTITION BY t) AS a, sum(n) OVER (PARTITION BY p) AS b FROM c), r AS (SELECT sum(n / s * log2(n * s / (a * b))) AS bits, sum(CASE WHEN t = p THEN n END) / max(s) AS accuracy, max(s)::BIGINT AS samples FROM q) SELECT 'accuracy' AS name, round(accuracy, 6) AS value, 'share' AS unit, samples, 'within-session on claps 1, 3 subjects, labels synthetic, 0 min calibration' AS protocol FROM r UNION ALL SELECT 'capacity', round(bits, 6), 'bit', samples, 'within-session on claps 1, 3 subjects, labels synthetic, 0 min calibration' FROM r")
def channel_measurements(spark, d):
    """Accuracy and capacity, each with the protocol it was measured under."""
    pairs = table(spark, d, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")
    said = clap.measured(clap.confusion(pairs, "quality", "toxic"), Protocol(Split.WITHIN_SESSION, "claps", "1", GroundTruth.SYNTHETIC, 3))
    return spark.createDataFrame([(k, round(m.value, 6), m.unit, m.samples, m.protocol.describe()) for k, m in said.items()], "name string, value double, unit string, samples long, protocol string")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(7 * log2(24::DOUBLE) - l_quantity * 0.8::DOUBLE, 6) AS deficit, l_quantity * 0.8::DOUBLE >= 7 * log2(24::DOUBLE) AS feasible, ceil(7 * log2(24::DOUBLE) / (l_quantity * 0.8::DOUBLE))::BIGINT AS events_needed, round({ARM_RANGE_DEG} / pow(2, l_quantity * 0.8::DOUBLE / 7), 6) AS resolution_deg FROM lineitem")
def capacity_gaps(spark, d):
    g = clap.gap(F.col("l_quantity") * 0.8)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(g["deficit"], 6).alias("deficit"), g["feasible"].alias("feasible"), g["events_needed"].alias("events_needed"), F.round(g["resolution_deg"], 6).alias("resolution_deg"))


VOCABULARY = [("split", s.name.lower(), str(int(s))) for s in Split] + [("alignment", a.value, a.describe()) for a in Alignment] + [("clap class", m, c) for m, (_, _, c) in CLAP_MODES.items()] + [("confusable", a, b) for a, b in CONFUSABLE] + [(e.__name__.lower(), str(x.value), x.name.lower()) for e in (Device, Hand, Study, Normalisation, Phase, GuardName, GroundTruth) for x in e] + [("impulse bits", "least", str(IMPULSE_BITS[0])), ("impulse bits", "most", str(IMPULSE_BITS[1]))]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in VOCABULARY) + ") AS v(kind, name, says)")
def vocabulary(spark, d):
    return spark.createDataFrame(VOCABULARY, "kind string, name string, says string")


# Wire and lines


@query(f"WITH {S} SELECT sample_id, CASE sample_id % 6 WHEN 0 THEN 'bad' WHEN 1 THEN 'bad' WHEN 2 THEN 'bad' ELSE 'good' END AS line FROM s")
def pose_line_validation(spark, d):
    """Lines of another type, of another version or cut off are no poses."""
    good = wire.pose_json(F.col("pose"), F.col("ts"), F.col("ts"), F.lit("m"), F.lit(2.0))
    k = F.col("sample_id") % 6
    line = F.when(k == 0, F.regexp_replace(good, '"pose"', '"post"')).when(k == 1, F.regexp_replace(good, '"version":1', '"version":2')).when(k == 2, F.substring(good, 1, 200)).otherwise(good)
    return samples(spark, d).select("sample_id", F.when(wire.parse_pose(line).isNotNull(), "good").otherwise("bad").alias("line"))


@query(f"WITH {S} SELECT sample_id, 48000 AS sample_rate, CASE WHEN sample_id % 5 = 0 THEN NULL ELSE 60 END AS n, CASE WHEN sample_id % 5 = 0 THEN NULL ELSE round(e[60]::FLOAT::DOUBLE, 5) END AS last FROM s")
def capture_line_round_trip(spark, d):
    s = samples(spark, d).select("sample_id", F.transform(F.slice("features", 1, 60), lambda v: v.cast("float")).alias("f"))
    line = wire.capture_json(F.col("f"), F.col("sample_id").cast("double"), F.lit(48000), (2, 5, 6))
    p = wire.parse_capture(F.when(F.col("sample_id") % 5 == 0, F.regexp_replace(line, '"capture"', '"other"')).otherwise(line))
    return s.select("sample_id", F.lit(48000).alias("sample_rate"), p.alias("p")).select("sample_id", "sample_rate", F.when(F.col("p").isNotNull(), F.size("p.features")).alias("n"), F.round(F.col("p.features")[59].cast("double"), 5).alias("last"))


@query(f"WITH {S} SELECT sample_id, round(e[10], 6) AS x, round(-e[12], 6) AS y, round(e[11], 6) AS z FROM s")
def viewer_axes(spark, d):
    j = wire.scene_axes(poses.joint(F.col("pose"), JOINTS[3]))
    return samples(spark, d).select("sample_id", *[F.round(j[i], 6).alias(n) for i, n in enumerate("xyz")])


# Streams


PACKETS = "p AS (SELECT user_id::VARCHAR AS stream_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nr FROM events WHERE user_id IS NOT NULL), t AS (SELECT stream_id, seq, nr, nr * 12500000 + CASE WHEN nr % 5 = 4 THEN 40000000 ELSE 0 END AS ns FROM p)"


@query(f"WITH {PACKETS}, g AS (SELECT stream_id, abs(ns / 1e9 - (lag(ns) OVER w / 1e9 + 0.0125::DOUBLE)) > 0.03 AS broken FROM t WINDOW w AS (PARTITION BY stream_id ORDER BY ns, seq)) SELECT stream_id, count(*) AS packets, 1 AS rates, CASE WHEN count(*) > 1 THEN 1 ELSE 0 END AS sizes, sum(coalesce(broken, false)::INT)::BIGINT AS breaks FROM g GROUP BY stream_id")
def stream_health(spark, d):
    """Streams of a packet an event, every fifth of them 40 ms late."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    at = F.row_number().over(w) - 1
    p = table(spark, d, "events").where("user_id IS NOT NULL").select(F.col("user_id").cast("string").alias("stream_id"), F.col("event_id").alias("seq"), (at * F.lit(12_500_000).cast("long") + F.when(at % 5 == 4, 40_000_000).otherwise(0)).alias("timestamp_ns"), F.lit(48000).alias("sample_rate"), F.array_repeat(F.lit(0).cast("short"), 600).alias("samples"))
    return live.health(p)


@query("WITH u AS (SELECT user_id::VARCHAR AS stream_id, user_id % 4 = 3 AS gap FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)) SELECT stream_id, 40 AS frames, CASE WHEN gap THEN 2 ELSE 1 END AS breaks, CASE WHEN gap THEN 2 ELSE 1 END AS starts FROM u")
def stream_gaps(spark, d):
    """Two runs of 20 chirps; in every fourth stream the second comes a second later, which starts anew."""
    people = table(spark, d, "events").where("user_id IS NOT NULL").select("user_id").distinct()
    a = live.chirp_packets(spark, people, 20, chunk=600, lead=0)
    late = F.when(F.col("stream_id").cast("long") % 4 == 3, 1_000_000_000).otherwise(0)
    b = a.withColumns({"seq": F.col("seq") + 20, "timestamp_ns": F.col("timestamp_ns") + 250_000_000 + late})
    f = live.aligned_frames(a.unionByName(b), Chirp())
    return f.groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum((~F.col("continuous")).cast("int")).alias("breaks"), F.countDistinct(F.when(~F.col("continuous"), F.col("frame_no"))).alias("starts"))


@query(f"WITH {R}, a AS (SELECT frame_id, x, list_transform(range(1, 51), lambda i: x[i]::FLOAT) AS y FROM fr), w AS (SELECT frame_id, max(list_max(list_transform(y, lambda v: abs(v)))) OVER o AS m1, list_max(list_transform(range(1, 51), lambda i: abs(y[i] - lag_y[i]))) AS dm, first_value(y) OVER o AS oldest, count(*) OVER o AS n FROM (SELECT frame_id, y, lag(y) OVER (ORDER BY frame_id) AS lag_y FROM a) WHERE lag_y IS NOT NULL WINDOW o AS (ORDER BY frame_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)), k AS (SELECT frame_id, n, oldest, greatest(m1, max(dm) OVER (ORDER BY frame_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)) AS top FROM w) SELECT frame_id AS frame_no, round(((oldest[5] - oldest[2]) / top)::DOUBLE, 4) AS y1 FROM k WHERE n = 8")
def live_poses(spark, d):
    """Windows through a predictor that says their first 63 numbers, wrist at the origin."""
    f = framed(spark, d).select(F.lit("s").alias("stream_id"), F.col("frame_id").alias("frame_no"), F.col("frame_id").cast("double").alias("timestamp_s"), F.lit(True).alias("continuous"), F.transform("samples", lambda v: v.cast("float")).alias("samples"))
    windows = live.assembled_windows(f, 8)
    said = live.infer(windows, lambda x: x[:, :63], "first", 800)
    return said.select(F.col("source_timestamp_s").cast("long").alias("frame_no"), F.round(F.col("pose")[4].cast("double"), 4).alias("y1"))


# Folds, guards and calibration


@query(f"WITH {S} SELECT sample_id FROM s WHERE participant = 'P03' AND device = 'D0' UNION SELECT sample_id FROM s WHERE participant = 'P04' AND session = 'S1'")
def samples_where(spark, d):
    s = samples(spark, d)
    return poses.where(s, participant=" p03 ", device="D0").select("sample_id").union(poses.where(s, session="p04/s1").select("sample_id"))


@query(f"WITH {S} SELECT sample_id, participant FROM s ORDER BY participant, ts LIMIT 25")
def corpus_head(spark, d):
    return poses.head(samples(spark, d), 25, ["participant", "ts"], with_features=False).select("sample_id", "participant")


def _families() -> str:
    parts = {"cross_user": FOLD_USER, "cross_session": FOLD_SESSION, "cross_device": FOLD_DEVICE, "within_session": FOLD_TAIL}
    out, names = [], []
    for name, sql in parts.items():
        for old in ("f AS (", "o AS ("):
            sql = sql.replace(old, old.replace(" AS", f"_{name} AS"))
        out.append(sql.replace("FROM o WHERE", f"FROM o_{name} WHERE"))
        names.append(f"SELECT '{name}' AS split, fold, sample_id, role FROM f_{name}")
    return ", ".join(out) + ", ff AS (" + " UNION ALL ".join(names) + ")"


FAMILIES = f"{S}, {SK}, {_families()}"
GUESS = f"{FAMILIES}, q AS (SELECT sample_id, k AS joint, e[3*k+1]-e[1] AS x, e[3*k+2]-e[2] AS y, e[3*k+3]-e[3] AS z FROM s, (SELECT unnest(range(21)) AS k)), tr AS (SELECT split, fold, ff.sample_id, participant FROM ff JOIN s USING (sample_id) WHERE role = 'train'), te AS (SELECT split, fold, ff.sample_id, participant FROM ff JOIN s USING (sample_id) WHERE role = 'test'), mp AS (SELECT split, fold, joint, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM tr JOIN q USING (sample_id) GROUP BY ALL), sp AS (SELECT split, fold, participant, joint, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM tr JOIN q USING (sample_id) GROUP BY ALL), dd AS (SELECT te.split, te.fold, te.sample_id, tr.sample_id AS n, round(list_sum(list_transform(range(1, 65), lambda i: (a.e[i] - b.e[i])**2)), 9) AS d2 FROM te JOIN tr USING (split, fold) JOIN s a ON a.sample_id = te.sample_id JOIN s b ON b.sample_id = tr.sample_id), nn AS (SELECT split, fold, sample_id, n FROM (SELECT *, row_number() OVER (PARTITION BY split, fold, sample_id ORDER BY d2, n) AS k FROM dd) WHERE k = 1), gg AS (SELECT 'mean-pose' AS predictor, te.split, te.fold, te.sample_id, mp.joint, mp.x, mp.y, mp.z FROM te JOIN mp USING (split, fold) UNION ALL SELECT 'subject-mean', te.split, te.fold, te.sample_id, mp.joint, coalesce(sp.x, mp.x), coalesce(sp.y, mp.y), coalesce(sp.z, mp.z) FROM te JOIN mp USING (split, fold) LEFT JOIN sp ON sp.split = te.split AND sp.fold = te.fold AND sp.participant = te.participant AND sp.joint = mp.joint UNION ALL SELECT 'nearest-neighbour', split, fold, nn.sample_id, q.joint, q.x, q.y, q.z FROM nn JOIN q ON q.sample_id = nn.n), ee AS (SELECT predictor, split, fold, gg.sample_id, gg.joint, 1000*sqrt((gg.x-q.x)**2+(gg.y-q.y)**2+(gg.z-q.z)**2) AS e FROM gg JOIN q ON q.sample_id = gg.sample_id AND q.joint = gg.joint)"


def family_metrics(spark, d) -> DataFrame:
    """(split, predictor, fold, ...) of the three baselines in all folds of all families."""
    return suite.baseline_metrics(samples(spark, d), 250.0)


@query(f"WITH {GUESS} SELECT split, predictor, fold, count(DISTINCT sample_id) AS samples, round(avg(e), 3) AS mpjpe, round(avg(CASE WHEN joint > 0 THEN e END), 3) AS mpjpe_excl_root, round(avg((e <= 250)::INT), 5) AS pck FROM ee GROUP BY ALL")
def suite_fold_metrics(spark, d):
    return family_metrics(spark, d).select("split", "predictor", "fold", "samples", F.round("mpjpe", 3).alias("mpjpe"), F.round("mpjpe_excl_root", 3).alias("mpjpe_excl_root"), F.round("pck", 5).alias("pck"))


@query(f"WITH {GUESS}, b AS (SELECT split, predictor, fold, count(DISTINCT sample_id) AS n, avg(e) AS m FROM ee GROUP BY ALL) SELECT split, predictor, sum(n)::BIGINT AS samples, round(sum(n * m) / sum(n), 3) AS mpjpe, count(*) AS folds, round(min(m), 3) AS least, round(median(m), 3) AS median, round(max(m), 3) AS most FROM b GROUP BY ALL")
def suite_pooled(spark, d):
    by = family_metrics(spark, d).groupBy("split", "predictor")
    n = F.col("samples")
    return rounded(by.agg(F.sum(n).alias("samples"), (F.sum(n * F.col("mpjpe")) / F.sum(n)).alias("mpjpe"), F.count("*").alias("folds"), F.min("mpjpe").alias("least"), F.median("mpjpe").alias("median"), F.max("mpjpe").alias("most")), "mpjpe", "least", "median", "most", digits=3)


def _matches(split: str, unit: str) -> str:
    return f"""{J}, u AS (SELECT *, {unit} AS unit FROM j), f AS (SELECT DISTINCT unit AS fold FROM u),
p AS (SELECT fold, participant, joint, avg(ax) AS x, avg(ay) AS y, avg(az) AS z FROM u, f WHERE unit <> fold GROUP BY ALL),
t AS (SELECT unit AS fold, joint, avg(ax) AS x, avg(ay) AS y, avg(az) AS z FROM u GROUP BY ALL),
b AS (SELECT a.fold, a.participant, c.participant AS q, avg(sqrt((a.x-c.x)**2+(a.y-c.y)**2+(a.z-c.z)**2)) AS d FROM p a JOIN p c ON a.fold = c.fold AND a.joint = c.joint AND a.participant < c.participant GROUP BY ALL),
m AS (SELECT fold, median(d) AS typical FROM b GROUP BY fold),
n AS (SELECT p.fold, participant, avg(sqrt((p.x-t.x)**2+(p.y-t.y)**2+(p.z-t.z)**2)) AS d FROM p JOIN t ON p.fold = t.fold AND p.joint = t.joint GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY d, participant) AS k FROM n),
h AS (SELECT fold, count(DISTINCT p.participant) AS shared FROM p WHERE EXISTS (SELECT 1 FROM u WHERE u.unit = p.fold AND u.participant = p.participant) GROUP BY fold)
SELECT fold, participant AS nearest, round(d, 6) AS distance, round(typical, 6) AS typical, round(d / typical, 6) AS ratio, coalesce(shared, 0)::BIGINT AS shared, d / typical > 0.2 AND coalesce(shared, 0) = 0 AS passed FROM k JOIN m USING (fold) LEFT JOIN h USING (fold) WHERE k = 1"""


def _guarded(spark, d, split: Split) -> DataFrame:
    family = suite.Family.of(samples(spark, d), split)
    return rounded(poses.fold_label_matches(family.samples, split), "distance", "typical", "ratio", digits=6)


@query(f"WITH {_matches('cross_user', 'lower(participant)')}")
def guard_label_match_by_user(spark, d):
    return _guarded(spark, d, Split.CROSS_USER)


@query(f"WITH {_matches('cross_device', 'device')}")
def guard_label_match_by_device(spark, d):
    return _guarded(spark, d, Split.CROSS_DEVICE)


@query(f"WITH {S}, {FOLD_USER}, g AS (SELECT f.fold, f.role, count(*) OVER (PARTITION BY f.fold, f.role) AS n, sha256(concat_ws('|', s.sample_id::VARCHAR, participant, session, device)) AS h FROM f JOIN s USING (sample_id)), p AS (SELECT fold, role, {LEAVES} FROM g GROUP BY fold, role, b) SELECT fold, role, any_value(n) AS n, {TOP} AS fingerprint FROM p GROUP BY fold, role")
def split_fingerprints(spark, d):
    s = samples(spark, d)
    return poses.split_fingerprint(poses.folds(s, Split.CROSS_USER), s)


@query(f"WITH {S} SELECT 'x' AS fold, sample_id, 'overlap' AS fault FROM s WHERE sample_id % 50 = 0 UNION ALL SELECT 'x', sample_id, 'repeated' FROM s WHERE sample_id % 50 = 1 UNION ALL SELECT 'x', -1, 'unknown'")
def fold_index_faults(spark, d):
    s = samples(spark, d)
    one = s.select(F.lit("x").alias("fold"), "sample_id", F.lit("train").alias("role"))
    more = one.where("sample_id % 50 = 0").withColumn("role", F.lit("test")).unionByName(one.where("sample_id % 50 = 1")).unionByName(spark.createDataFrame([("x", -1, "train")], "fold string, sample_id long, role string"))
    return poses.index_faults(one.unionByName(more), s)


CAL_ALL = S + ", w AS (SELECT sample_id, participant, ts, session FROM s WHERE session = 'S1'), r AS (SELECT *, row_number() OVER (PARTITION BY participant ORDER BY ts, sample_id) AS k FROM w), b AS (SELECT unnest([0, 1, 2, 20])::DOUBLE AS budget), g AS (SELECT budget, participant, round_even(budget * 10, 0)::BIGINT AS wanted, count(*) FILTER (k <= round_even(budget * 10, 0)) AS got FROM b, r GROUP BY ALL)"


@query(f"WITH {CAL_ALL} SELECT budget, min(got) * 6.0::DOUBLE / 60 AS achieved, bool_or(got < wanted) AS truncated FROM g GROUP BY budget")
def calibration_achieved(spark, d):
    """Every person tested on session S2 after calibration on S1, trained on S0 of the others: minutes of the least."""
    s = samples(spark, d)
    test = s.where("session = 'S2'").select(F.col("participant").alias("fold"), "sample_id", F.lit("test").alias("role"))
    own = s.where("session = 'S0'").select(F.col("participant").alias("fold"), "sample_id", F.lit("train").alias("role"))
    folded = test.unionByName(own)
    budgets = [0.0, 1.0, 2.0, 20.0]
    taken = poses.calibration(s, folded, budgets, 6.0)
    return poses.achieved(s, folded, taken, budgets, 6.0)


@query(f"WITH {J}, a AS (SELECT joint, avg(x) AS mx, greatest(stddev_pop(x), 1e-6) AS sx FROM j GROUP BY joint) SELECT sample_id, round(max(CASE WHEN joint = 5 THEN (x - mx) / sx END) * max(CASE WHEN joint = 5 THEN sx END) + max(CASE WHEN joint = 5 THEN mx END), 6) AS x5, 0.0::DOUBLE AS x0 FROM j JOIN a USING (joint) GROUP BY sample_id")
def restored_poses(spark, d):
    """Standardised by the training statistics of all samples, and back with the wrist at the origin."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    s = samples(spark, d).select("sample_id", poses.wrist_relative(F.col("pose")).alias("p"))
    v = array_to_vector(F.col("p"))
    stats = s.select(v.alias("v")).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"), F.transform(vector_to_array(Summarizer.std(F.col("v"))), lambda x: F.greatest(x, F.lit(1e-6))).alias("sd"))
    met = s.join(F.broadcast(stats), F.lit(True))  # one row
    back = poses.restore_pose(poses.standardise(F.col("p"), F.col("m"), F.col("sd")), F.col("m"), F.col("sd"))
    return met.select("sample_id", F.round(back[15], 6).alias("x5"), F.round(back[0], 6).alias("x0"))


@query(f"WITH {S} SELECT count(*) AS n, count(DISTINCT participant) AS people FROM s")
def samples_with_features(spark, d):
    s = corpus.require_features(samples(spark, d))
    return s.agg(F.count("*").alias("n"), F.countDistinct("participant").alias("people"))
