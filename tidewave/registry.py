"""Queries over the driver's tables, each with equal SQL where SQL can say it.

Stand-ins: embeddings are poses (63 numbers) and features, label is the person; events ordered by event_id are a
recording of 50-sample frames; documents are files. Sums in another order differ in the last digits, so numbers are
rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.functions import clap, dsp
from tidewave.model import ARM_DOF, ARM_RANGE_DEG, ARM_RESOLUTION_DEG, JOINTS, SPEED_OF_SOUND, TIPS, Alignment, Chirp, Normalisation, Split
from tidewave.operators import frames as fr
from tidewave.operators import integrity, poses

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(frame: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


# Poses


def samples(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL AND label IS NOT NULL")
    v = F.col("embedding").cast("array<double>")
    return e.select(F.col("vec_id").alias("sample_id"), F.concat(F.lit("P"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("participant"), F.concat(F.lit("D"), (F.col("label") % 3).cast("string")).alias("device"), F.concat(F.lit("S"), (F.col("vec_id") % 3).cast("string")).alias("session"), F.col("vec_id").cast("double").alias("ts"), F.slice(v, 1, 63).alias("pose"), v.alias("features"))


S = "s AS (SELECT vec_id AS sample_id, 'P' || lpad(label::VARCHAR, 2, '0') AS participant, 'D' || (label % 3)::VARCHAR AS device, 'S' || (vec_id % 3)::VARCHAR AS session, vec_id::DOUBLE AS ts, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL)"
J = S + ", j AS (SELECT sample_id, participant, device, session, ts, k AS joint, e[3*k+1] AS ax, e[3*k+2] AS ay, e[3*k+3] AS az, e[3*k+1]-e[1] AS x, e[3*k+2]-e[2] AS y, e[3*k+3]-e[3] AS z FROM s, (SELECT unnest(range(21)) AS k))"
M = J + ", m AS (SELECT p.participant AS fold, joint, avg(ax) AS nx, avg(ay) AS ny, avg(az) AS nz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM j JOIN (SELECT DISTINCT participant FROM s) p ON j.participant <> p.participant GROUP BY ALL)"
E = M + ", err AS (SELECT j.sample_id, j.participant, j.session, j.participant AS fold, j.joint, 1000*sqrt((x-mx)**2+(y-my)**2+(z-mz)**2) AS e, 1000*sqrt((ax-nx)**2+(ay-ny)**2+(az-nz)**2) AS u FROM j JOIN m ON m.fold = j.participant AND m.joint = j.joint)"


def louo_errors(spark: SparkSession, d: str, alignment: Alignment = Alignment.ROOT) -> DataFrame:
    """Errors of the mean-pose baseline, refitted for each person left out."""
    s = samples(spark, d)
    means = poses.left_out_means(s, "participant")
    met = s.join(means, "participant")
    return met.select("sample_id", "participant", "session", F.col("participant").alias("fold"), poses.joint_errors(F.col("mean_pose"), F.col("pose"), alignment).alias("err"))


@query(f"WITH {E} SELECT fold, count(DISTINCT sample_id) AS samples, round(avg(e), 4) AS mpjpe FROM err GROUP BY fold")
def mpjpe_louo_mean_pose(spark, d):
    return rounded(poses.metrics(louo_errors(spark, d), ["fold"]).select("fold", "samples", "mpjpe"), "mpjpe")


@query(f"WITH {E}, f AS (SELECT fold, avg(e) AS m FROM err GROUP BY fold) SELECT (SELECT round(avg(e), 4) FROM err) AS pooled, round(min(m), 4) AS fold_min, round(median(m), 4) AS fold_median, round(max(m), 4) AS fold_max FROM f")
def mpjpe_pooled_vs_folds(spark, d):
    by = louo_errors(spark, d).groupBy("fold").agg(F.sum(poses.mean_of(F.col("err"))).alias("t"), F.count("*").alias("n"))
    return rounded(by.agg((F.sum("t") / F.sum("n")).alias("pooled"), F.min(F.col("t") / F.col("n")).alias("fold_min"), F.median(F.col("t") / F.col("n")).alias("fold_median"), F.max(F.col("t") / F.col("n")).alias("fold_max")), "pooled", "fold_min", "fold_median", "fold_max")


@query(f"WITH {E} SELECT fold, round(avg(e), 4) AS mpjpe FROM err WHERE joint > 0 GROUP BY fold")
def mpjpe_excl_root(spark, d):
    return rounded(poses.metrics(louo_errors(spark, d), ["fold"]).select("fold", F.col("mpjpe_excl_root").alias("mpjpe")), "mpjpe")


@query(f"WITH {E} SELECT fold, round(avg((e <= 250)::INT), 6) AS pck, round(avg(CASE WHEN joint > 0 THEN (e <= 250)::INT END), 6) AS pck_excl_root FROM err GROUP BY fold")
def pck_25cm(spark, d):
    return rounded(poses.metrics(louo_errors(spark, d), ["fold"], 250.0).select("fold", "pck", "pck_excl_root"), "pck", "pck_excl_root", digits=6)


NAMES = "n AS (SELECT unnest(range(21)) AS joint, unnest([" + ", ".join(f"'{n}'" for n in JOINTS) + "]) AS name)"
TIP = "(" + ", ".join(map(str, TIPS)) + ")"


def pooled(spark: SparkSession, d: str) -> DataFrame:
    return poses.metrics(louo_errors(spark, d), [])


def by_joint(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*map(F.lit, JOINTS))
    return pooled(spark, d).select(F.posexplode("per_joint").alias("joint", "error")).select("joint", F.element_at(names, F.col("joint") + 1).alias("name"), F.round("error", 4).alias("error"))


@query(f"WITH {E}, {NAMES} SELECT joint::INT AS joint, name, round(avg(e), 4) AS error FROM err JOIN n USING (joint) GROUP BY ALL")
def per_joint_error(spark, d):
    return by_joint(spark, d)


@query(f"WITH {E}, b AS (SELECT joint, avg(e) AS m FROM err GROUP BY joint), c AS (SELECT avg(CASE WHEN joint IN {TIP} THEN m END) AS t, avg(CASE WHEN joint NOT IN {TIP} THEN m END) AS r FROM b) SELECT round(t, 4) AS fingertips, round(r, 4) AS rest, round(CASE WHEN r > 0 THEN t / r ELSE 'inf'::DOUBLE END, 6) AS dilution FROM c")
def fingertip_dilution(spark, d):
    return pooled(spark, d).select(F.round("fingertips", 4).alias("fingertips"), F.round("rest", 4).alias("rest"), F.round("dilution", 6).alias("dilution"))


@query(f"WITH {E}, {NAMES} SELECT name, round(avg(e), 4) AS error FROM err JOIN n USING (joint) GROUP BY name, joint ORDER BY error DESC, joint LIMIT 5")
def worst_joints_topk(spark, d):
    return by_joint(spark, d).orderBy(F.desc("error"), "joint").limit(5).select("name", "error")


@query(f"WITH {E} SELECT fold, round(avg(u), 4) AS mpjpe FROM err GROUP BY fold")
def unaligned_mpjpe(spark, d):
    return rounded(poses.metrics(louo_errors(spark, d, Alignment.NONE), ["fold"]).select("fold", "mpjpe"), "mpjpe")


class _Text(str):
    """SQL text that adds and multiplies as numbers do, so that formulas of ``poses`` can be written down."""

    def _op(sign, turned=False):  # noqa: N805
        return lambda a, b: _Text(f"({b} {sign} {a})" if turned else f"({a} {sign} {b})")

    __add__, __sub__, __mul__, __rmul__, __radd__ = _op("+"), _op("-"), _op("*"), _op("*", True), _op("+", True)

    def __neg__(self):
        return _Text(f"(-{self})")


def _pa_sql() -> str:
    """The similarity fit of each frame: sums of products, largest root by Newton steps, quaternion, errors."""
    pairs = [a + b for a in "xyz" for b in "xyz"]
    named = {p: _Text(f"s{p}") for p in pairs}
    n = poses.quaternion_matrix(named)
    c2, c1, c0 = poses.characteristic(named, n)
    entries = {(i, j): _Text(f"n{i}{j}") for i in range(4) for j in range(4)}
    a = [[entries[i, j] - _Text("x") if i == j else entries[i, j] for j in range(4)] for i in range(4)]
    columns = ", ".join(f"({poses._minor(a, i, j)})::DOUBLE AS a{i}{j}" for j in range(4) for i in range(4))
    size = lambda j: "+".join(f"a{i}{j}*a{i}{j}" for i in range(4))
    best = lambda i: "CASE " + " ".join(f"WHEN {size(j)} = greatest({', '.join(size(k) for k in range(4))}) THEN a{i}{j} / sqrt({size(j)})" for j in range(4)) + f" END AS q{i}"
    turned = lambda r: {"x": "(q0*q0+q1*q1-q2*q2-q3*q3)*cx + 2*(q1*q2-q0*q3)*cy + 2*(q1*q3+q0*q2)*cz", "y": "2*(q1*q2+q0*q3)*cx + (q0*q0-q1*q1+q2*q2-q3*q3)*cy + 2*(q2*q3-q0*q1)*cz", "z": "2*(q1*q3-q0*q2)*cx + 2*(q2*q3+q0*q1)*cy + (q0*q0-q1*q1-q2*q2+q3*q3)*cz"}[r]
    return f"""WITH {M}, b AS (SELECT j.sample_id, j.fold, joint, nx AS px, ny AS py, nz AS pz, ax AS tx, ay AS ty, az AS tz FROM (SELECT *, participant AS fold FROM j) j JOIN m USING (fold, joint)),
c AS (SELECT *, {', '.join(f'px - avg(px) OVER f AS cx'.replace('px', 'p' + a).replace('cx', 'c' + a) + f", t{a} - avg(t{a}) OVER f AS d{a}" for a in 'xyz')} FROM b WINDOW f AS (PARTITION BY sample_id)),
e AS (SELECT sample_id, sum(cx*cx+cy*cy+cz*cz) AS p, sqrt(sum(cx*cx+cy*cy+cz*cz) * sum(dx*dx+dy*dy+dz*dz)) AS most, {', '.join(f'sum(c{k[0]}*d{k[1]}) AS u{k}' for k in pairs)} FROM c GROUP BY sample_id),
g AS (SELECT sample_id, p, most, {', '.join(f'u{k} / most AS s{k}' for k in pairs)} FROM e),
h AS (SELECT *, {c2} AS c2, {c1} AS c1, {c0} AS c0, {', '.join(f'{n[i][j]} AS n{i}{j}' for i in range(4) for j in range(4))} FROM g),
k AS (SELECT *, list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({poses.STEPS}), lambda i: i::DOUBLE)), lambda x, i: CASE WHEN (4*x*x + 2*c2)*x + c1 > 0 THEN x - (((x*x + c2)*x + c1)*x + c0) / ((4*x*x + 2*c2)*x + c1) ELSE x END) AS x FROM h),
l AS (SELECT sample_id, x * most / p AS scale, {columns} FROM k),
q AS (SELECT sample_id, scale, {', '.join(best(i) for i in range(4))} FROM l),
z AS (SELECT c.fold, c.sample_id, 1000*sqrt(""" + " + ".join(f"(scale * ({turned(r)}) - d{r})**2" for r in "xyz") + """) AS e FROM c JOIN q USING (sample_id))
SELECT fold, count(DISTINCT sample_id) AS samples, round(avg(e), 4) AS pa_mpjpe FROM z GROUP BY fold"""


@query(_pa_sql())
def pa_mpjpe(spark, d):
    s = samples(spark, d)
    met = s.join(poses.left_out_means(s, "participant"), "participant")
    fitted = met.select("participant", "pose", poses.similarity_fit(F.col("mean_pose"), F.col("pose")).alias("fit"))
    return poses.metrics(fitted.select(F.col("participant").alias("fold"), poses.joint_errors(F.col("fit"), F.col("pose"), Alignment.NONE).alias("err")), ["fold"]).select("fold", "samples", F.round("mpjpe", 4).alias("pa_mpjpe"))


FOLD_USER = "f AS (SELECT lower(p.participant) AS fold, sample_id, CASE WHEN s.participant = p.participant THEN 'test' ELSE 'train' END AS role FROM s, (SELECT DISTINCT participant FROM s) p)"
SK = "k AS (SELECT *, lower(participant) AS who, lower(participant) || '/' || lower(session) AS skey FROM s)"
FOLD_SESSION = "f AS (SELECT u.skey AS fold, k.sample_id, CASE WHEN k.skey = u.skey THEN 'test' ELSE 'train' END AS role FROM k JOIN (SELECT DISTINCT who, skey FROM k) u ON k.who = u.who JOIN (SELECT who FROM k GROUP BY who HAVING count(DISTINCT skey) >= 2) t ON t.who = k.who)"
FOLD_DEVICE = "f AS (SELECT p.device AS fold, sample_id, CASE WHEN s.device = p.device THEN 'test' ELSE 'train' END AS role FROM s, (SELECT DISTINCT device FROM s) p)"
FOLD_TAIL = "o AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY ts, sample_id) AS pos, count(*) OVER (PARTITION BY skey) AS n FROM k), f AS (SELECT skey AS fold, sample_id, CASE WHEN pos > n - least(n - 1, greatest(1, round_even(n * 0.2::DOUBLE, 0)::BIGINT)) THEN 'test' ELSE 'train' END AS role FROM o WHERE n >= 2)"


@query(f"WITH {S}, {FOLD_USER} SELECT * FROM f")
def fold_assignment_cross_user(spark, d):
    return poses.folds(samples(spark, d), Split.CROSS_USER)


@query(f"WITH {S}, {SK}, {FOLD_SESSION} SELECT * FROM f")
def fold_assignment_cross_session(spark, d):
    return poses.folds(samples(spark, d), Split.CROSS_SESSION)


@query(f"WITH {S}, {FOLD_DEVICE} SELECT * FROM f")
def fold_assignment_cross_device(spark, d):
    return poses.folds(samples(spark, d), Split.CROSS_DEVICE)


@query(f"WITH {S}, {SK}, {FOLD_TAIL} SELECT * FROM f")
def within_session_tail(spark, d):
    return poses.folds(samples(spark, d), Split.WITHIN_SESSION)


def _shared(name: str, key: str) -> str:
    return f"(SELECT count(*) FROM (SELECT {key} FROM g WHERE g.fold = f.fold GROUP BY {key} HAVING count(DISTINCT role) > 1)) AS shared_{name}"


@query(f"WITH {S}, {SK}, {FOLD_SESSION}, g AS (SELECT f.fold, f.role, k.* FROM f JOIN k USING (sample_id)) SELECT DISTINCT fold, {_shared('samples', 'sample_id')}, {_shared('participants', 'who')}, {_shared('sessions', 'skey')}, {_shared('devices', 'device')} FROM f")
def leakage_audit(spark, d):
    s = samples(spark, d)
    return poses.leakage(poses.folds(s, Split.CROSS_SESSION), s)


@query("WITH a AS (SELECT CASE WHEN doc_id % 7 = 0 THEN '  ' || upper(source) || ' ' ELSE source END AS name FROM documents) SELECT lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))) AS key, array_to_string(list_sort(list(DISTINCT name)), '|') AS spellings FROM a WHERE name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT name) > 1")
def identity_alias_audit(spark, d):
    names = table(spark, d, "documents").select(F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("  "), F.upper("source"), F.lit(" "))).otherwise(F.col("source")).alias("name")).where("name IS NOT NULL")
    return poses.aliases(names, "name").select("key", F.array_join("spellings", "|").alias("spellings"))


def _subject_split(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    test = (F.col("session") == "S0") | F.col("participant").isin("P08", "P09")
    return s.where(~test), s.where(test)


SUBJECT = J + ", w AS (SELECT *, session = 'S0' OR participant IN ('P08', 'P09') AS test FROM j), o AS (SELECT participant, joint, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM w WHERE NOT test GROUP BY ALL), a AS (SELECT joint, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM w WHERE NOT test GROUP BY ALL), q AS (SELECT w.sample_id, w.participant, o.x IS NOT NULL AS known, 1000*sqrt((w.x-coalesce(o.x,a.x))**2+(w.y-coalesce(o.y,a.y))**2+(w.z-coalesce(o.z,a.z))**2) AS e FROM w JOIN a USING (joint) LEFT JOIN o ON o.participant = w.participant AND o.joint = w.joint WHERE test)"


@query(f"WITH {SUBJECT} SELECT participant, known, count(DISTINCT sample_id) AS samples, round(avg(e), 4) AS mpjpe FROM q GROUP BY ALL")
def per_subject_mean_pose(spark, d):
    train, test = _subject_split(samples(spark, d))
    errors = poses.subject_means(train, test).select("participant", "known", poses.joint_errors(F.col("mean_pose"), F.col("pose")).alias("err"))
    return rounded(poses.metrics(errors, ["participant", "known"]).select("participant", "known", "samples", "mpjpe"), "mpjpe")


@query(f"WITH {S}, d AS (SELECT t.sample_id, r.sample_id AS nearest_id, round(list_sum(list_transform(range(1, 65), lambda i: (t.e[i] - r.e[i])**2)), 9) AS d2 FROM s t, s r WHERE t.session = 'S0' AND r.session <> 'S0'), m AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY d2, nearest_id) AS k FROM d) SELECT sample_id, nearest_id, round(d2, 6) AS d2 FROM m WHERE k = 1")
def nearest_neighbour_pose(spark, d):
    s = samples(spark, d)
    return rounded(poses.nearest_features(s.where("session <> 'S0'"), s.where("session = 'S0'")), "d2", digits=6)


def baseline_table(spark: SparkSession, d: str) -> DataFrame:
    """(predictor, kind, mpjpe) on a test set of known and unknown people."""
    train, test = _subject_split(samples(spark, d))
    with_means = poses.subject_means(train, test)
    model = F.transform("pose", lambda v, i: v * 0.9 + i * 0.002)
    overall = poses.vector_sums(train, []).select(poses.mean_vector(F.col("sums"), F.col("n")).alias("overall"))
    rows = with_means.join(F.broadcast(overall), F.lit(True)).select(F.explode(F.array(*[F.struct(F.lit(n).alias("predictor"), F.lit(k).alias("kind"), p.alias("p")) for n, k, p in (("affine", "model", model), ("mean-pose", "baseline", F.col("overall")), ("subject-mean", "baseline", F.col("mean_pose")))])).alias("x"), "pose")
    return poses.metrics(rows.select("x.predictor", "x.kind", poses.joint_errors(F.col("x.p"), F.col("pose")).alias("err")), ["predictor", "kind"]).select("predictor", "kind", "mpjpe")


BASE = SUBJECT + ", mm AS (SELECT 1000*sqrt((w.x*0.1::DOUBLE-(joint*3-0)*0.002::DOUBLE)**2+(w.y*0.1::DOUBLE-(joint*3)*0.002::DOUBLE)**2+(w.z*0.1::DOUBLE-(joint*3)*0.002::DOUBLE)**2) AS e FROM w WHERE test), gg AS (SELECT 1000*sqrt((w.x-a.x)**2+(w.y-a.y)**2+(w.z-a.z)**2) AS e FROM w JOIN a USING (joint) WHERE test), t AS (SELECT 'affine' AS predictor, 'model' AS kind, avg(e) AS mpjpe FROM mm UNION ALL SELECT 'mean-pose', 'baseline', avg(e) FROM gg UNION ALL SELECT 'subject-mean', 'baseline', avg(e) FROM q)"


@query(f"WITH {BASE}, b AS (SELECT min(mpjpe) AS best FROM t WHERE kind = 'model') SELECT predictor, round(mpjpe, 4) AS mpjpe, best < 0.9 * mpjpe AS beaten FROM t, b WHERE kind = 'baseline'")
def beaten_baselines(spark, d):
    t = baseline_table(spark, d)
    best = t.where("kind = 'model'").agg(F.min("mpjpe").alias("best"))
    return t.where("kind = 'baseline'").join(F.broadcast(best), F.lit(True)).select("predictor", F.round("mpjpe", 4).alias("mpjpe"), (F.col("best") < 0.9 * F.col("mpjpe")).alias("beaten"))


BUDGETS = [0.0, 1.0, 2.0, 20.0]
#: Training: people but one in session S0; test: the last person's S2; the pool is what is left of that person.
CAL_FOLD = "CASE WHEN participant = 'P00' AND session = 'S2' THEN 'test' WHEN participant <> 'P00' AND session = 'S0' THEN 'train' END"


def calibration_rows(spark: SparkSession, d: str) -> DataFrame:
    s = samples(spark, d)
    folded = s.select(F.lit("p00").alias("fold"), "sample_id", F.expr(CAL_FOLD).alias("role")).where("role IS NOT NULL")
    whole = poses.calibration(s, folded, BUDGETS, 6.0)
    taken = whole.select("budget", "participant", "sample_id")
    budgets = spark.createDataFrame([(b,) for b in BUDGETS], "budget double")
    base = folded.where("role = 'train'").select("sample_id").join(budgets, F.lit(True))
    train = base.select("budget", "sample_id").unionByName(taken.select("budget", "sample_id")).join(s, "sample_id")
    means = poses.vector_sums(train, ["budget"]).select("budget", poses.mean_vector(F.col("sums"), F.col("n")).alias("mean_pose"))
    test = folded.where("role = 'test'").select("sample_id").join(s, "sample_id").join(F.broadcast(means), F.lit(True))
    errors = test.select("budget", poses.joint_errors(F.col("mean_pose"), F.col("pose")).alias("err"))
    return poses.metrics(errors, ["budget"]).join(poses.achieved(s, folded, whole, BUDGETS, 6.0), "budget").select("budget", "achieved", "truncated", "mpjpe")


CAL = J + f", r AS (SELECT *, {CAL_FOLD} AS role FROM s), p AS (SELECT sample_id, row_number() OVER (ORDER BY ts, sample_id) AS rank FROM r WHERE role IS NULL AND participant = 'P00'), b AS (SELECT unnest([0, 1, 2, 20])::DOUBLE AS budget), w AS (SELECT budget, round_even(budget * 10, 0)::BIGINT AS wanted FROM b), t AS (SELECT budget, sample_id FROM r, b WHERE role = 'train' UNION ALL SELECT budget, sample_id FROM p JOIN w ON rank <= wanted), m AS (SELECT budget, joint, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM t JOIN j USING (sample_id) GROUP BY ALL), g AS (SELECT w.budget, wanted, count(p.sample_id) AS got FROM w LEFT JOIN p ON rank <= wanted GROUP BY ALL), c AS (SELECT m.budget, avg(1000*sqrt((j.x-m.x)**2+(j.y-m.y)**2+(j.z-m.z)**2)) AS mpjpe FROM r JOIN j USING (sample_id) JOIN m ON m.joint = j.joint WHERE role = 'test' GROUP BY m.budget)"


@query(f"WITH {CAL} SELECT budget, got * 6.0::DOUBLE / 60 AS achieved, got < wanted AS truncated, round(mpjpe, 4) AS mpjpe FROM c JOIN g USING (budget)")
def calibration_curve(spark, d):
    return rounded(calibration_rows(spark, d), "mpjpe")


@query(f"WITH {CAL}, l AS (SELECT *, lag(mpjpe) OVER (ORDER BY budget) AS before FROM c) SELECT round(max(CASE WHEN budget = 0 THEN mpjpe END) - min(mpjpe), 4) AS gain, arg_min(budget, mpjpe) AS best_budget, bool_and(before IS NULL OR mpjpe <= before + 1e-9) AS monotone FROM l")
def calibration_gain(spark, d):
    c = calibration_rows(spark, d).withColumn("before", F.lag("mpjpe").over(Window.orderBy("budget")))
    return c.agg(F.round(F.max(F.when(F.col("budget") == 0, F.col("mpjpe"))) - F.min("mpjpe"), 4).alias("gain"), F.min_by("budget", F.struct("mpjpe", "budget")).alias("best_budget"), F.bool_and(F.col("before").isNull() | (F.col("mpjpe") <= F.col("before") + 1e-9)).alias("monotone"))


@query(f"WITH {S}, c AS (SELECT participant, count(*) AS n, min(sample_id) AS first FROM s WHERE session = 'S0' GROUP BY participant), t AS (SELECT sum(n)::BIGINT AS total FROM c) SELECT participant, n, total, round(n / total, 6) AS share, n / total <= 0.5 AS passed FROM c, t ORDER BY n DESC, first LIMIT 1")
def guard_concentration(spark, d):
    return rounded(poses.concentration(samples(spark, d).where("session = 'S0'")), "share", digits=6)


LM = S + ", j AS (SELECT sample_id, participant, k AS joint, e[3*k+1] AS x, e[3*k+2] AS y, e[3*k+3] AS z FROM s, (SELECT unnest(range(21)) AS k)), p AS (SELECT participant, joint, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM j WHERE participant <> 'P00' GROUP BY ALL), t AS (SELECT joint, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM j WHERE participant = 'P00' GROUP BY ALL), b AS (SELECT a.participant, c.participant AS q, avg(sqrt((a.x-c.x)**2+(a.y-c.y)**2+(a.z-c.z)**2)) AS d FROM p a JOIN p c ON a.participant < c.participant AND a.joint = c.joint GROUP BY ALL), n AS (SELECT participant, avg(sqrt((p.x-t.x)**2+(p.y-t.y)**2+(p.z-t.z)**2)) AS d FROM p JOIN t USING (joint) GROUP BY participant), m AS (SELECT median(d) AS typical FROM b)"


@query(f"WITH {LM} SELECT participant AS nearest, round(d, 6) AS distance, round(typical, 6) AS typical, round(d / typical, 6) AS ratio, d / typical > 0.2 AS passed FROM n, m ORDER BY d, participant LIMIT 1")
def guard_label_match(spark, d):
    s = samples(spark, d)
    return rounded(poses.label_match(s.where("participant <> 'P00'"), s.where("participant = 'P00'")), "distance", "typical", "ratio", digits=6)


@query(f"WITH {E}, c AS (SELECT participant || '/' || session AS cluster, avg(e) AS m FROM err GROUP BY 1), a AS (SELECT count(*) AS clusters, avg(m) AS mean, stddev_samp(m) / sqrt(count(*)) AS sem FROM c) SELECT clusters, round(mean, 4) AS mean, round(sem, 4) AS sem, (CASE WHEN sem > 0 THEN floor(-log10(2 * sem)) ELSE 2 END)::INT AS decimals, clusters >= 5 AND 2 <= (CASE WHEN sem > 0 THEN floor(-log10(2 * sem)) ELSE 2 END) AS passed FROM a")
def guard_evaluation_size(spark, d):
    errors = louo_errors(spark, d).select(F.concat_ws("/", "participant", "session").alias("cluster"), poses.mean_of(F.col("err")).alias("error"))
    return rounded(poses.evaluation_size(errors, "cluster", 5), "mean", "sem")


def _family(unit: str, split: str) -> str:
    return f"SELECT '{split}' AS split, avg(1000*sqrt((j.x-m.x)**2+(j.y-m.y)**2+(j.z-m.z)**2)) AS mpjpe, count(DISTINCT j.sample_id) AS samples FROM j JOIN (SELECT p.u AS u, joint, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM j JOIN (SELECT DISTINCT {unit} AS u FROM j) p ON {unit} <> p.u GROUP BY ALL) m ON m.u = {unit} AND m.joint = j.joint"


SUITE = f"WITH {J}, c AS ({_family('participant', 'CROSS_USER')} UNION ALL {_family('device', 'CROSS_DEVICE')}), x AS (SELECT participant, session, joint, sum(x) AS x, sum(y) AS y, sum(z) AS z, count(*) AS n FROM j GROUP BY ALL), y AS (SELECT a.participant, a.session, a.joint, sum(b.x)/sum(b.n) AS x, sum(b.y)/sum(b.n) AS y, sum(b.z)/sum(b.n) AS z FROM x a JOIN x b ON a.participant = b.participant AND a.joint = b.joint AND a.session <> b.session GROUP BY ALL), v AS (SELECT 'CROSS_SESSION' AS split, avg(1000*sqrt((j.x-y.x)**2+(j.y-y.y)**2+(j.z-y.z)**2)) AS mpjpe, count(DISTINCT j.sample_id) AS samples FROM j JOIN y USING (participant, session, joint)) SELECT split, samples, round(mpjpe, 4) AS mpjpe FROM (SELECT * FROM c UNION ALL SELECT * FROM v)"


@query(SUITE)
def suite_leaderboard(spark, d):
    """The mean-pose baseline under each honest family of splits, refitted in every fold."""
    s = samples(spark, d)
    out = None
    for split, unit, within in ((Split.CROSS_SESSION, "session", ["participant"]), (Split.CROSS_USER, "participant", []), (Split.CROSS_DEVICE, "device", [])):
        met = s.join(poses.left_out_means(s, unit, within), [*within, unit])
        part = poses.metrics(met.select(F.lit(split.name).alias("split"), poses.joint_errors(F.col("mean_pose"), F.col("pose")).alias("err")), ["split"]).select("split", "samples", F.round("mpjpe", 4).alias("mpjpe"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH t AS ({SUITE}), x AS (SELECT unnest(['WITHIN_SESSION', 'CROSS_SESSION', 'CROSS_USER', 'CROSS_DEVICE']) AS split, unnest(range(4))::INT AS strength) SELECT x.split, strength, coalesce(samples, 0) AS samples, CASE WHEN mpjpe IS NULL THEN 'NOT MEASURED' ELSE 'measured' END AS status FROM x LEFT JOIN t USING (split)")
def split_suite_comparison(spark, d):
    kinds = spark.createDataFrame([(s.name, int(s)) for s in Split], "split string, strength int")
    return kinds.join(suite_leaderboard(spark, d), "split", "left").select("split", "strength", F.coalesce("samples", F.lit(0)).alias("samples"), F.when(F.col("mpjpe").isNull(), "NOT MEASURED").otherwise("measured").alias("status"))


@query(f"WITH t AS ({SUITE}) SELECT unnest(list_filter([CASE WHEN count(*) = 0 THEN 'no rows' END, CASE WHEN count(*) FILTER (split <> 'WITHIN_SESSION') < 3 THEN 'honest splits are missing' END, 'no model beside the baselines'], lambda x: x IS NOT NULL)) AS reason FROM t")
def refusal_reasons(spark, d):
    t = suite_leaderboard(spark, d).agg(F.count("*").alias("n"), F.count(F.when(F.col("split") != "WITHIN_SESSION", 1)).alias("honest"))
    return t.select(F.explode(F.array_compact(F.array(F.when(F.col("n") == 0, "no rows"), F.when(F.col("honest") < 3, "honest splits are missing"), F.lit("no model beside the baselines")))).alias("reason"))


@query(f"WITH {J}, a AS (SELECT joint, avg(x) AS mean_x, stddev_pop(x) AS sd_x, avg(z) AS mean_z, stddev_pop(z) AS sd_z FROM j GROUP BY joint) SELECT joint::INT AS joint, round(mean_x, 6) AS mean_x, round(greatest(sd_x, 1e-6), 6) AS sd_x, round(mean_z, 6) AS mean_z, round(greatest(sd_z, 1e-6), 6) AS sd_z FROM a")
def pose_normalizer_stats(spark, d):
    s = samples(spark, d).select(poses.wrist_relative(F.col("pose")).alias("p"))
    wide = s.agg(F.array(*[F.struct(F.lit(j).alias("joint"), F.avg(F.col("p")[3 * j]).alias("mean_x"), F.greatest(F.stddev_pop(F.col("p")[3 * j]), F.lit(1e-6)).alias("sd_x"), F.avg(F.col("p")[3 * j + 2]).alias("mean_z"), F.greatest(F.stddev_pop(F.col("p")[3 * j + 2]), F.lit(1e-6)).alias("sd_z")) for j in range(21)]).alias("a"))
    return rounded(wide.select(F.explode("a").alias("r")).select("r.*"), "mean_x", "sd_x", "mean_z", "sd_z", digits=6)


@query("WITH v AS (SELECT k % 2 AS channel, embedding[k + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS k) WHERE embedding IS NOT NULL) SELECT channel::INT AS channel, round(avg(v), 6) AS mean, round(greatest(stddev_pop(v), 1e-6), 6) AS sd FROM v GROUP BY channel")
def feature_normalizer_stats(spark, d):
    e = table(spark, d, "embeddings").where("embedding IS NOT NULL").select(F.posexplode("embedding").alias("k", "v"))
    return rounded(e.groupBy((F.col("k") % 2).alias("channel")).agg(F.avg(F.col("v").cast("double")).alias("mean"), F.greatest(F.stddev_pop(F.col("v").cast("double")), F.lit(1e-6)).alias("sd")), "mean", "sd", digits=6)


@query("SELECT c_custkey, 'study' || (c_custkey % 4 + 1) || '/sub' || (c_custkey % 40 + 1) AS person FROM customer")
def study_participants(spark, d):
    return table(spark, d, "customer").select("c_custkey", poses.study_participant(F.col("c_custkey") % 4 + 1, F.col("c_custkey") % 40 + 1).alias("person"))


@query(f"WITH {J}, a AS (SELECT joint, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS sd FROM j GROUP BY joint) SELECT sample_id, round(sum((x - m) / sd), 4) AS total FROM j JOIN a USING (joint) GROUP BY sample_id")
def standardised_poses(spark, d):
    s = samples(spark, d).select("sample_id", F.filter(poses.wrist_relative(F.col("pose")), lambda v, i: i % 3 == 0).alias("p"))
    stats = s.agg(F.array(*[F.avg(F.col("p")[j]) for j in range(21)]).alias("m"), F.array(*[F.greatest(F.stddev_pop(F.col("p")[j]), F.lit(1e-6)) for j in range(21)]).alias("sd"))
    met = s.join(F.broadcast(stats), F.lit(True))  # one row
    return met.select("sample_id", F.round(F.aggregate(poses.standardise(F.col("p"), F.col("m"), F.col("sd")), F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


#: Leaves of a tree of hashes and, beyond 1,024 rows, the level above them; enough for four million rows.
LEAVES = "CASE WHEN n > 1024 THEN substr(h, 1, 3) ELSE '' END AS b, any_value(n) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h"
TOP = "CASE WHEN any_value(n) > 1024 THEN sha256(string_agg(b || h, '' ORDER BY b)) ELSE any_value(h) END"


@query(f"WITH {S}, h AS (SELECT count(*) OVER () AS n, sha256(concat_ws(',', sample_id::VARCHAR, array_to_string(list_transform(e[1:63], lambda v: round(v * 1000000000)::BIGINT::VARCHAR), ','))) AS h FROM s), p AS (SELECT {LEAVES} FROM h GROUP BY b) SELECT any_value(n) AS rows, {TOP} AS digest FROM p")
def prediction_digest(spark, d):
    return poses.digest(samples(spark, d).select("sample_id", "pose"))


@query(f"WITH {S} SELECT device, count(*) AS n, count(DISTINCT lower(participant)) AS people, count(DISTINCT lower(participant) || '/' || lower(session)) AS sessions FROM s GROUP BY device")
def units_by_device(spark, d):
    s = samples(spark, d)
    return s.groupBy("device").agg(F.count("*").alias("n"), F.countDistinct(poses.identity(F.col("participant"))).alias("people"), F.countDistinct(poses.session_key(F.col("participant"), F.col("session"))).alias("sessions"))


@query(f"WITH {S}, t AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, sample_id) - 1 AS r, count(*) OVER (PARTITION BY session) AS n FROM s) SELECT session, (r * least(n, 10) // n)::INT AS time_block, count(*) AS n FROM t GROUP BY ALL")
def time_blocks(spark, d):
    return poses.time_blocks(samples(spark, d)).groupBy("session", "time_block").agg(F.count("*").alias("n"))


# Signals: the recording of events

SMALL = Chirp(1000.0, 3000.0, 0.00625, 8000)


def _direct_filter() -> str:
    """Correlation with the analytic reference, lag by lag, as SQL over frames fr(frame_id, x)."""
    z = dsp.analytic(dsp.reference(SMALL))
    listed = lambda part: "[" + ", ".join(f"{v!r}::DOUBLE" for v in part.tolist()) + "]"
    total = lambda name: f"list_sum(list_transform(range(1, 51 - k), lambda i: x[k + i] * {name}[i]))"
    return f"z AS (SELECT {listed(z.real)} AS re, {listed(z.imag)} AS im), y AS (SELECT frame_id, list_transform(range(0, 50), lambda k: sqrt(pow({total('re')}, 2) + pow({total('im')}, 2)) / {float((z.real**2).sum())!r}) AS y FROM fr, z)"


FILTERED = f"WITH r AS (SELECT event_id AS pos, coalesce(value, 0) AS value FROM events), fr AS (SELECT pos // 50 AS frame_id, list(value ORDER BY pos) AS x FROM r GROUP BY 1 HAVING count(*) = 50), {_direct_filter()}"


@query(f"{FILTERED} SELECT frame_id, round(frame_id * 0.00625::DOUBLE, 6) AS timestamp_s, round(list_max(y)::FLOAT::DOUBLE, 3) AS top FROM y")
def recording_profiles(spark, d):
    p = dsp.profiles(recording(spark, d), ["rec"], SMALL)
    return p.select("frame_id", F.round("timestamp_s", 6).alias("timestamp_s"), F.round(F.array_max("samples").cast("double"), 3).alias("top"))


def recording(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.lit("r").alias("rec"), F.col("event_id").alias("pos"), F.coalesce("value", F.lit(0.0)).alias("value"))


def framed(spark: SparkSession, d: str) -> DataFrame:
    return fr.segment(recording(spark, d), ["rec"], 50)


R = "r AS (SELECT event_id AS pos, coalesce(value, 0) AS value FROM events), fr AS (SELECT pos // 50 AS frame_id, list(value ORDER BY pos) AS x FROM r GROUP BY 1 HAVING count(*) = 50)"


@query(f"WITH {R} SELECT frame_id, round(list_sum(x), 4) AS total, round(x[1], 6) AS first, round(x[50], 6) AS last FROM fr")
def segment_frames(spark, d):
    return framed(spark, d).select("frame_id", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.round(F.col("samples")[0], 6).alias("first"), F.round(F.col("samples")[49], 6).alias("last"))


@query("WITH r AS (SELECT event_id AS pos, coalesce(value, 0) AS value FROM events), f AS (SELECT g AS frame_id, list(value ORDER BY pos) AS x FROM r, range(0, (SELECT max(pos) // 20 + 1 FROM r)) t(g) WHERE pos >= g * 20 AND pos < g * 20 + 50 GROUP BY g HAVING count(*) = 50) SELECT frame_id, round(list_sum(x), 4) AS total, round(x[1], 6) AS first FROM f")
def segment_frames_overlapping(spark, d):
    return fr.segment(recording(spark, d), ["rec"], 50, 20).select("frame_id", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.round(F.col("samples")[0], 6).alias("first"))


REF = [1.0, -0.5, 0.25, 0.5, -1.0]
REF_SQL = "[" + ", ".join(f"{v}::DOUBLE" for v in REF) + "]"


@query(f"WITH {R}, c AS (SELECT frame_id, list_transform(range(0, 46), lambda k: list_sum(list_transform(range(1, 6), lambda m: x[k + m] * {REF_SQL}[m])) / {sum(v * v for v in REF)}) AS y FROM fr) SELECT frame_id, round(list_sum(list_transform(y, lambda v: abs(v))), 4) AS energy, round(list_max(y), 4) AS top FROM c")
def matched_filter_direct(spark, d):
    ref = F.array(*map(F.lit, REF))
    y = F.transform(F.sequence(F.lit(0), F.lit(45)), lambda k: F.aggregate(F.zip_with(F.slice("samples", k + 1, 5), ref, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v) / sum(v * v for v in REF))
    out = framed(spark, d).select("frame_id", y.alias("y"))
    return out.select("frame_id", F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + F.abs(v)), 4).alias("energy"), F.round(F.array_max("y"), 4).alias("top"))


@query(f"{FILTERED} SELECT frame_id, round(list_max(y), 4) AS top, (list_position(y, list_max(y)) - 1)::BIGINT AS bin FROM y")
def matched_filter_envelope(spark, d):
    y = framed(spark, d).select("frame_id", dsp.matched_filter_column(F.col("samples"), SMALL).alias("y"))
    return y.select("frame_id", F.round(F.array_max("y"), 4).alias("top"), (F.array_position("y", F.array_max("y")) - 1).alias("bin"))


def _normalised(spark: SparkSession, d: str, kind: Normalisation) -> DataFrame:
    return framed(spark, d).select("frame_id", fr.normalise(F.col("samples"), kind).alias("y")).select("frame_id", F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.round(F.array_max("y"), 6).alias("top"))


@query(f"WITH {R}, p AS (SELECT frame_id, x, list_max(list_transform(x, lambda v: abs(v))) AS m FROM fr), y AS (SELECT frame_id, CASE WHEN m > 0 THEN list_transform(x, lambda v: v / m) ELSE x END AS y FROM p) SELECT frame_id, round(list_sum(y), 4) AS total, round(list_max(y), 6) AS top FROM y")
def profile_normalise_peak(spark, d):
    return _normalised(spark, d, Normalisation.PEAK)


@query(f"WITH {R}, p AS (SELECT frame_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS m FROM fr), y AS (SELECT frame_id, CASE WHEN m > 0 THEN list_transform(x, lambda v: v / m) ELSE x END AS y FROM p) SELECT frame_id, round(list_sum(y), 4) AS total, round(list_max(y), 6) AS top FROM y")
def profile_normalise_l2(spark, d):
    return _normalised(spark, d, Normalisation.L2)


@query(f"WITH {R}, l AS (SELECT frame_id, x, lag(x) OVER (ORDER BY frame_id) AS b FROM fr) SELECT frame_id, round(list_sum(list_transform(range(1, 51), lambda i: abs(x[i] - b[i]))), 4) AS change, round(x[1] - b[1], 6) AS first FROM l WHERE b IS NOT NULL")
def differential_profiles(spark, d):
    return fr.differences(framed(spark, d), ["rec"], "frame_id").select("frame_id", F.round(F.aggregate("samples", F.lit(0.0), lambda a, v: a + F.abs(v)), 4).alias("change"), F.round(F.col("samples")[0], 6).alias("first"))


BIN = SPEED_OF_SOUND / (2 * 48000)


@query(f"WITH {R}, c AS (SELECT frame_id, x[{int(0.02 / BIN) + 1}:{int(0.12 / BIN)}] AS y FROM fr) SELECT frame_id, len(y)::INT AS bins, round({int(0.02 / BIN)} * {BIN!r}::DOUBLE, 9) AS offset_m, round(list_sum(y), 4) AS total FROM c")
def crop_profile(spark, d):
    part, offset = fr.crop(F.col("samples"), 0.02, 0.12, BIN)
    return framed(spark, d).select("frame_id", part.alias("y"), offset.alias("o")).select("frame_id", F.size("y").alias("bins"), F.round("o", 9).alias("offset_m"), F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


FLOOR = "1.1774100225154747::DOUBLE / sqrt(-2 * ln(0.9::DOUBLE))"


@query(f"WITH {R} SELECT frame_id, round(least(quantile_cont(v, 0.1) * {FLOOR}, max(v)), 6) AS floor FROM (SELECT frame_id, abs(unnest(x)) AS v FROM fr) GROUP BY frame_id")
def noise_floor(spark, d):
    values = framed(spark, d).select("frame_id", F.size("samples").alias("n"), F.posexplode("samples").alias("bin", "value"))
    return rounded(fr.noise_floor(values, ["frame_id"]), "floor", digits=6)


PEAK = R + ", p AS (SELECT frame_id, x, list_position(x, list_max(x)) AS i FROM fr), q AS (SELECT *, i > 1 AND i < 50 AS inner_, ln(greatest(x[i - 1], 1e-300)) AS l, ln(greatest(x[i], 1e-300)) AS c, ln(greatest(x[i + 1], 1e-300)) AS r FROM p), o AS (SELECT *, CASE WHEN inner_ AND l - 2 * c + r < 0 THEN greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * c + r))) ELSE 0 END AS delta FROM q)"


@query(f"WITH {PEAK} SELECT frame_id, (i - 1)::INT AS bin, round(((i - 1) + delta) * {BIN!r}::DOUBLE, 6) AS range_m, round(CASE WHEN inner_ THEN exp(c - 0.25 * (l - r) * delta) ELSE list_max(x) END, 4) AS amplitude FROM o")
def strongest_peak_subbin(spark, d):
    return fr.strongest_peak(framed(spark, d), BIN).select("frame_id", "bin", F.round("range_m", 6).alias("range_m"), F.round("amplitude", 4).alias("amplitude"))


PEAKS = f"""WITH {R}, f AS (SELECT frame_id, x, list_max(x) AS top, least(list_aggregate(list_transform(x, lambda v: abs(v)), 'quantile_cont', 0.1) * {FLOOR}, list_max(list_transform(x, lambda v: abs(v)))) AS floor FROM fr),
b AS (SELECT frame_id, unnest(range(52)) AS k, unnest(list_concat([0.0::DOUBLE], x, [0.0::DOUBLE])) AS v FROM f WHERE top > 0),
c AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY frame_id ORDER BY k) THEN 0 ELSE 1 END AS turn FROM b),
u AS (SELECT frame_id, run, any_value(v) AS level, min(k) AS first, max(k) AS last FROM (SELECT *, sum(turn) OVER (PARTITION BY frame_id ORDER BY k) AS run FROM c) GROUP BY frame_id, run),
n AS (SELECT *, lag(level) OVER w AS before, lead(level) OVER w AS after FROM u WINDOW w AS (PARTITION BY frame_id ORDER BY run)),
t AS (SELECT n.frame_id, run, level, (first + last) // 2 - 1 AS i, top, floor, x FROM n JOIN f USING (frame_id) WHERE level > before AND level > after AND (floor <= 0 OR level >= 4 * floor)),
g AS (SELECT t.frame_id, t.run, coalesce(max(CASE WHEN u.run < t.run AND u.level > t.level THEN u.run END), -1) AS l, coalesce(min(CASE WHEN u.run > t.run AND u.level > t.level THEN u.run END), 1000) AS h FROM t JOIN u USING (frame_id) GROUP BY t.frame_id, t.run),
p AS (SELECT t.frame_id, t.i, t.x, t.level - greatest(min(CASE WHEN u.run > g.l AND u.run <= t.run THEN u.level END), min(CASE WHEN u.run >= t.run AND u.run < g.h THEN u.level END)) AS prominence, any_value(t.top) AS top FROM t JOIN g USING (frame_id, run) JOIN u ON u.frame_id = t.frame_id GROUP BY t.frame_id, t.run, t.i, t.x, t.level),
o AS (SELECT frame_id, i, x, i > 0 AND i < 49 AS inside, ln(greatest(x[i], 1e-300)) AS a, ln(greatest(x[i + 1], 1e-300)) AS b, ln(greatest(x[i + 2], 1e-300)) AS c FROM p WHERE prominence >= 0.3 * top),
s AS (SELECT *, CASE WHEN inside AND a - 2 * b + c < 0 THEN greatest(-0.5, least(0.5, 0.5 * (a - c) / (a - 2 * b + c))) ELSE 0 END AS delta FROM o)
SELECT frame_id, i::INT AS bin_index, round((i + delta) * {BIN!r}::DOUBLE, 6) AS range_m, round(CASE WHEN inside THEN exp(b - 0.25 * (a - c) * delta) ELSE x[i + 1] END, 4) AS amplitude FROM s"""


@query(PEAKS)
def peak_list(spark, d):
    found = framed(spark, d).select("frame_id", F.explode(dsp.peaks_column(F.col("samples"), BIN)).alias("p"))
    return found.select("frame_id", "p.bin_index", F.round("p.range_m", 6).alias("range_m"), F.round("p.amplitude", 4).alias("amplitude"))


@query(f"WITH {R}, m AS (SELECT bin, median(abs(v)) AS m FROM (SELECT unnest(range(50)) AS bin, unnest(x) AS v FROM fr) WHERE bin < 40 GROUP BY bin) SELECT bin::INT AS bin_offset FROM m ORDER BY m DESC, bin LIMIT 1")
def bin_zero_offset(spark, d):
    values = framed(spark, d).select("rec", F.posexplode("samples").alias("bin", "value"))
    return fr.bin_zero(values, ["rec"]).select(F.col("offset").alias("bin_offset"))


def _lag_sql(lag: int) -> str:
    return f"SELECT {lag} AS lag, sqrt(sum(((y.v - z.v) - (a.v - b.v))**2)) / sqrt(sum((y.v - z.v)**2)) AS residual FROM v y JOIN v z ON z.f = y.f - 1 AND z.bin = y.bin AND y.f BETWEEN 2 AND 257 JOIN v a ON a.f = y.f - 2 + {lag} AND a.bin = y.bin JOIN v b ON b.f = a.f - 1 AND b.bin = y.bin"


@query(f"WITH {R}, v AS (SELECT frame_id AS f, unnest(range(50)) AS bin, unnest(x) AS v FROM fr WHERE frame_id < 264), l AS (" + " UNION ALL ".join(_lag_sql(k) for k in range(1, 5)) + ") SELECT lag::INT AS lag, round(residual, 6) AS residual, residual <= 1e-3 AS matches FROM l")
def differential_lag(spark, d):
    """Measured on the first columns of a session; changes from frame to frame, without the first, stand for the stored ones."""
    some = framed(spark, d)
    values = some.select(F.col("frame_id").alias("frame"), F.posexplode("samples").alias("bin", "value"))
    stored = fr.differences(some, ["rec"], "frame_id").where("frame_id >= 2")
    diffs = stored.select((F.col("frame_id") - 2).alias("frame"), F.posexplode("samples").alias("bin", "d"))
    return rounded(fr.measured_lag(values, diffs), "residual", digits=6)


@query(f"WITH {R}, a AS (SELECT frame_id, list_transform(x, lambda v: v::FLOAT) AS x FROM fr), b AS (SELECT frame_id, x, lag(x, 1) OVER (ORDER BY frame_id) AS p, row_number() OVER (ORDER BY frame_id) - 1 AS pos FROM a), c AS (SELECT frame_id, pos, x, list_transform(range(1, 51), lambda i: x[i] - p[i]) AS dx FROM b WHERE p IS NOT NULL), w AS (SELECT frame_id, pos, list_concat(flatten(list(x) OVER o), flatten(list(dx) OVER o)) AS w, count(*) OVER o AS n FROM c WINDOW o AS (ORDER BY frame_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)), k AS (SELECT frame_id, w, list_max(list_transform(w, lambda v: abs(v))) AS m FROM w WHERE n = 8 AND (pos - 8) % 3 = 0) SELECT frame_id, len(w)::INT AS size, round(list_sum(list_transform(w, lambda v: (v / m)::DOUBLE)), 2) AS total, round((w[800] / m)::DOUBLE, 4) AS last FROM k WHERE m > 0")
def causal_windows(spark, d):
    w = fr.causal_windows(framed(spark, d), ["rec"], "frame_id", 8, 3)
    return w.select("frame_id", F.size("window").alias("size"), F.round(F.aggregate("window", F.lit(0.0), lambda a, v: a + v), 2).alias("total"), F.round(F.col("window")[799].cast("double"), 4).alias("last"))


@query("SELECT p.event_id, v.event_id AS label_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts")
def asof_labels(spark, d):
    e = table(spark, d, "events")
    labels = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("label_id"))
    return fr.as_of(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), labels, ["user_id"], "ts", "label_id").select("event_id", "label_id")


@query("WITH e AS (SELECT *, epoch(ts)::DOUBLE AS t FROM events), i AS (SELECT user_id, event_id AS label, t AS a, t + 21600 AS b FROM e WHERE event_type = 'signup'), m AS (SELECT e.event_id, i.label, row_number() OVER (PARTITION BY e.event_id ORDER BY i.a, i.label) AS k FROM e JOIN i ON e.user_id = i.user_id AND e.t >= i.a AND e.t < i.b WHERE e.event_type = 'click') SELECT event_id, label FROM m WHERE k = 1")
def gesture_at_time(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    spans = e.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("label"), F.col("t").alias("start_s"), (F.col("t") + 21600).alias("end_s"))
    return fr.stab(e.where("event_type = 'click'").select("event_id", "user_id", "t"), spans, ["user_id"], "t", 21600).select("event_id", "label")


@query("WITH a AS (SELECT event_id, event_id * 0.0331::DOUBLE AS t FROM events), b AS (SELECT event_id, t, round_even(((t - 1.25) * 48000 + 1234) / 600, 0)::BIGINT AS frame FROM a) SELECT event_id, frame, round((frame * 600 - 1234) / 48000 + 1.25, 6) AS back FROM b")
def sync_index_round_trip(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * 0.0331).alias("t"))
    b = e.withColumn("frame", fr.sync_frame(F.col("t"), F.lit(1.25), F.lit(1234), 48000, 600))
    return b.select("event_id", "frame", F.round(fr.sync_time(F.col("frame"), F.lit(1.25), F.lit(1234), 48000, 600), 6).alias("back"))


@query("WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment FROM g) SELECT user_id, segment::BIGINT AS segment, count(*) AS n, min(event_id) AS first FROM s GROUP BY ALL")
def gap_segments(spark, d):
    e = table(spark, d, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return fr.gap_segments(e, ["user_id"], "t", "event_id", 12 * 3600).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


@query("WITH a AS (SELECT user_id, event_id, epoch(ts)::DOUBLE AS t, (event_id % 97 + 1) AS size FROM events), b AS (SELECT user_id, event_id, t - first(t) OVER w AS span, coalesce(sum(size) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)) SELECT event_id, round(before / span, 9) AS rate FROM b WHERE span >= 2")
def observed_sample_rate(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), (F.col("event_id") % 97 + 1).alias("size"))
    w = Window.partitionBy("user_id").orderBy("t", "event_id")
    b = e.withColumn("span", F.col("t") - F.first("t").over(w)).withColumn("before", F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return b.where("span >= 2").select("event_id", F.round(F.col("before") / F.col("span"), 9).alias("rate"))


# Impulses and the channel


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").where("quality IS NOT NULL AND toxic IS NOT NULL")


CM = "c AS (SELECT quality AS true_label, toxic AS pred_label, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), cm AS (SELECT t.true_label, p.pred_label, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT true_label FROM c) t CROSS JOIN (SELECT DISTINCT pred_label FROM c) p LEFT JOIN c USING (true_label, pred_label))"
MI = CM + ", pr AS (SELECT *, n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY true_label) / sum(n) OVER () AS a, sum(n) OVER (PARTITION BY pred_label) / sum(n) OVER () AS b FROM cm)"


@query(f"WITH {CM} SELECT * FROM cm")
def confusion_matrix(spark, d):
    return clap.confusion(_pairs(spark, d), "quality", "toxic")


@query(f"WITH {CM} SELECT round(sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) / sum(n), 9) AS accuracy FROM cm")
def classification_accuracy(spark, d):
    return clap.capacity(clap.confusion(_pairs(spark, d), "quality", "toxic")).select(F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {MI} SELECT round(greatest(0, sum(CASE WHEN n > 0 THEN p * log2(p / (a * b)) ELSE 0 END)), 9) AS bits FROM pr")
def mutual_information_bits(spark, d):
    return clap.capacity(clap.confusion(_pairs(spark, d), "quality", "toxic")).select(F.round("bits", 9).alias("bits"))


@query("WITH c AS (SELECT l_returnflag AS true_label, l_linestatus AS pred_label, count(*) AS n FROM lineitem GROUP BY ALL), cm AS (SELECT t.true_label, p.pred_label, coalesce(n, 0)::BIGINT AS n FROM (SELECT DISTINCT true_label FROM c) t CROSS JOIN (SELECT DISTINCT pred_label FROM c) p LEFT JOIN c USING (true_label, pred_label)), pr AS (SELECT *, n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY true_label) / sum(n) OVER () AS a, sum(n) OVER (PARTITION BY pred_label) / sum(n) OVER () AS b FROM cm), o AS (SELECT sum(CASE WHEN n > 0 THEN p * log2(p / (a * b)) ELSE 0 END) AS bits, -sum(CASE WHEN n > 0 THEN p * log2(a) ELSE 0 END) AS h_true, -sum(CASE WHEN n > 0 THEN p * log2(b) ELSE 0 END) AS h_pred, log2(count(DISTINCT true_label)) AS ceiling, sum(n)::BIGINT AS samples FROM pr) SELECT round(bits, 6) AS bits, round(h_true, 6) AS h_true, round(h_pred, 6) AS h_pred, round(ceiling, 6) AS ceiling, samples, round(bits / ceiling, 6) AS efficiency, round(h_true - bits, 6) AS residual_entropy FROM o")
def channel_capacity(spark, d):
    c = clap.capacity(clap.confusion(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))
    return rounded(c.select("bits", "h_true", "h_pred", "ceiling", "samples", "efficiency", "residual_entropy"), "bits", "h_true", "h_pred", "ceiling", "efficiency", "residual_entropy", digits=6)


def _class_rows(spark: SparkSession, d: str) -> DataFrame:
    floor = lambda c: F.log10(F.greatest(F.col(c), F.lit(1e-12)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("label"), floor("l_extendedprice").alias("f0"), floor("l_quantity").alias("f1"))


GF = "r AS (SELECT *, log10(greatest(l_extendedprice, 1e-12)) AS f0, log10(greatest(l_quantity, 1e-12)) AS f1 FROM lineitem), g AS (SELECT l_returnflag AS label, count(*) AS n, avg(f0) AS mean_0, avg(f1) AS mean_1, var_pop(f0) AS v0, var_pop(f1) AS v1 FROM r GROUP BY 1), h AS (SELECT label, n, mean_0, mean_1, greatest(1e-6, sum(v0 * n) OVER () / sum(n) OVER ()) AS var_0, greatest(1e-6, sum(v1 * n) OVER () / sum(n) OVER ()) AS var_1 FROM g)"


@query(f"WITH {GF} SELECT label, n, round(mean_0, 6) AS mean_0, round(mean_1, 6) AS mean_1, round(var_0, 6) AS var_0, round(var_1, 6) AS var_1 FROM h")
def gaussian_classifier_fit(spark, d):
    return rounded(clap.fit_classes(_class_rows(spark, d), "label", ["f0", "f1"]), "mean_0", "mean_1", "var_0", "var_1", digits=6)


@query(f"WITH {GF}, p AS (SELECT l_returnflag AS true_label, h.label, -0.5 * ((f0 - mean_0)**2 / var_0 + (f1 - mean_1)**2 / var_1) AS s, id FROM (SELECT *, row_number() OVER () AS id FROM r), h), q AS (SELECT true_label, arg_max(label, s) AS predicted FROM p GROUP BY id, true_label) SELECT true_label, predicted, count(*) AS n FROM q GROUP BY ALL")
def gaussian_classifier_predict(spark, d):
    rows = _class_rows(spark, d).withColumnRenamed("label", "true_label")
    classes = clap.fit_classes(_class_rows(spark, d), "label", ["f0", "f1"])
    return clap.predict_classes(rows, classes, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "true_label"], ["f0", "f1"], "label").groupBy("true_label", "predicted").agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(0.0005::DOUBLE / (0.02::DOUBLE * (2 * pi() * (200 + l_quantity * 20) / {SPEED_OF_SOUND})**2), 9) AS volume_m3 FROM lineitem")
def helmholtz_volume(spark, d):
    """Cavity volume for an opening of 5 cm2 and a neck of 2 cm."""
    f = 200 + F.col("l_quantity") * 20
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(0.0005 / (0.02 * fr.helmholtz_ratio(f)), 9).alias("volume_m3"))


@query(f"WITH {MI}, b AS (SELECT sum(CASE WHEN n > 0 THEN p * log2(p / (a * b)) ELSE 0 END) AS bits FROM pr), n AS (SELECT bits, {ARM_DOF} * log2({ARM_RANGE_DEG / ARM_RESOLUTION_DEG}::DOUBLE) AS need FROM b) SELECT round(bits, 6) AS bits, round(need, 6) AS need, round(need - bits, 6) AS deficit, bits >= need AS feasible, ceil(need / bits)::BIGINT AS events_needed, round({ARM_RANGE_DEG} / pow(2, bits / {ARM_DOF}), 4) AS resolution_deg FROM n")
def pose_gap(spark, d):
    b = clap.capacity(clap.confusion(_pairs(spark, d), "quality", "toxic")).select("bits", F.lit(clap.pose_bits()).alias("need"))
    return b.select(F.round("bits", 6).alias("bits"), F.round("need", 6).alias("need"), F.round(F.col("need") - F.col("bits"), 6).alias("deficit"), (F.col("bits") >= F.col("need")).alias("feasible"), F.ceil(F.col("need") / F.col("bits")).alias("events_needed"), F.round(ARM_RANGE_DEG / F.pow(F.lit(2.0), F.col("bits") / ARM_DOF), 4).alias("resolution_deg"))


@query(f"WITH {R}, l AS (SELECT frame_id, 20 * log10(sqrt(list_sum(list_transform(x, lambda v: v * v)) / 50) + 1e-20) AS level FROM fr), p AS (SELECT frame_id, level FROM l UNION ALL SELECT -1 - k, (SELECT level FROM l ORDER BY frame_id LIMIT 1) FROM range(8) t(k)), m AS (SELECT frame_id, level, quantile_cont(level, 0.5) OVER (ORDER BY frame_id ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS floor FROM p) SELECT frame_id, round(level, 4) AS level, round(floor, 4) AS floor FROM m WHERE frame_id >= 0")
def impulse_levels_trailing_median(spark, d):
    level = framed(spark, d).select("rec", "frame_id", (20 * F.log10(F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v) / 50) + 1e-20)).alias("level"))
    seen = fr.trailing_median(level, ["rec"], "frame_id", "level", 9, "floor")
    return seen.select("frame_id", F.round("level", 4).alias("level"), F.round("floor", 4).alias("floor"))


def _clap_recordings(spark: SparkSession, d: str) -> DataFrame:
    """A damped tone at each event of a user's first half second, over a quiet hum."""
    e = table(spark, d, "events").where("user_id IS NOT NULL").select("user_id").distinct().select(F.col("user_id").cast("string").alias("rec_id"), F.lit(8000).alias("sample_rate"), (F.col("user_id") % 5 * 150 + 500).alias("f"))
    wave = F.expr("transform(sequence(0, 11999), i -> 0.0001 * sin(i * 0.7) + CASE WHEN i % 4000 >= 2000 THEN exp(-(i % 4000 - 2000) / 60.0) * sin(2 * pi() * f * (i % 4000 - 2000) / 8000) ELSE 0 END)")
    return e.select("rec_id", "sample_rate", wave.alias("samples"))


WAVE = "u AS (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL), wv AS (SELECT user_id::VARCHAR AS rec_id, user_id % 5 * 150 + 500 AS f, list_transform(range(12000), lambda i: 0.0001::DOUBLE * sin(i * 0.7::DOUBLE) + CASE WHEN i % 4000 >= 2000 THEN exp(-(i % 4000 - 2000) / 60.0::DOUBLE) * sin(2 * pi() * (user_id % 5 * 150 + 500) * (i % 4000 - 2000) / 8000.0::DOUBLE) ELSE 0 END) AS w FROM u), wm AS (SELECT rec_id, f, w, list_avg(w) AS m FROM wv), wc AS (SELECT rec_id, f, list_transform(w, lambda v: v - m) AS x FROM wm), ev AS (SELECT rec_id, f, x, 2000 + 4000 * k + list_position(list_transform(x[2001 + 4000 * k:2096 + 4000 * k], lambda v: abs(v)), list_max(list_transform(x[2001 + 4000 * k:2096 + 4000 * k], lambda v: abs(v)))) - 1 AS idx FROM wc, range(3) t(k))"
POWER = "list_sum(list_transform(x[{a} + 1:{b}], lambda v: v * v)) / 64"


@query(f"WITH {WAVE} SELECT rec_id, idx, round(idx / 8000, 6) AS time_s, round(10 * log10((" + POWER.format(a="idx", b="idx + 64") + " + 1e-20) / (" + POWER.format(a="idx + 320", b="idx + 384") + " + 1e-20)), 3) AS decay_db FROM ev")
def impulse_events(spark, d):
    return clap.impulses(_clap_recordings(spark, d)).select("rec_id", "idx", F.round("time_s", 6).alias("time_s"), F.round("decay_db", 3).alias("decay_db"))


@query(f"WITH {WAVE} SELECT rec_id, idx, f::BIGINT AS tone_hz, true AS near FROM ev")
def resonance_fit(spark, d):
    """The tone of each event, to the nearest of those in use, and whether the fit lies within 15 Hz of it."""
    fits = clap.resonances(clap.impulses(_clap_recordings(spark, d)), 8000).select("rec_id", "idx", "centre_frequency_hz", F.round((F.col("centre_frequency_hz") - 500) / 150).alias("k"))
    tone = (F.col("k") * 150 + 500).cast("long")
    return fits.select("rec_id", "idx", tone.alias("tone_hz"), (F.abs(F.col("centre_frequency_hz") - tone) <= 15).alias("near"))


# Files


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))


@query("SELECT 'doc/' || doc_id || '.txt' AS path, strlen(coalesce(text, ''))::BIGINT AS size_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents")
def manifest_build(spark, d):
    return integrity.manifest(_tree(spark, d))


TREE = "a AS (SELECT doc_id, 'doc/' || doc_id || '.txt' AS path, coalesce(text, '') AS text FROM documents), m AS (SELECT path, strlen(text) AS size_bytes, sha256(text) AS h FROM a WHERE doc_id % 11 <> 0), t AS (SELECT path, CASE WHEN doc_id % 13 = 0 THEN text || 'x' WHEN doc_id % 17 = 0 AND text <> '' THEN 'x' || substr(text, 2) ELSE text END AS text FROM a WHERE doc_id % 7 <> 0)"


@query(f"WITH {TREE} SELECT path, CASE WHEN t.path IS NULL THEN 'missing' WHEN m.path IS NULL THEN 'extra' WHEN strlen(t.text) <> size_bytes THEN 'wrong size' WHEN sha256(t.text) <> h THEN 'content changed' ELSE 'ok' END AS status FROM m FULL JOIN t USING (path)")
def manifest_verify(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    kept = integrity.manifest(docs.where("doc_id % 11 <> 0").select("path", F.col("text").cast("binary").alias("content")))
    changed = F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("x"))).when((F.col("doc_id") % 17 == 0) & (F.col("text") != ""), F.concat(F.lit("x"), F.substring("text", 2, 2**31 - 1))).otherwise(F.col("text"))
    return integrity.verify(kept, docs.where("doc_id % 7 <> 0").select("path", changed.cast("binary").alias("content"))).select("path", "status")


@query("SELECT c_custkey, 'study' || (c_custkey % 4 + 1) || '/p' || lpad((c_custkey % 40 + 1)::VARCHAR, 2, '0') || '/' || CASE WHEN c_custkey % 4 >= 2 THEN 'unknown-device' WHEN c_custkey % 2 = 0 THEN 'samsung' ELSE 'xiaomi' END || '/' || CASE WHEN c_custkey % 4 >= 2 THEN 'unknown-hand' ELSE 'left' END || '/none/s' || lpad((c_custkey % 20)::VARCHAR, 3, '0') AS identity FROM customer")
def session_identity(spark, d):
    k = F.col("c_custkey")
    device = F.when(k % 4 < 2, F.when(k % 2 == 0, "samsung").otherwise("xiaomi"))
    return table(spark, d, "customer").select("c_custkey", integrity.session_identity((k % 4 + 1).cast("int"), (k % 40 + 1).cast("int"), device, F.when(k % 4 < 2, "left"), F.lit(None).cast("string"), (k % 20).cast("int")).alias("identity"))


@query(f"WITH {S} SELECT sample_id, 'pose' AS type, 1 AS version, round(e[1], 6) AS x0, 21 AS joints FROM s")
def pose_jsonl(spark, d):
    from tidewave.streaming import wire

    lines = samples(spark, d).select("sample_id", wire.pose_json(F.col("pose"), F.col("ts"), F.col("ts"), F.lit("mean-pose"), F.lit(0.0)).alias("line"))
    back = lines.select("sample_id", wire.parse_pose(F.col("line")).alias("p")).where("p IS NOT NULL")
    return back.select("sample_id", "p.type", "p.version", F.round(F.col("p.joints")[0][0], 6).alias("x0"), F.size("p.joints").alias("joints"))


@query(f"WITH {R} SELECT frame_id, 119 AS n_bytes, true AS equal FROM fr")
def wire_round_trip(spark, d):
    from tidewave.streaming import wire

    chunks = fr.segment(recording(spark, d), ["rec"], 50).select("frame_id", F.transform("samples", lambda v: F.least(F.lit(32767), F.greatest(F.lit(-32768), F.round(v * 50))).cast("short")).alias("samples"))
    coded = chunks.select("frame_id", "samples", wire.encode_column(F.col("samples"), F.col("frame_id") * 1000, F.lit(48000)).alias("b"))
    return coded.select("frame_id", F.length("b").alias("n_bytes"), (wire.decode_column(F.col("b"))["samples"] == F.col("samples")).alias("equal"))


@query("SELECT DISTINCT user_id::VARCHAR AS stream_id, 20 AS frames, 1 AS breaks FROM events WHERE user_id IS NOT NULL")
def stream_sync_frames(spark, d):
    from tidewave.streaming import live

    return live.aligned_frames(live.chirp_packets(spark, table(spark, d, "events").where("user_id IS NOT NULL").select("user_id").distinct(), 20), Chirp()).groupBy("stream_id").agg(F.count("*").alias("frames"), F.sum((~F.col("continuous")).cast("int")).alias("breaks"))


def stream_frames(spark: SparkSession, d: str) -> DataFrame:
    """The recording as streams of twenty frames each."""
    stream = F.concat(F.lit("s"), F.floor(F.col("frame_id") / 20).cast("string"))
    return framed(spark, d).select(stream.alias("stream_id"), F.col("frame_id").alias("frame_no"), F.col("frame_id").cast("double").alias("timestamp_s"), F.lit(True).alias("continuous"), F.transform("samples", lambda v: v.cast("float")).alias("samples"))


@query(f"WITH {R}, a AS (SELECT 's' || (frame_id // 20) AS stream_id, frame_id, list_transform(x, lambda v: v::FLOAT) AS y FROM fr), b AS (SELECT *, lag(y) OVER w AS p, row_number() OVER w AS place FROM a WINDOW w AS (PARTITION BY stream_id ORDER BY frame_id)), c AS (SELECT *, max(greatest(list_max(list_transform(y, lambda v: abs(v))), list_max(list_transform(range(1, 51), lambda i: abs(y[i] - p[i]))))) OVER (PARTITION BY stream_id ORDER BY frame_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS top FROM b WHERE p IS NOT NULL) SELECT stream_id, count(*) AS windows, true AS equal, round(sum((y[50] / top)::DOUBLE), 3) AS last FROM c WHERE place >= 9 GROUP BY stream_id")
def stream_windows_equal_batch(spark, d):
    """Windows that the state machine assembles against those of the batch plan, by stream; the last profile's last bin."""
    from tidewave.streaming import live

    frames_ = stream_frames(spark, d)
    live_windows = live.assembled_windows(frames_, 8)
    batch = fr.causal_windows(frames_, ["stream_id"], "frame_no", 8, 1).select("stream_id", "frame_no", F.col("window").alias("batch"))
    met = live_windows.join(batch, ["stream_id", "frame_no"])
    far = F.aggregate(F.zip_with("window", "batch", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda m, v: F.greatest(m, v))
    return met.groupBy("stream_id").agg(F.count("*").alias("windows"), (F.max(far) <= 1e-6).alias("equal"), F.round(F.sum(F.col("window")[399].cast("double")), 3).alias("last"))


from tidewave import registry_more, registry_product  # noqa: E402, F401  further queries, registered on import
