"""Queries that run the evaluation's own plans: suite, calibration sweep, binding of guards, preparation of a recording."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewave.model import GroundTruth, Protocol, Split
from tidewave.operators import frames as fr
from tidewave.operators import poses
from tidewave.plans import calibration, fitting, suite
from tidewave.registry import BUDGETS, CAL, CAL_FOLD, ORACLE_SQL, SUITE, J, S, framed, query, samples

P = Protocol(Split.CROSS_USER, "embeddings", "1", GroundTruth.SYNTHETIC, 10)


@query(f"WITH {CAL} SELECT budget AS requested, got * 6.0::DOUBLE / 60 AS achieved, got < wanted AS truncated, round(mpjpe, 4) AS mpjpe FROM c JOIN g USING (budget)")
def calibration_sweep(spark, d):
    """The sweep itself, its fits of all budgets from sums."""
    s = samples(spark, d)
    folded = s.select(F.lit("p00").alias("fold"), "sample_id", F.expr(CAL_FOLD).alias("role")).where("role IS NOT NULL")
    curve = calibration.sweep(s, folded, fitting.MeanFitter(), P, 6.0, tuple(BUDGETS))
    return spark.createDataFrame([(p.requested, p.achieved, p.truncated, round(p.mpjpe.value, 4)) for p in curve.points], "requested double, achieved double, truncated boolean, mpjpe double")


@query(f"WITH t AS ({SUITE}) SELECT split, samples, mpjpe FROM t")
def suite_experiments(spark, d):
    """All honest families through ``run_suite``: the mean training pose as the model, refitted in every fold."""
    done = suite.run_suite(samples(spark, d), P, "mean", fitting.MeanFitter(), baselines=())
    rows = [(s.name, r.best("model").mpjpe.samples, round(r.best("model").mpjpe.value, 4)) for s, r in done.reports.items() if s.is_honest]
    return spark.createDataFrame(rows, "split string, samples long, mpjpe double")


@query(f"WITH {J}, u AS (SELECT participant, count(*) AS n FROM s GROUP BY participant), t AS (SELECT sum(n) AS total, count(*) AS people FROM u) SELECT 'CROSS_USER' AS split, sum(total - n)::BIGINT AS n_train, sum(n)::BIGINT AS n_test, 64::BIGINT AS digits FROM u, t")
def guard_binding(spark, d):
    """What the guards of leave-one-person-out folds are bound to."""
    n_train, n_test, fingerprint = suite.Family.of(samples(spark, d), Split.CROSS_USER).identity()
    return spark.createDataFrame([("CROSS_USER", n_train, n_test, len(fingerprint))], "split string, n_train long, n_test long, digits long")


@query(f"WITH {S}, p AS (SELECT participant, k AS joint, avg(e[3*k+1]) AS x, avg(e[3*k+2]) AS y, avg(e[3*k+3]) AS z FROM s, (SELECT unnest(range(21)) AS k) GROUP BY ALL), d AS (SELECT a.participant AS a, b.participant AS b, avg(sqrt((a.x-b.x)**2+(a.y-b.y)**2+(a.z-b.z)**2)) AS d FROM p a JOIN p b ON a.participant < b.participant AND a.joint = b.joint GROUP BY ALL) SELECT lower(u.participant) AS unit, round(median(d), 6) AS typical, count(*) AS pairs FROM (SELECT DISTINCT participant FROM s) u JOIN d ON a <> u.participant AND b <> u.participant GROUP BY u.participant")
def medians_without_each_person(spark, d):
    """The usual distance between people in every fold that leaves one out, from one ordered table of pairs."""
    from pyspark.sql import Window

    from tidewave.operators import people

    known = poses.vector_sums(poses.keyed(samples(spark, d)), ["who"]).select("who", F.dense_rank().over(Window.orderBy("who")).cast("bigint").alias("id"), poses.mean_vector(F.col("sums"), F.col("n")).alias("mean")).withColumn("unit", F.col("id"))
    pairs = people.pair_distances(known.select("id", "unit", "mean"))
    n = F.count("*").over(Window.partitionBy())  # a row a person
    return people.medians_without(pairs).join(known.select("unit", "who", n.alias("n")), "unit").select(F.col("who").alias("unit"), F.round("typical", 6).alias("typical"), ((F.col("n") - 1) * (F.col("n") - 2) / 2).cast("bigint").alias("pairs"))


@query(f"WITH o AS ({ORACLE_SQL['bin_zero_offset']}), l AS ({ORACLE_SQL['differential_lag']}) SELECT bin_offset AS offset, (SELECT CASE WHEN count(*) = 1 THEN max(lag) END FROM l WHERE matches)::INT AS lag FROM o")
def preparation_measured(spark, d):
    """Bin zero and the only lag that fits, of a recording with stored changes that begin one frame late."""
    some = framed(spark, d)
    stored = fr.differences(some, ["rec"], "frame_id").where("frame_id >= 2").select("rec", "frame_id", F.col("samples").alias("diff"))
    rows = some.join(stored, ["rec", "frame_id"], "left")
    return fr.preparation(rows, ["rec"], "frame_id", 2).select("offset", F.col("lag").cast("int").alias("lag"))
