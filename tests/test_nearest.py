"""Nearest neighbours of all rows under several rules, and what they write."""

import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewave import registry
from tidewave.model import Split
from tidewave.operators import nearest, poses
from tidewave.plans import suite


def written(spark, run):
    """MB of shuffle and spill files that ``run`` makes."""
    jvm = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    tops = list(jvm.blockManager().diskBlockManager().localDirsString())
    files = lambda: {p: os.stat(p).st_size for top in tops for d, _, names in os.walk(top) for n in names if n.endswith(".data") or n.startswith("temp_") for p in [f"{d}/{n}"]}
    before = files()
    out = run()
    return out, sum(n for p, n in files().items() if p not in before) / 1e6


def brute(rows, allowed):
    """By a row's id the id of its nearest; rows are (sample_id, features, keys...)."""
    out = {}
    for q in rows:
        each = [(round(float(((np.array(q[1]) - np.array(t[1])) ** 2).sum()), 9), t[0]) for t in rows if np.isfinite(t[1]).all() and allowed(q, t)]
        if each and np.isfinite(q[1]).all():
            out[q[0]] = min(each)[::-1]
    return out


@pytest.mark.parametrize("scale", (1.0, 1e20))
def test_rules_of_one_pass_equal_brute_force(spark, scale):
    """Copies, ties, features that are no numbers, rows that do not ask, and lengths beyond single precision."""
    r = np.random.default_rng(3)
    base = r.normal(0, scale, (40, 6))
    rows = []
    for i in range(300):
        x = base[int(r.integers(40))] + (0 if i % 3 else r.normal(0, scale, 6))
        if i % 50 == 7:
            x = np.full(6, [np.nan, np.inf][i % 2])
        rows.append((int(r.permutation(1)[0]) + 1000 - i, [float(v) for v in x], f"a{i % 7}", f"b{i % 4}", i % 5 == 0))
    s = spark.createDataFrame(rows, "sample_id long, features array<double>, a string, b string, asks boolean").repartition(5)
    s = s.withColumn("pose", F.transform("features", lambda v: v + F.col("sample_id")))
    rules = [([], ["a"]), (["a"], ["b"]), ([], []), (["b"], [])]
    folds = [F.col("a"), F.col("b"), F.when(F.col("asks"), F.lit("x")), F.col("b")]
    want = [brute(rows, f) for f in (lambda q, t: q[2] != t[2], lambda q, t: q[2] == t[2] and q[3] != t[3], lambda q, t: True, lambda q, t: q[3] == t[3])]
    want[2] = {k: v for k, v in want[2].items() if rows[1000 - k][4]}
    got = [{}, {}, {}, {}]
    for x in nearest.search(s, None, rules, folds, block_rows=64).collect():
        assert x["sample_id"] not in got[x["rule"]]
        got[x["rule"]][x["sample_id"]] = (x["nearest_id"], x["d2"])
        assert x["fold"] == (rows[1000 - x["sample_id"]][2], rows[1000 - x["sample_id"]][3], "x", rows[1000 - x["sample_id"]][3])[x["rule"]]
        assert x["guess"] == [v + x["nearest_id"] for v in rows[1000 - x["nearest_id"]][1]]
        assert x["pose"] == pytest.approx([v + x["sample_id"] for v in rows[1000 - x["sample_id"]][1]], rel=0, abs=0)
    for mine, said in zip(got, want, strict=True):
        assert {k: v[0] for k, v in mine.items()} == {k: v[0] for k, v in said.items()} and said
        assert all(abs(v[1] - said[k][1]) <= 1e-9 + 1e-12 * said[k][1] for k, v in mine.items())


def test_pairs_of_blocks_are_not_written(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    x = np.random.default_rng(5).normal(0, 1, (6144, 64))
    rows = pa.table({"sample_id": np.arange(len(x)), "features": list(x)})
    s = spark.createDataFrame(rows).withColumn("half", F.col("sample_id") % 2)
    got, mb = written(spark, lambda: poses.nearest_features(s, s, 256, differ=["half"]).collect())
    assert mb < 4 * x.nbytes / 1e6, mb
    d = (x * x).sum(1)[:, None] - 2 * x @ x.T + (x * x).sum(1)
    d[np.arange(len(x))[:, None] % 2 == np.arange(len(x)) % 2] = np.inf
    assert {r["sample_id"]: r["nearest_id"] for r in got} == dict(enumerate(d.argmin(1).tolist()))


@pytest.mark.parametrize("name", ("suite_fold_metrics", "suite_pooled"))
def test_the_suite_writes_little_more_than_its_input(spark, tmp_path, name):
    r = np.random.default_rng(6)
    x = r.normal(0, 0.1, (8000, 64)).astype("f4")
    os.makedirs(tmp_path / "embeddings.parquet")
    pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x), "label": pa.array(r.integers(0, 10, len(x)), pa.int32())}), tmp_path / "embeddings.parquet/0.parquet")
    rows, mb = written(spark, lambda: registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert mb < 4 * x.nbytes / 1e6, mb
    assert len(rows) == {"suite_fold_metrics": 219, "suite_pooled": 12}[name]


def test_tails_are_the_folds_of_sessions(spark, sf):
    """Both sides of tails that are known by where they begin, in any order of rows, with times that tie."""
    s = registry.samples(spark, sf).withColumn("ts", F.floor(F.col("ts") / 40) * 1.0).where("participant <> 'P01' OR sample_id = 3")
    family = suite.Family.of(s, Split.WITHIN_SESSION)
    said = poses.folds(s, Split.WITHIN_SESSION)
    for role, side in (("test", family.test()), ("train", family.train())):
        want = {(x["fold"], x["sample_id"]) for x in said.where(F.col("role") == role).collect()}
        assert {(x["fold"], x["sample_id"]) for x in side.collect()} == want and want


def test_a_sample_tested_in_two_folds_has_a_neighbour_in_each(spark, sf):
    s = registry.samples(spark, sf).where("sample_id < 60")
    folds = s.select(F.explode(F.array(F.lit("x"), F.lit("y"))).alias("fold"), "sample_id").withColumn("role", F.when(F.col("sample_id") < 5, "test").when((F.col("sample_id") % 2 == 0) == (F.col("fold") == "x"), "train")).where("role IS NOT NULL")
    found = suite.Family(poses.keyed(s), Split.WITHIN_SESSION, folds).nearest().collect()
    assert len(found) == 10 and all((x["nearest_id"] % 2 == 0) == (x["fold"] == "x") and x["nearest_id"] >= 5 for x in found)
