"""Pose samples, folds, baselines and metrics as DataFrame plans.

A sample is (sample_id, participant, device, session, ts, pose, features); ``pose`` is a flat array of 63 numbers,
joint by joint. Sums over training folds come from one grouped pass: what a leave-one-out fold trains on is all minus
the unit left out, so no fold is ever joined with all samples.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.errors import LeakageError
from tidewave.model import JOINTS, TIPS, Alignment, Split
from tidewave.operators import nearest
from tidewave.operators.merkle import tree_digest

N_JOINTS = len(JOINTS)
SIZE = 3 * N_JOINTS


# Letters whose full case folding is longer than they are, or another letter than their lower case.
FOLDED = {"ß": "ss", "ẞ": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ς": "σ", "ŉ": "ʼn", "ſ": "s"}


def identity(name: Column) -> Column:
    """Names that differ in case and white space alone are one, by full case folding."""
    out = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    for letter, folded in FOLDED.items():
        out = F.replace(out, F.lit(letter), F.lit(folded))
    return out


def session_key(participant: Column, session: Column) -> Column:
    return F.concat_ws("/", identity(participant), identity(session))


def wrist_relative(pose: Column) -> Column:
    return F.transform(pose, lambda v, i: v - F.element_at(pose, (i % 3 + 1).cast("int")))


def joint_errors(predicted: Column, truth: Column, alignment: Alignment = Alignment.ROOT) -> Column:
    """Distance of each joint in mm, written out joint by joint so that it is compiled."""

    def apart(i: int) -> Column:
        d = predicted[i] - truth[i]
        return d if alignment is Alignment.NONE else d - (predicted[i % 3] - truth[i % 3])

    return F.array(*[F.sqrt(apart(3 * j) * apart(3 * j) + apart(3 * j + 1) * apart(3 * j + 1) + apart(3 * j + 2) * apart(3 * j + 2)) * 1000 for j in range(N_JOINTS)])


def mean_of(values: Column, start: int = 0) -> Column:
    part = F.slice(values, start + 1, N_JOINTS - start)
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / (N_JOINTS - start)


def share_within(errors: Column, threshold: float, start: int = 0) -> Column:
    part = F.slice(errors, start + 1, N_JOINTS - start)
    return F.aggregate(part, F.lit(0.0), lambda a, x: a + F.when(x <= threshold, 1.0).otherwise(0.0)) / (N_JOINTS - start)


def metrics(errors: DataFrame, keys: list[str], threshold_mm: float = 20.0) -> DataFrame:
    """All metrics of ``errors`` (keys, err) in one pass; err comes from ``joint_errors``."""
    out = errors.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.avg(mean_of(F.col("err"))).alias("mpjpe"),
        F.avg(mean_of(F.col("err"), 1)).alias("mpjpe_excl_root"),
        F.avg(share_within(F.col("err"), threshold_mm)).alias("pck"),
        F.avg(share_within(F.col("err"), threshold_mm, 1)).alias("pck_excl_root"),
        F.array(*[F.avg(F.col("err")[j]) for j in range(N_JOINTS)]).alias("per_joint"),
    )
    tips = sum((F.col("per_joint")[j] for j in TIPS), F.lit(0.0)) / len(TIPS)
    rest = sum((F.col("per_joint")[j] for j in range(N_JOINTS) if j not in TIPS), F.lit(0.0)) / (N_JOINTS - len(TIPS))
    return out.withColumn("fingertips", tips).withColumn("rest", rest).withColumn("dilution", F.when(F.col("rest") > 0, F.col("fingertips") / F.col("rest")).otherwise(F.lit(float("inf"))))


def vector_sums(samples: DataFrame, keys: list[str], vector: str = "pose", weight: str | None = None) -> DataFrame:
    """(keys, n, sums): one grouped pass with partial sums of whole vectors; ``weight``: rows that hold sums already."""
    total = vector_to_array(Summarizer.sum(array_to_vector(F.col(vector)))).alias("sums")
    return samples.groupBy(*keys).agg((F.sum(weight) if weight else F.count("*")).alias("n"), total)


def mean_vector(sums: Column, n: Column) -> Column:
    return F.transform(sums, lambda x: x / n)


def left_out_means(samples: DataFrame, unit: str, within: list[str] | None = None, summed: bool = False) -> DataFrame:
    """(within, unit, mean_pose): for each unit the mean pose of all samples of the others, where there are any.

    ``summed``: rows are (n, sums) of samples already.
    """
    within = within or []
    parts = vector_sums(samples, [*within, unit], "sums", "n") if summed else vector_sums(samples, [*within, unit])
    # the table of units has one row for each person, session or device
    total = vector_sums(parts, within, "sums", "n").withColumnsRenamed({"n": "all_n", "sums": "all_sums"})
    met = parts.join(total, within) if within else parts.join(F.broadcast(total), F.lit(True))  # one row
    rest = F.zip_with("all_sums", "sums", lambda a, b: a - b)
    return met.where("all_n > n").select(*within, unit, mean_vector(rest, F.col("all_n") - F.col("n")).alias("mean_pose"))


def tail_size(n: Column, test_fraction: float = 0.2) -> Column:
    return F.least(n - 1, F.greatest(F.lit(1), F.bround(n * F.lit(test_fraction)).cast("long")))


def folds(samples: DataFrame, split: Split, test_fraction: float = 0.2, contiguous: bool = True) -> DataFrame:
    """(fold, sample_id, role) of one family, for all its folds; without ``contiguous`` the tail of a session is one
    of a fixed shuffle (by hash) instead of its end in time."""
    s = samples.select("sample_id", "participant", "device", "ts", identity(F.col("participant")).alias("who"), session_key(F.col("participant"), F.col("session")).alias("skey"))
    if split is Split.WITHIN_SESSION:
        order = Window.partitionBy("skey").orderBy(*(["ts"] if contiguous else [F.xxhash64("sample_id")]), "sample_id")
        n = F.count("*").over(Window.partitionBy("skey"))
        test = tail_size(n, test_fraction)
        return s.select("sample_id", F.col("skey").alias("fold"), F.row_number().over(order).alias("at"), n.alias("n"), test.alias("test")).where("n >= 2").select("fold", "sample_id", F.when(F.col("at") > F.col("n") - F.col("test"), "test").otherwise("train").alias("role"))
    unit, within = {Split.CROSS_SESSION: ("skey", "who"), Split.CROSS_USER: ("who", None), Split.CROSS_DEVICE: ("device", None)}[split]
    units = s.select(unit, *([within] if within else [])).distinct().withColumnRenamed(unit, "fold")
    if within:
        some = units.groupBy(within).agg(F.count("*").alias("k")).where("k >= 2").select(within)
        pairs = units.join(some, within).join(s, within)
    else:
        pairs = s.join(F.broadcast(units), F.lit(True))  # one row for each person or device
    return pairs.select("fold", "sample_id", F.when(F.col("fold") == F.col(unit), "test").otherwise("train").alias("role"))


def tail_starts(samples: DataFrame) -> DataFrame:
    """(skey, tail): where the tested tail of each session of two samples or more begins, as (ts, sample_id); the same
    tails as ``folds`` of ``WITHIN_SESSION``, from rows with ``skey`` and without anything else of them."""
    order, whole = Window.partitionBy("skey").orderBy("ts", "sample_id"), Window.partitionBy("skey")
    n = F.count("*").over(whole)
    placed = samples.select("skey", "ts", "sample_id", F.row_number().over(order).alias("at"), n.alias("n"))
    return placed.where((F.col("n") >= 2) & (F.col("at") == F.col("n") - tail_size(F.col("n")) + 1)).select("skey", F.struct("ts", "sample_id").alias("tail"))


def leakage(folded: DataFrame, samples: DataFrame) -> DataFrame:
    """(fold, shared_samples, shared_participants, shared_sessions, shared_devices) between train and test."""
    rows = folded.join(samples.select("sample_id", identity(F.col("participant")).alias("who"), session_key(F.col("participant"), F.col("session")).alias("skey"), "device"), "sample_id")
    out = None
    for name, key in (("samples", "sample_id"), ("participants", "who"), ("sessions", "skey"), ("devices", "device")):
        sides = rows.groupBy("fold", key).agg(F.countDistinct("role").alias("roles"))
        part = sides.groupBy("fold").agg(F.sum((F.col("roles") > 1).cast("long")).alias(f"shared_{name}"))
        out = part if out is None else out.join(part, "fold")
    return out


#: What train and test of a family may not share.
FORBIDDEN = {Split.WITHIN_SESSION: ["samples"], Split.CROSS_SESSION: ["samples", "sessions"], Split.CROSS_USER: ["samples", "participants", "sessions"], Split.CROSS_DEVICE: ["samples", "devices"]}


def require_no_leakage(folded: DataFrame, samples: DataFrame, split: Split) -> None:
    wrong = " OR ".join(f"shared_{x} > 0" for x in FORBIDDEN[split])
    found = leakage(folded, samples).where(wrong).limit(1).collect()
    if found:
        raise LeakageError(f"{split.name} fold {found[0]['fold']}: {found[0].asDict()}")


def aliases(names: DataFrame, column: str) -> DataFrame:
    """Normalised names that are spelled in more than one way."""
    return names.groupBy(identity(F.col(column)).alias("key")).agg(F.array_sort(F.collect_set(column)).alias("spellings")).where(F.size("spellings") > 1)


def subject_means(train: DataFrame, test: DataFrame) -> DataFrame:
    """Each test sample with its person's mean training pose, or the mean of all, and whether the person is known."""
    people = vector_sums(train, ["participant"])
    everybody = vector_sums(people, [], "sums", "n").select(mean_vector(F.col("sums"), F.col("n")).alias("overall"))
    known = people.select("participant", mean_vector(F.col("sums"), F.col("n")).alias("own"))
    return test.join(known, "participant", "left").join(F.broadcast(everybody), F.lit(True)).select(*test.columns, F.coalesce("own", "overall").alias("mean_pose"), F.col("own").isNotNull().alias("known"))


def nearest_features(train: DataFrame, test: DataFrame, block_rows: int = nearest.BLOCK, same: list[str] | None = None, differ: list[str] | None = None) -> DataFrame:
    """(sample_id, nearest_id, d2): nearest training sample by features, the smallest id on ties (``nearest.search``).

    Only training rows count that have the test row's values in the columns ``same`` and others in the columns
    ``differ``: so all folds of a family take one pass.
    """
    columns = ["sample_id", "features", *dict.fromkeys([*(same or []), *(differ or [])])]
    found = nearest.search(train.select(*columns), test.select(*columns), [(same or [], differ or [])], block_rows=block_rows)
    return found.select("sample_id", "nearest_id", "d2")


def procrustes(predicted: Column, truth: Column) -> Column:
    """Predicted poses after the best rotation, scale and shift of each frame, without reflections."""
    @F.arrow_udf("array<double>")
    def fitted(a: pa.Array, b: pa.Array) -> pa.Array:
        p, t = (np.array(x.to_pylist(), np.float64).reshape(-1, N_JOINTS, 3) for x in (a, b))
        pm, tm = p.mean(1, keepdims=True), t.mean(1, keepdims=True)
        pc, tc = p - pm, t - tm
        u, s, vt = np.linalg.svd(np.einsum("nji,njk->nik", tc, pc) / N_JOINTS)
        sign = np.ones_like(s)
        sign[:, 2] = np.sign(np.linalg.det(u) * np.linalg.det(vt))
        rotation = np.einsum("nij,nj,njk->nik", u, sign, vt)
        variance = (pc * pc).sum((1, 2)) / N_JOINTS
        scale = np.where(variance > 0, (s * sign).sum(1) / np.where(variance > 0, variance, 1), 1.0)
        out = scale[:, None, None] * np.einsum("nij,nkj->nki", rotation, pc) + tm
        return pa.array(out.reshape(len(p), -1).tolist(), pa.list_(pa.float64()))

    return fitted(predicted, truth)


def _bound(value: Column, of) -> Column:
    """``of(value)`` with the value worked out once."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _minor(a: list[list], i: int, j: int):
    """Cofactor (i, j) of a 4 x 4 matrix of numbers, columns or the like."""
    m = [[a[r][c] for c in range(4) if c != j] for r in range(4) if r != i]
    det = m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    return det if (i + j) % 2 == 0 else -det


#: Newton steps towards the largest root, and squarings where it is a double one.
STEPS, SQUARINGS = 60, 40


def quaternion_matrix(s: dict) -> list[list]:
    """The symmetric matrix whose largest eigenvalue's vector is the rotation of ``s`` (xx, xy, ... zz; sums of products)."""
    yz, zx, xy = s["yz"] - s["zy"], s["zx"] - s["xz"], s["xy"] - s["yx"]
    ab, ac, bc = s["xy"] + s["yx"], s["zx"] + s["xz"], s["yz"] + s["zy"]
    return [[s["xx"] + s["yy"] + s["zz"], yz, zx, xy], [yz, s["xx"] - s["yy"] - s["zz"], ab, ac], [zx, ab, s["yy"] - s["xx"] - s["zz"], bc], [xy, ac, bc, s["zz"] - s["xx"] - s["yy"]]]


def characteristic(s: dict, n: list[list]) -> tuple:
    """(c2, c1, c0) of x^4 + c2 x^2 + c1 x + c0, the characteristic polynomial of ``quaternion_matrix``."""
    squares = reduce(add, (v * v for v in s.values()))
    det = s["xx"] * (s["yy"] * s["zz"] - s["yz"] * s["zy"]) - s["xy"] * (s["yx"] * s["zz"] - s["yz"] * s["zx"]) + s["xz"] * (s["yx"] * s["zy"] - s["yy"] * s["zx"])
    whole = reduce(add, (n[0][j] * _minor(n, 0, j) for j in range(4)))
    return -2 * squares, -8 * det, whole


def similarity_fit(predicted: Column, truth: Column) -> Column:
    """``procrustes`` without a Python worker; slower for each frame, and longer to plan.

    Horn's closed form as expressions: the largest root of a quartic by Newton steps from above, the quaternion as the
    longest column of the adjugate. Where the root is double (poses on a line) squarings of the matrix find one of its
    vectors. A predicted pose in one point stays one, at the truth's middle.
    """
    at = lambda v, a: F.transform(F.sequence(F.lit(0), F.lit(N_JOINTS - 1)), lambda j: F.get(v, 3 * j + a))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda x, y: x + y)
    dot = lambda v, w: total(F.zip_with(v, w, lambda x, y: x * y))
    axes = "xyz"
    split = F.struct(*[at(v.cast("array<double>"), k).alias(n + c) for n, v in (("p", predicted), ("t", truth)) for k, c in enumerate(axes)])

    def centred(v: Column) -> Column:
        means = F.struct(*[(total(v[n + c]) / N_JOINTS).alias(n + c) for n in "pt" for c in axes])
        minus = lambda w, mean: F.transform(w, lambda x: x - mean)
        return _bound(means, lambda m: F.struct(*[minus(v[n + c], m[n + c]).alias(n + c) for n in "pt" for c in axes], *[m["t" + c].alias("m" + c) for c in axes]))

    def summed(v: Column) -> Column:
        sizes = [sum((dot(v[n + c], v[n + c]) for c in "yz"), dot(v[n + "x"], v[n + "x"])).alias(n) for n in "pt"]
        products = [dot(v["p" + a], v["t" + b]).alias(a + b) for a in axes for b in axes]
        return _bound(F.struct(*sizes, *products), lambda s: fitted(v, s))

    def fitted(v: Column, s: Column) -> Column:
        most = F.sqrt(s["p"] * s["t"])  # no eigenvalue is larger
        scaled = F.struct(*[F.when(most > 0, s[a + b] / most).otherwise(0.0).alias(a + b) for a in axes for b in axes])

        def rotated(q: Column) -> Column:
            named = {a + b: q[a + b] for a in axes for b in axes}
            n = quaternion_matrix(named)
            c2, c1, c0 = characteristic(named, n)
            poly = F.struct(c2.alias("c2"), c1.alias("c1"), c0.alias("c0"), *[n[i][j].alias(f"n{i}{j}") for i in range(4) for j in range(i, 4)])
            return _bound(poly, root)

        def root(c: Column) -> Column:
            def newton(x: Column, _: Column) -> Column:
                slope = (4 * x * x + 2 * c["c2"]) * x + c["c1"]
                return F.when(slope > 0, x - (((x * x + c["c2"]) * x + c["c1"]) * x + c["c0"]) / slope).otherwise(x)

            return _bound(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.lit(1.0), newton), lambda x: vector(c, x))

        def vector(c: Column, x: Column) -> Column:
            entry = lambda i, j: c[f"n{min(i, j)}{max(i, j)}"]
            a = [[entry(i, j) - x if i == j else entry(i, j) for j in range(4)] for i in range(4)]
            columns = F.array(*[F.array(*[_minor(a, i, j) for i in range(4)]) for j in range(4)])
            positive = F.array(*[entry(i, j) + 1.0 if i == j else entry(i, j) for i in range(4) for j in range(4)])
            longest = lambda m: F.element_at(F.array_sort(F.transform(m, lambda r: F.struct((-dot(r, r)).alias("size"), r.alias("r")))), 1)
            rows = lambda m: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice(m, 4 * i + 1, 4))

            def squared(m: Column, _: Column) -> Column:
                product = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(0.0), lambda u, i: u + F.get(m, F.floor(k / 4).cast("int") * 4 + i) * F.get(m, 4 * i + k % 4)))
                return _bound(product, lambda y: _bound(F.greatest(F.lit(1e-300), F.get(y, F.lit(0)) + F.get(y, F.lit(5)) + F.get(y, F.lit(10)) + F.get(y, F.lit(15))), lambda trace: F.transform(y, lambda e: e / trace)))

            double = F.aggregate(F.sequence(F.lit(1), F.lit(SQUARINGS)), positive, squared)
            found = _bound(longest(columns), lambda best: F.when(best["size"] < -1e-18, best["r"]).otherwise(longest(rows(double))["r"]))
            return _bound(found, lambda r: _bound(F.sqrt(dot(r, r)), lambda size: placed(F.transform(r, lambda e: e / size), x)))

        def placed(q: Column, x: Column) -> Column:
            w, i, j, k = (F.get(q, F.lit(n)) for n in range(4))
            turn = [[w * w + i * i - j * j - k * k, 2 * (i * j - w * k), 2 * (i * k + w * j)], [2 * (i * j + w * k), w * w - i * i + j * j - k * k, 2 * (j * k - w * i)], [2 * (i * k - w * j), 2 * (j * k + w * i), w * w - i * i - j * j + k * k]]
            scale = F.when(s["p"] > 0, x * most / s["p"]).otherwise(1.0)
            matrix = F.array(*[F.when(s["p"] > 0, scale * e).otherwise(0.0) for row in turn for e in row])
            return _bound(matrix, lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(N_JOINTS - 1)), lambda n: F.array(*[sum((F.get(m, F.lit(3 * r + c)) * F.get(v["p" + axes[c]], n) for c in range(3)), v["m" + axes[r]]) for r in range(3)]))))

        return _bound(scaled, rotated)

    return F.when(predicted.isNotNull() & truth.isNotNull(), _bound(split, lambda v: _bound(centred(v), summed)))


def calibration(samples: DataFrame, folded: DataFrame, budgets: list[float], sample_seconds: float) -> DataFrame:
    """(budget, fold, participant, got, wanted): what each test person's pool gives for each budget of minutes.

    The pool of a fold holds the samples of its test people that are neither trained nor tested on.
    """
    test = folded.where("role = 'test'").join(samples.select("sample_id", "participant"), "sample_id").select("fold", "participant").distinct()
    pool = test.join(samples, "participant").join(folded.select("fold", "sample_id"), ["fold", "sample_id"], "left_anti")
    ranked = pool.withColumn("rank", F.row_number().over(Window.partitionBy("fold", "participant").orderBy("ts", "sample_id")))
    wanted = samples.sparkSession.createDataFrame([(float(b), round(b * 60 / sample_seconds)) for b in budgets], "budget double, wanted long")
    return ranked.join(F.broadcast(wanted), F.col("rank") <= F.col("wanted")).select("budget", "wanted", "fold", "participant", "sample_id", "rank")


def achieved(samples: DataFrame, folded: DataFrame, taken: DataFrame, budgets: list[float], sample_seconds: float) -> DataFrame:
    """(budget, achieved, truncated): minutes of the person who got least, and whether any got less than wanted."""
    people = folded.where("role = 'test'").join(samples.select("sample_id", "participant"), "sample_id").select("fold", "participant").distinct()
    asked = samples.sparkSession.createDataFrame([(float(b), round(b * 60 / sample_seconds)) for b in budgets], "budget double, wanted long")
    got = taken.groupBy("budget", "fold", "participant").agg(F.count("*").alias("got"))
    each = people.join(F.broadcast(asked), F.lit(True)).join(got, ["budget", "fold", "participant"], "left").fillna(0, ["got"])
    return each.groupBy("budget").agg((F.min("got") * sample_seconds / 60).alias("achieved"), F.bool_or(F.col("got") < F.col("wanted")).alias("truncated"))


def concentration(test: DataFrame, most: float = 0.5) -> DataFrame:
    """The person with most test samples; passes up to a share of ``most``. First seen wins ties."""
    people = test.groupBy("participant").agg(F.count("*").alias("n"), F.min("sample_id").alias("first"))
    top = people.agg(F.sum("n").alias("total"), F.min_by("participant", F.struct(-F.col("n"), "first")).alias("participant"), F.max("n").alias("n"))
    return top.select("participant", "n", "total", (F.col("n") / F.col("total")).alias("share"), (F.col("n") / F.col("total") <= most).alias("passed"))


def pose_distance(a: Column, b: Column) -> Column:
    """Mean over joints of the distance of two poses."""
    square = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    joint = lambda j: F.sqrt(F.element_at(square, (3 * j + 1).cast("int")) + F.element_at(square, (3 * j + 2).cast("int")) + F.element_at(square, (3 * j + 3).cast("int")))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(N_JOINTS - 1)), joint), F.lit(0.0), lambda s, x: s + x) / N_JOINTS


def _match(people: np.ndarray, tested: np.ndarray) -> tuple[int, float, float | None]:
    """Nearest person to the tested pose, its distance, and the median distance between people (n, joints, 3)."""
    far = np.sqrt(((people - tested) ** 2).sum(2)).mean(1)
    between = [np.sqrt(((people[i + 1 :] - people[i]) ** 2).sum(2)).mean(1) for i in range(len(people) - 1)]
    return int(far.argmin()), float(far.min()), float(np.median(np.concatenate(between))) if between else None


MATCH = "fold string, nearest string, distance double, typical double, ratio double, shared long, passed boolean"


def label_matches(parts: DataFrame, tested: DataFrame, least: float = 0.2) -> DataFrame:
    """For each fold how far its mean test pose is from the nearest training person's, against the median between them.

    ``parts``: (fold, participant, n, sums) of training rows, ``tested``: the same of test rows. A fold is one group of
    one row for each person, whose distances are taken row by row; it passes if nobody is on both sides and the nearest
    person is farther than ``least`` of the median.
    """

    def judge(train: pa.Table, test: pa.Table) -> pa.Table:
        fold = (test if test.num_rows else train)["fold"][0].as_py()
        row = dict.fromkeys(("nearest", "distance", "typical", "ratio")) | {"fold": fold, "shared": 0, "passed": False}
        if train.num_rows and test.num_rows:
            order = np.argsort(np.array(train["participant"].to_pylist(), object))
            mean = lambda t: np.array(t["sums"].to_pylist()) / t["n"].to_numpy()[:, None]
            total = np.array(test["sums"].to_pylist()).sum(0) / test["n"].to_numpy().sum()
            at, far, typical = _match(mean(train)[order].reshape(-1, N_JOINTS, 3), total.reshape(N_JOINTS, 3))
            names = [train["participant"][int(i)].as_py() for i in order]
            ratio = far / typical if typical else None
            shared = len(set(names) & set(test["participant"].to_pylist()))
            row |= {"nearest": names[at], "distance": far, "typical": typical, "ratio": ratio, "shared": shared, "passed": bool(ratio is not None and ratio > least and not shared)}
        return pa.Table.from_pylist([row], pa.schema([("fold", pa.string()), ("nearest", pa.string()), ("distance", pa.float64()), ("typical", pa.float64()), ("ratio", pa.float64()), ("shared", pa.int64()), ("passed", pa.bool_())]))

    # new names, since both sides may come from one table
    columns = [F.col("fold").alias("fold"), F.col("participant").alias("participant"), F.col("n").cast("long").alias("n"), F.col("sums").alias("sums")]
    return parts.select(columns).groupBy("fold").cogroup(tested.select(columns).groupBy("fold")).applyInArrow(judge, MATCH)


def label_match(train: DataFrame, test: DataFrame, least: float = 0.2) -> DataFrame:
    """``label_matches`` of one pair of training and test samples."""
    one = lambda rows: vector_sums(rows, ["participant"]).withColumn("fold", F.lit(""))
    return label_matches(one(train), one(test), least).drop("fold", "shared")


def unit_of(split: Split) -> tuple[str, list[str]]:
    """The column a family leaves out, and the columns inside which it does."""
    return {Split.CROSS_SESSION: ("skey", ["who"]), Split.CROSS_USER: ("who", []), Split.CROSS_DEVICE: ("device", [])}[split]


def keyed(samples: DataFrame) -> DataFrame:
    """Samples with ``who`` and ``skey``, the identities of their person and session."""
    return samples.withColumns({"who": identity(F.col("participant")), "skey": session_key(F.col("participant"), F.col("session"))})


def unit_leaks(samples: DataFrame, split: Split) -> DataFrame:
    """(kind, key): what stands in two units of a family that leaves units out, and so on both sides of a fold.

    One pass over the samples (with ``who`` and ``skey``) instead of one row for each fold and sample.
    """
    unit, within = unit_of(split)
    keys = {"samples": "sample_id", "participants": "who", "sessions": "skey", "devices": "device"}
    out = None
    for kind in FORBIDDEN[split]:
        by = samples.groupBy(*within, keys[kind]).agg(F.countDistinct(unit).alias("units")).where("units > 1")
        part = by.select(F.lit(kind).alias("kind"), F.col(keys[kind]).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def fold_label_matches(samples: DataFrame, split: Split, least: float = 0.2) -> DataFrame:
    """``label_matches`` of all folds of a family that leaves units out, from one pass of sums by unit and person.

    Folds that leave people out share one table of distances (``people``).
    """
    if split is Split.CROSS_USER:
        from tidewave.operators.people import left_out_matches

        return left_out_matches(samples, least)
    unit, within = unit_of(split)
    parts = vector_sums(samples, [*within, unit, "participant"])
    tested = parts.withColumn("fold", F.col(unit))
    left = parts.select(*within, F.col(unit).alias("fold")).distinct()
    met = parts.join(left, within) if within else parts.join(F.broadcast(left), F.lit(True))  # a row for each unit and person
    rest = met.where(F.col("fold") != F.col(unit))
    return label_matches(vector_sums(rest, ["fold", "participant"], "sums", "n"), tested, least)


def evaluation_size(errors: DataFrame, cluster: str, least: int, reported_decimals: int = 2) -> DataFrame:
    """Clusters, spread of their means, and how many decimals of the mean the spread justifies.

    Passed are ``least`` clusters or more whose spread supports the decimals that are printed; one cluster has no spread.
    """
    by = errors.groupBy(cluster).agg(F.avg("error").alias("m"))
    out = by.agg(F.count("*").alias("clusters"), F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("*"))).alias("sem"))
    decimals = F.when(F.col("sem") > 0, F.floor(-F.log10(2 * F.col("sem")))).otherwise(reported_decimals).cast("int")
    return out.select("clusters", "mean", "sem", decimals.alias("decimals"), ((F.col("clusters") >= max(2, least)) & (F.lit(reported_decimals) <= decimals)).alias("passed"))


def time_blocks(samples: DataFrame, most: int = 10) -> DataFrame:
    """Blocks of equal rank counts by time: rank * blocks div n."""
    whole = Window.partitionBy("session").orderBy("ts", "sample_id")
    n = F.count("*").over(Window.partitionBy("session"))
    return samples.withColumn("time_block", F.floor((F.row_number().over(whole) - 1) * F.least(n, F.lit(most)) / n).cast("int"))


def split_fingerprint(folded: DataFrame, samples: DataFrame) -> DataFrame:
    """(fold, role, n, fingerprint): what a fold holds, as one hash of its sorted samples and what describes them."""
    rows = folded.join(samples.select("sample_id", "participant", "session", "device"), "sample_id")
    row = F.sha2(F.concat_ws("|", F.col("sample_id").cast("string"), "participant", "session", "device"), 256)
    return tree_digest(rows.select("fold", "role", row.alias("h")), ["fold", "role"], "fingerprint")


def index_faults(folded: DataFrame, samples: DataFrame) -> DataFrame:
    """(fold, sample_id, fault): samples that a fold names twice on one side, on both sides, or that do not exist."""
    by = folded.groupBy("fold", "sample_id").agg(F.count("*").alias("n"), F.countDistinct("role").alias("roles"))
    known = samples.select("sample_id", F.lit(True).alias("known"))
    fault = F.when(F.col("known").isNull(), "unknown").when(F.col("roles") > 1, "overlap").when(F.col("n") > 1, "repeated")
    return by.join(known, "sample_id", "left").select("fold", "sample_id", fault.alias("fault")).where("fault IS NOT NULL")


def joint(pose: Column, name: str) -> Column:
    """(x, y, z) of a joint by its name."""
    return F.slice(pose, 3 * JOINTS.index(name) + 1, 3)


def valid_pose(pose: Column) -> Column:
    """63 numbers, all finite."""
    return F.coalesce((F.size(pose) == SIZE) & F.forall(pose, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def head(samples: DataFrame, limit: int, order: list[str], with_features: bool = True) -> DataFrame:
    """The first ``limit`` samples in the source's order, features only on request."""
    rows = samples.orderBy(*order).limit(limit)
    return rows if with_features else rows.drop("features")


def where(samples: DataFrame, participant: str | None = None, session: str | None = None, device: str | None = None) -> DataFrame:
    """Samples that meet all that is given; names are compared as identities."""
    out = samples
    if participant is not None:
        out = out.where(identity(F.col("participant")) == identity(F.lit(participant)))
    if session is not None:
        out = out.where(session_key(F.col("participant"), F.col("session")) == F.lit(session))
    return out if device is None else out.where(F.col("device") == device)


def study_participant(study: Column, participant: Column) -> Column:
    """Names that keep people of different studies apart, where numbering starts anew."""
    return F.format_string("study%d/sub%d", study.cast("int"), participant.cast("int"))


def standardise(features: Column, mean: Column, sd: Column) -> Column:
    return F.zip_with(F.zip_with(features, mean, lambda x, m: x - m), sd, lambda x, s: x / s)


def restore_pose(z: Column, mean: Column, sd: Column) -> Column:
    """A standardised pose in metres, with its wrist at the origin."""
    return wrist_relative(F.zip_with(F.zip_with(z, sd, lambda x, s: x * s), mean, lambda x, m: x + m))


def digest(predictions: DataFrame, digits: int = 9) -> DataFrame:
    """(rows, digest) of (sample_id, pose), as a tree of one hash for each row; numbers count to ``digits`` decimals."""
    row = F.sha2(F.concat_ws(",", F.col("sample_id").cast("string"), F.transform("pose", lambda v: F.round(v * 10**digits).cast("long").cast("string"))), 256)
    return tree_digest(predictions.select(row.alias("h")), [], "digest").withColumnRenamed("n", "rows")


def require_pool(calibrated: DataFrame, folded: DataFrame, budgets: list[float]) -> None:
    """An empty pool with a budget above zero is refused, and so is a pool that holds training or test samples."""
    if max(budgets, default=0) > 0 and calibrated.limit(1).count() == 0:
        raise ValueError("no samples are left to calibrate on")
    if calibrated.join(folded.select("fold", "sample_id"), ["fold", "sample_id"], "left_semi").limit(1).count():
        raise LeakageError("the calibration pool holds training or test samples")
