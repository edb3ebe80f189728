"""Whitening, byte pairs and resampling: against brute force, the library, round trips and SQL, and on odd tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewave.llm import bytepairs, resampling, whitening

DOCS = "doc_id long, text string, source string, weight string, portion int, number int, key string, ids string, n_tokens int, score string, rank int"
ODD = [(1, None), (2, ""), (3, " \t\n"), (None, "some words here to read"), (4, " ".join(f"w{i % 977}" for i in range(30000))), (5, "one two three " * 9), (5, "one two three " * 9), (6, "One TWO three " * 9), (7, "a" * 5000), (8, "über 😀 ①   x's <|endoftext|> Ünï  \r\n  7x"), (None, None), (9, "\x00\x01\x7f")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None, "w", 1, 2, "k", "i", 3, "s", 4) for i, t in ODD], DOCS).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# 11


def brute_whitening(vectors, k):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    y = d.astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = np.maximum(e[::-1], 0), v[:, ::-1]
    return [int((r * r).sum()) for r in d], y @ v[:, :k], e, v


def test_whitening_equals_eigenvectors(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    deviations, projected, e, _ = brute_whitening([v for _, v in rows], 8)
    got = {(r["vec_id"], r["component"]): r for r in whitening.op11(spark, sf).collect()}
    assert len(got) == 8 * len(rows)
    for k in range(8):
        mine = np.array([got[i, k + 1]["whitened"] for i, _ in rows])
        want = projected[:, k] / math.sqrt(e[k])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        assert abs(got[rows[0][0], k + 1]["explained"] / (e[k] / e.sum()) - 1) < 1e-9
    assert all(r["deviation"] == d and r["n"] == len(rows) and r["identity_error"] < 1e-10 for d, (i, _) in zip(deviations, rows, strict=True) for r in [got[i, 1]])


def test_rotations_are_accurate_where_values_are_small():
    """Columns of very different lengths: the Gram matrix would lose the small ones, rotations keep them."""
    draw = np.random.default_rng(0)
    for dim in (1, 2, 7, 20):
        q, _ = np.linalg.qr(draw.normal(size=(dim, dim)))
        p, _ = np.linalg.qr(draw.normal(size=(dim, dim)))
        sizes = np.logspace(0, -12, dim)
        got, vectors = whitening.jacobi((q * sizes) @ np.diag(np.ones(dim)))
        assert np.allclose(got, sizes, rtol=1e-12, atol=0)
        a = q @ np.diag(np.linspace(3, 1, dim)) @ p
        got, vectors = whitening.jacobi(a)
        assert np.allclose(got, np.linspace(3, 1, dim)) and np.allclose(vectors @ vectors.T, np.eye(dim))
        assert np.allclose(np.linalg.norm(a @ vectors.T, axis=0), got)
    assert sorted((int(i), int(j)) for a, b in whitening.rounds(7) for i, j in zip(a, b, strict=True)) == [(i, j) for i in range(7) for j in range(i + 1, 7)]


def test_triangles_over_several_levels(spark, monkeypatch):
    """40 tasks, three triangles a group: four levels give the covariance of one pass."""
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    draw = np.random.default_rng(1)
    v = draw.normal(size=(400, 5)) * [100, 1, 0.1, 10, 3]
    d = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>").repartition(40)
    rows = whitening.usable(d, "id", "v")
    n, sums = whitening.totals(rows)
    r = whitening.tsqr(rows, n, sums)
    y = np.floor(1024 * v) - np.floor(1024 * v).mean(axis=0)
    assert n == 400 and np.allclose(r.T @ r, y.T @ y) and np.allclose(r, np.triu(r))


def test_exact_squares():
    draw = random.Random(0)
    x = [[draw.randint(-(1 << 30), 1 << 30) for _ in range(9)] for _ in range(50)]
    n, s = 1 << 29, [sum(c) for c in zip(*x, strict=True)]
    assert whitening.squares(np.array(x), n, np.array(s)) == [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]


def test_whitening_of_odd_tables(spark):
    kinds = "vec_id long, embedding array<float>, component string, n string, whitened string, key int, v int"
    odd = [(1, None), (2, [None, 1.0, 2.0]), (3, [float("nan"), 1.0, 2.0]), (4, [float("inf"), 1.0, 2.0]), (5, []), (6, [1.0, 2.0]), (None, [1.5, 2.0, 0.0]), (7, [0.25, -1.0, 0.0]), (7, [0.25, -1.0, 0.0]), (8, [3.0, 9.0, 0.0])]
    d = spark.createDataFrame([(i, v, "c", "n", "w", 1, 2) for i, v in odd], kinds)
    got = whitening.digests(d, "vec_id", "embedding").collect()
    assert Counter(r["vec_id"] for r in got) == {None: 3, 7: 6, 8: 3} and {r["n"] for r in got} == {4}
    deviations, _, e, _ = brute_whitening([v for i, v in odd[6:]], 3)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == sorted(deviations)
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got) and got[0]["identity_error"] < 1e-10
    assert {round(r["explained"], 9) for r in got} == {round(float(x), 9) for x in e / e.sum()}
    alone = whitening.digests(d.where("vec_id = 8"), "vec_id", "embedding").collect()
    assert [(r["component"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in alone] == [(k, 0, None, None, None) for k in (1, 2, 3)]
    for none in (d.limit(0), d.where("vec_id < 6")):
        assert whitening.digests(none, "vec_id", "embedding").collect() == []
    with pytest.raises(Exception, match="exact integers"):
        whitening.digests(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), "vec_id", "embedding")


# 12


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bytepairs.read_ranks(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pairs(ranks):
    import public_tokenizers

    return bytepairs.load(bytepairs.serialise(ranks), public_tokenizers.PATTERN)


def test_byte_pairs_equal_the_library(pairs, library):
    draw = random.Random(0)
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "12", "é", "漢", "😀", "-", "_", "<unk>", "<|endoftext|>", "qz", "ing", "\x00", "­", "Ġ", "▁", "\u0085", " ", "​"]
    some = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    some += [f"a{chr(c)}b {chr(c)}{chr(c)}1" for c in range(1, 0x3200)] + ["a" * 200_000, "ab " * 50_000, "ab" * 100_000]
    for text, ids in zip(some, pairs.encode(some), strict=True):
        assert ids.tolist() == library.encode_ordinary(text), text[:40]
        assert pairs.decode(ids.tolist()) == text.encode()


def test_vocabulary_is_checked_and_mapped(ranks):
    assert len(set(bytepairs.LETTERS)) == 256 and not any(c.isspace() for c in bytepairs.LETTERS)
    assert all(bytepairs.bytes_of(bytepairs.letters(e)) == e for e in ranks)
    assert bytepairs.read_ranks(b"\n".join(base64.b64encode(e) + b" %d" % r for e, r in ranks.items())) == ranks
    small = {bytes([b]): b for b in range(256)}
    for bad in ({b"a": 0}, {**small, b"ab": 300}, {**small, b"": 256}, {k: v for k, v in small.items() if v < 255}):
        with pytest.raises(bytepairs.VocabularyError):
            bytepairs.serialise(bad)
    # a whole match that no merges reach is still one id
    model = bytepairs.BytePairs(bytepairs.serialise({**small, b"xyz": 256, b"zz": 257}), r"\w+|\W+")
    assert [i.tolist() for i in model.encode(["xyz", "xyzz", "zzz", ""])] == [[256], [120, 121, 257], [257, 122], []]


def test_byte_pairs_of_odd_tables(spark, docs, empty, ranks, library):
    import public_tokenizers

    model, pattern = bytepairs.serialise(ranks), public_tokenizers.PATTERN
    want = []
    for i, t in ODD:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert Counter(map(tuple, bytepairs.digests(docs, model, pattern).collect())) == Counter(want)
    coded = bytepairs.encode(docs, model, pattern)
    back = bytepairs.decode(coded, model, pattern).collect()
    assert Counter((r["doc_id"], bytes(r["data"])) for r in back) == Counter((i, (t or "").encode()) for i, t in ODD)
    assert bytepairs.digests(empty, model, pattern).count() == bytepairs.encode(empty, model, pattern).count() == 0


# 13

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, shortest, longest):
    w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return w, [" ".join(w[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]


def brute_resampling(docs, target, shortest=1, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    each = [(i, *features(t, shortest, longest)) for i, t in docs]
    s = Counter(bucket(x) for _, _, f in each for x in f)
    t = Counter(bucket(x) for text in target for x in features(text, shortest, longest)[1])
    gain = lambda k: math.floor(1000 * math.log((t[k] + 1) * (s.total() + buckets) / ((s[k] + 1) * (t.total() + buckets))))
    rows = []
    for i, w, f in each:
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    some = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(some[: percent * len(some) // 100]):
        r[4] = k + 1
    return sorted(str(r[:5]) for r in rows)


def rows_of(frame):
    return sorted(str(list(r)) for r in frame.collect())


def test_resampling_equals_brute_force_and_sql(spark, duck, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = rows_of(resampling.op13(spark, sf))
    assert got == brute_resampling(docs, target)
    assert got == sorted(str(list(r)) for r in duck.execute(resampling.OP13_SQL).fetchall())


@pytest.mark.parametrize(("shortest", "longest"), [(1, 1), (1, 3), (2, 2)])
def test_runs_of_words_over_many_portions(spark, docs, monkeypatch, shortest, longest):
    """Odd rows, tiny portions and many partitions: tuples of several words, ties, repeated rows and clashing names."""
    monkeypatch.setattr(resampling, "PORTION", 200)
    target = spark.createDataFrame([("one two three four",), (None,), ("w1 w2 über w3",)], "text string")
    got = rows_of(resampling.resample(docs.repartition(5), target, shortest=shortest, longest=longest, buckets=50, least_words=5, percent=70))
    assert got == brute_resampling(ODD, ["one two three four", None, "w1 w2 über w3"], shortest, longest, 50, 5, 70)


def test_resampling_of_empty_tables(spark, docs, empty):
    assert resampling.resample(empty, docs).collect() == []
    assert rows_of(resampling.resample(docs, empty)) == brute_resampling(ODD, [])
    assert all(r["rank"] is None for r in resampling.resample(docs, docs, least_words=10**6).collect())


def test_codes_of_words():
    column = pa.array(["Ab aB", None, "", "é1_é1 \x00", "ab"])
    words, codes, before = resampling.word_codes(*resampling.utf8(column))
    assert words.to_pylist() == ["ab", "é1"] and codes.tolist() == [0, 0, 1, 1, 0] and before.tolist() == [0, 2, 2, 2, 4, 5]
    times, (pairs,), numbers, ends = resampling.runs_of(codes, before, 2, 2)
    assert [pairs[i - 2].tolist() for i in numbers] == [[0, 0], [1, 1]] and ends.tolist() == [0, 1, 1, 1, 2, 2] and times.tolist() == [0, 0, 1, 1]
    times, (pairs,), numbers, ends = resampling.runs_of(codes, before, 1, 2)
    assert numbers.tolist() == [0, 0, 2, 1, 1, 3, 0] and ends.tolist() == [0, 3, 3, 3, 6, 7] and times.tolist() == [3, 2, 1, 1]


# 9


def test_large_tables_of_blocks_are_not_broadcast(spark):
    """Beyond the limit the plan has no broadcast of blocks and no text in its shuffles, and the same rows."""
    from tidewave.llm import mixing

    d = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 4}") for i in range(400)], "doc_id long, text string, source string")
    some, many = (mixing.assign(d, [], broadcast_rows=n).select("doc_id", "size", "target", "taken", F.size("shards").alias("n")) for n in (100_000, 0))
    assert Counter(map(tuple, some.collect())) == Counter(map(tuple, many.collect()))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert not [x for x in plan.splitlines() if "Exchange" in x and "text#" in x]
