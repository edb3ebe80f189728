"""Operator 8: Jaccard self-join of documents on word 5-grams with Bayesian pruning of candidates.

1. Every document becomes its set of shingles (64-bit hashes of five words in a row; fewer words are one shingle), a
   128-bit fingerprint of that set and 128 MinHash values of 16 bits. Documents with equal fingerprints form a class;
   only one of each goes on.
2. Four MinHash values make one of 32 bands. Classes that share a band value meet in a bucket. Buckets of at most
   ``small`` classes give pairs; a pair that shares one band alone is dropped, since at similarity 0.8 that has a
   probability of about 1e-6. Larger buckets give a star of edges, so nothing is emitted for all pairs of a group.
3. The connected components of these edges hold every candidate pair. A component is dealt into blocks of bounded
   weight, and each pair of blocks is one group of rows; small components share groups.
4. Within a group MinHash values are compared 16 at a time, and a pair goes once the posterior probability of
   reaching the threshold (uniform prior) falls below ``tolerance``. What is left is verified by exact set
   intersection. Each node gets its number of links and a root of its links; no pair leaves the group.
5. The roots are connected across blocks, and every document takes the class of its set.

Links count pairs of documents, copies included, at similarity of at least ``NUM / DEN``. The work on a group of n
near copies is n**2 comparisons in blocks, the rows it ships n times the number of blocks.

Defined results: words are runs without space and the characters 9 to 13, taken unchanged; null, empty and blank
texts have no shingles and are alone with 0 links; repeated rows and rows without a doc_id count as documents; class_id
is the smallest doc_id of the class, null if it has none; extra columns are ignored; an empty table gives no rows.

Not every pair is looked at: a pair that shares one band alone is dropped where ``bands_needed`` is 2 (chance of 1e-6 at
similarity 0.8), and one that shares none is never met (chance of 5e-8). ``bands_needed=1`` gives the first ones back.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import U64, fresh, give_back, mix, portions, run_hashes, table, utf8, word_hashes, words
from tidewave.llm.tables import Work, components

SHINGLE, HASHES, STEP = 5, 128, 16
NUM, DEN = 4, 5
_seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
FLIPS, FACTORS = _seeds[:HASHES].astype(np.uint32), _seeds[HASHES:].astype(np.uint32) | np.uint32(1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document, one after another, and where each document's begin."""
    ws, we, at = words(data, offsets)
    hashes = word_hashes(data, ws, we)
    n = np.diff(at)
    runs = run_hashes(hashes, SHINGLE)
    owner = np.repeat(np.arange(len(n)), n)
    inside = np.flatnonzero(owner[: len(runs)] == owner[SHINGLE - 1 :]) if len(runs) else np.zeros(0, np.int64)
    values, owners = [runs[inside]], [owner[inside]]
    for k in range(1, SHINGLE):
        few = np.flatnonzero(n == k)
        if len(few):
            values.append(run_hashes(hashes, k)[at[few]])
            owners.append(few)
    value, own = np.concatenate(values), np.concatenate(owners)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[keep], own[keep]
    return value, np.searchsorted(own, np.arange(len(n) + 1))


def fingerprints(value: np.ndarray, at: np.ndarray) -> list[bytes]:
    """128 bits of each set; the same for equal sets."""
    out = np.empty((len(at) - 1, 2), U64)
    for k in range(2):
        sums = np.zeros(len(value) + 1, U64)
        np.cumsum(mix(value + U64(k * 0x9E3779B97F4A7C15 + 1)), out=sums[1:])
        out[:, k] = mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(U64))
    return [r.tobytes() for r in out]


def minhashes(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents, HASHES) of 16 bits; zeros for empty sets."""
    out = np.zeros((len(at) - 1, HASHES), np.uint16)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        low = (value >> U64(32)).astype(np.uint32)
        for i in range(HASHES):
            least = np.minimum.reduceat((low ^ FLIPS[i]) * FACTORS[i], at[some])
            out[some, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out


def least_matches(tolerance: float) -> list[int]:
    """For each STEP more values compared: the least matches at which the posterior chance of reaching NUM / DEN is ``tolerance``."""
    t, out = NUM / DEN, []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while m < n:
            total += comb(n + 1, m + 1) * t ** (m + 1) * (1 - t) ** (n - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m + 1)
    return out


def links(sets: list[np.ndarray], marks: np.ndarray, left: int, need: list[int], most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of sets at the threshold; left: pairs of the first ``left`` with the others, 0: all pairs i < j.

    They come in portions of about ``most`` candidates, so that memory does not grow with the square of the sets.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for a in range(0, left or m, 256):
        rows = np.arange(a, min(a + 256, left or m))
        for b in range(left or a, m, 2048):
            cols = np.arange(b, min(b + 2048, m))
            alive = (sizes[rows][:, None] * NUM <= sizes[cols] * DEN) & (sizes[cols] * NUM <= sizes[rows][:, None] * DEN)
            if not left:
                alive &= rows[:, None] < cols
            i, j = np.nonzero(alive)
            matched = np.zeros(len(i), np.int16)
            for k, least in enumerate(need):
                part = slice(k * STEP, (k + 1) * STEP)
                matched += (marks[rows[i], part] == marks[cols[j], part]).sum(axis=1, dtype=np.int16)
                ok = matched >= least
                i, j, matched = i[ok], j[ok], matched[ok]
            if len(i):
                found.append((rows[i], cols[j]))
        if sum(len(x) for x, _ in found) >= most:
            yield _verified(sets, sizes, found)
            found = []
    if found:
        yield _verified(sets, sizes, found)


def _verified(sets: list[np.ndarray], sizes: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    both = _intersections(sets, sizes, i, j)
    ok = both * DEN >= NUM * (sizes[i] + sizes[j] - both)
    return i[ok], j[ok]


def _intersections(sets: list[np.ndarray], sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    used = np.unique(np.concatenate([i, j]))
    value = np.concatenate([sets[u] for u in used])
    owner = np.repeat(np.arange(len(used)), sizes[used])
    _, number, count = np.unique(value, return_inverse=True, return_counts=True)
    several = count[number] > 1
    names, column = np.unique(number[several], return_inverse=True)
    owner = owner[several]
    left, right = np.unique(i), np.unique(j)
    if len(left) * len(right) * len(names) * 0.1 < len(i) * 4000 + 8 * float((sizes[i] + sizes[j]).sum()):
        total = np.zeros((len(left), len(right)), np.float32)
        width = max(1, 8_000_000 // len(used))
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for c in range(0, len(names), width):
            a, b = np.searchsorted(column, (c, c + width))
            dense = np.zeros((len(used), min(width, len(names) - c)), np.float32)
            dense[owner[a:b], column[a:b] - c] = 1
            total += dense[np.searchsorted(used, left)] @ dense[np.searchsorted(used, right)].T
        return np.rint(total[np.searchsorted(left, i), np.searchsorted(right, j)]).astype(np.int64)
    out = np.empty(len(i), np.int64)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        x, y = (sets[a], sets[b]) if sizes[a] <= sizes[b] else (sets[b], sets[a])
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        out[k] = np.count_nonzero(y[at] == x)
    return out


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each one's component."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def join(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, class_id, links) of every row of ``docs`` (doc_id, text)."""
    return classified(docs, **options).select("doc_id", "class_id", "links")


def classified(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, node, root, class_id, links) of every row: node names its set, root its class, also where doc_ids repeat."""
    return _classified(docs, **options)[0]


def _classified(docs: DataFrame, small: int = 32, block_weight: int = 1 << 20, block_rows: int = 1024, tolerance: float = 1e-6, bands_needed: int = 2, broadcast_rows: int = 500_000) -> tuple[DataFrame, int]:
    """What ``classified`` gives, and the number of its rows."""
    spark, need = docs.sparkSession, least_matches(tolerance)
    work = Work(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            value, at = shingles(*utf8(part.column(1)))
            n = np.diff(at)
            nodes = [f if k else None for f, k in zip(fingerprints(value, at), n.tolist(), strict=True)]
            bands = minhashes(value, at).view(np.int64).reshape(-1)
            ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * (HASHES // 4))
            short = pa.array([int.from_bytes(f[:8], "little", signed=True) if f else None for f in nodes], pa.int64())
            yield pa.record_batch([part.column(0), part.column(2), pa.array(nodes, pa.binary()), short, pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(bands))], names=["doc_id", "mark", "node", "id", "n", "bands"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    base = work.saved(rows.mapInArrow(sketch, f"doc_id {kind}, mark bigint, node binary, id bigint, n bigint, bands array<bigint>"))
    n_rows = base.count()
    # the row that stands for a class is known by its doc_id and its text's hash, so repeated and null ids do no harm
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("first")
    classes = work.saved(base.where("node IS NOT NULL").groupBy("node").agg(first, F.count("*").alias("copies"), F.first("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")).select("node", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), "copies", "id", "n", "bands"), n_rows)
    n_classes = classes.count()

    # candidates go by half a fingerprint: if two sets share one, both are looked at

    banded = classes.select("id", F.posexplode("bands").alias("band", "value")).select("id", F.xxhash64("band", "value").alias("bucket"))
    # written, so that the join is between plain tables and a hot bucket's rows can be split
    buckets = work.saved(banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("hub")).where("size > 1"), n_classes)
    met = work.saved(banded.join(buckets, "bucket"), n_classes)
    few = met.where(F.col("size") <= small).groupBy("bucket").agg(F.sort_array(F.collect_list("id")).alias("x"))
    pairs = few.select(F.explode(F.expr("flatten(transform(sequence(1, size(x) - 1), i -> transform(slice(x, i + 1, size(x)), y -> struct(x[i - 1] AS a, y AS b))))")).alias("p")).select("p.a", "p.b").groupBy("a", "b").count().where(F.col("count") >= bands_needed).select("a", "b")
    stars = met.where(F.col("size") > small).select(F.col("hub").alias("a"), F.col("id").alias("b")).where("a <> b").distinct()
    roots = components(work, pairs.unionByName(stars), n_classes).withColumnRenamed("node", "id")
    work.drop(met)

    members = work.saved(roots.join(classes.select("id", "node", "rep", "mark", "copies", "n"), "id").drop("id"), n_classes)
    n_members = members.count()
    weights = work.saved(members.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / block_weight), F.ceil(F.count("*") / block_rows)).cast("int").alias("blocks"), F.sum("n").alias("weight")), n_members)
    total = weights.where("blocks = 1").agg(F.sum("weight")).first()[0] or 0
    groups = max(1, -(-4 * total // block_weight))
    # block b of a component stands in the groups of all pairs that it is part of
    # components of several blocks are at most one in ``block_rows`` members or ``block_weight`` shingles
    large = weights.where("blocks > 1").select("root", "blocks")
    large = F.broadcast(large) if large.count() <= broadcast_rows else large
    placed = members.join(large, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("rep", "node", "root", "copies", "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("right"))
    spread = spread.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(groups))).otherwise(F.xxhash64("root", "i", "j")))

    def reshingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            value, at = shingles(*utf8(part.column(0)))
            prints = fingerprints(value, at)
            sets = pa.array([value[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            same = pa.array([f == x for f, x in zip(prints, part.column(1).to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(1), sets], names=["node", "set"]).filter(same)

    wanted = members.select("rep", F.col("mark").alias("same"), "node")
    if n_members <= broadcast_rows:  # 32 bytes each; beyond that both sides are shuffled
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, (F.col("mark") == F.col("same")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("text", "node")
    sets = work.saved(texts.mapInArrow(reshingle, "node binary, set binary").dropDuplicates(["node"]), 8 * n_members)  # rows of some kB

    def verify(data: pa.Table) -> pa.Table:
        value = {c: data[c].to_pylist() for c in ("root", "i", "j", "node", "copies", "right", "set")}
        parts: dict[tuple, list[int]] = {}
        for r in range(data.num_rows):
            parts.setdefault((value["root"][r], value["i"][r], value["j"][r]), []).append(r)
        out: list[tuple] = []
        for (_, i, j), some in parts.items():
            some.sort(key=lambda r: (value["right"][r], value["node"][r]))
            left = sum(not value["right"][r] for r in some) if i != j else 0
            if i != j and left in (0, len(some)):
                continue
            sets = [np.frombuffer(value["set"][r], U64) for r in some]
            marks = minhashes(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
            copies = np.array([value["copies"][r] for r in some], np.int64)
            count, every = np.zeros(len(some)), np.arange(len(some))
            root = every
            for a, b in links(sets, marks, left, need):
                count += np.bincount(a, copies[b], len(some)) + np.bincount(b, copies[a], len(some))
                root = _roots(len(some), np.concatenate([every, a]), np.concatenate([root, b]))
            out += [(value["node"][r], int(c), value["node"][some[k]]) for r, c, k in zip(some, count, root, strict=True)]
        give_back()
        node, count, root = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"node": pa.array(node, pa.binary()), "links": pa.array(count, pa.int64()), "root": pa.array(root, pa.binary())})

    verified = work.saved(spread.join(sets, "node").groupBy("bin").applyInArrow(verify, "node binary, links bigint, root binary"))
    counted = verified.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(work, verified.where("links > 0").select(F.col("root").alias("a"), F.col("node").alias("b")), n_members)
    named = linked.join(classes.select("node", "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_id"))
    found = classes.select("node", "rep", "copies").join(counted, "node", "left").join(linked, "node", "left").join(named, "root", "left")
    found = work.saved(found.select("node", F.coalesce("root", "node").alias("root"), F.coalesce("class_id", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links")), n_classes)
    work.keep_only(base, found)
    every = base.select("doc_id", "node").join(found, "node", "left").select("doc_id", "node", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return every, n_rows


def node_column(text: str = "text") -> F.Column:
    """The name of each text's set; empty where it has no words."""

    @F.arrow_udf("binary")
    def nodes(column: pa.Array) -> pa.Array:
        out: list[bytes] = []
        for part in portions(iter([pa.record_batch([column], names=["text"])]), "text"):
            value, at = shingles(*utf8(part.column(0)))
            out += [f if k else b"" for f, k in zip(fingerprints(value, at), np.diff(at).tolist(), strict=True)]
        return pa.array(out, pa.binary())

    return nodes(F.col(text).cast("string"))


def one_of_each(docs: DataFrame, broadcast_rows: int = 500_000, **options) -> DataFrame:
    """The row with the smallest doc_id of each class; rows without a doc_id stay.

    Rows of a doc_id that repeats are known by doc_id and set, so such a doc_id keeps a row for each class it stands
    for; of rows of one doc_id and set the smallest text stays, and of rows of one doc_id without words one.

    Texts meet the ids that go, far fewer than those that stay: up to ``broadcast_rows`` they are broadcast and no text
    is shuffled; beyond that both sides are, once.
    """
    node, known = fresh(docs, "node"), docs.where("doc_id IS NOT NULL")
    work = Work(docs.sparkSession)
    every, n = _classified(known, broadcast_rows=broadcast_rows, **options)
    rows = work.saved(every.select("doc_id", F.coalesce("node", F.lit(b"")).alias(node), "root"), n)
    firsts = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", node)).alias("row"), F.count("*").alias("n"))
    repeated = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    others = rows.join(firsts.where("n > 1"), "root").where(F.struct("doc_id", node) != F.col("row")).select("doc_id")
    gone = work.saved(others.unionByName(repeated).distinct(), n)
    ids = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    single = docs.join(ids, "doc_id", "left_anti").select(*docs.columns)
    if not repeated.limit(1).count():
        return single
    keep = firsts.select("row.*").unionByName(rows.where("root IS NULL").select("doc_id", node).distinct())
    named = known.join(repeated, "doc_id", "left_semi").withColumn(node, node_column()).join(keep, ["doc_id", node], "left_semi")
    one = named.groupBy("doc_id", node).agg(F.min_by(F.struct(*docs.columns), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row")).select("row.*")
    return single.unionByName(one)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))
