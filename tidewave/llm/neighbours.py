"""Operator 3: approximate nearest neighbours by a hierarchical navigable small-world graph per shard.

Vectors are dealt by hash into shards of about ``shard_rows`` rows. A shard holds each distinct vector as one node with
the sorted ids of its rows. Every node gets a top level by the usual geometric law (from a hash of its vector). Nodes are inserted in batches that double up to ``BATCH``: each node of a batch walks
down the graph built so far and takes the beam's nodes on each of its levels, with the nearest of its own batch, as
candidates. One is linked if it is nearer to the node than to all taken before (the rest is filled up with the
nearest), links are made mutual, and a node with too many chooses among them in the same way. Graphs are flat int32 arrays of
neighbours, one row of the index table a shard. A greedy walk through the upper levels finds an entry point; a beam of
``ef`` nodes on the lowest level finds the nearest, for a block of queries at once. Results of the shards are merged
by query.

Nearness is the largest inner product; graphs use vectors lengthened by one number that makes all norms of a shard
equal, which turns largest inner product into smallest distance. Scores are taken in double precision on the original
vectors.

Defined results: vectors that are null, zero or hold null or non-finite numbers, and rows without an id, take no part;
vectors of different lengths never meet; equal scores go by smaller id; of repeated rows only the query's own row is
left out, and equal query rows are answered once; fewer than k candidates give all of them; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import table

LINKS, LOW_LINKS = 16, 32
#: Nodes inserted at once; they see each other by exact nearness, the rest by a walk.
BATCH = 512


@dataclass
class Graph:
    ids: np.ndarray  # of rows, by node
    bounds: np.ndarray  # node i has ids[bounds[i]:bounds[i + 1]]
    vectors: np.ndarray  # float64, distinct
    members: list[np.ndarray]  # nodes of each level
    links: list[np.ndarray]  # (members, width) of node numbers, -1 for none

    @property
    def long(self) -> np.ndarray:
        return lengthen(self.vectors)


def lengthen(vectors: np.ndarray) -> np.ndarray:
    norms = (vectors * vectors).sum(axis=1)
    return np.concatenate([vectors, np.sqrt(np.maximum(norms.max() - norms, 0))[:, None]], axis=1).astype(np.float32)


def _level(vectors: np.ndarray) -> np.ndarray:
    u = np.array([int.from_bytes(hashlib.blake2b(v.tobytes(), digest_size=6).digest(), "big") for v in vectors], np.float64)
    return np.floor(-np.log((u + 1) / 2.0**48) / math.log(LINKS)).astype(int)


def _choose(long: np.ndarray, nodes: np.ndarray, cand: np.ndarray, keep: int) -> np.ndarray:
    """(nodes, keep) of diverse near ones among the candidates (nodes, c), -1 for none: diverse ones first, then near."""
    out = np.full((len(nodes), keep), -1, np.int32)
    for a in range(0, len(nodes), 256):
        own, c = nodes[a : a + 256], cand[a : a + 256]
        score = np.where(c >= 0, np.einsum("nd,ncd->nc", long[own], long[c]), -np.inf)
        order = np.argsort(-score, axis=1, kind="stable")[:, : max(48, 2 * keep)]
        c, score = np.take_along_axis(c, order, 1), np.take_along_axis(score, order, 1)
        x = long[c]
        between = np.einsum("rcd,red->rce", x, x)
        taken = np.zeros(c.shape, bool)
        for j in range(c.shape[1]):
            worst = np.where(taken, between[:, j], -np.inf).max(axis=1)
            taken[:, j] = (score[:, j] > worst) & (taken.sum(axis=1) < keep)
        key = np.where(taken, 0, 1) * c.shape[1] + np.arange(c.shape[1])
        best = np.argsort(np.where(score > -np.inf, key, 1 << 30), axis=1, kind="stable")[:, :keep]
        chosen = np.where(np.take_along_axis(score, best, 1) > -np.inf, np.take_along_axis(c, best, 1), -1)
        out[a : a + 256, : chosen.shape[1]] = chosen
    return out


def _beam(long: np.ndarray, links: np.ndarray, q: np.ndarray, at: np.ndarray, ef: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The best ``ef`` nodes (-1 for none) and scores that a walk over ``links`` from ``at`` finds for each query."""
    n, count, rows = len(long), len(q), np.arange(len(q))
    beam, score = np.full((count, ef), -1), np.full((count, ef), -np.inf, np.float32)
    opened, seen = np.ones((count, ef), bool), np.zeros((count, n + 1), bool)
    beam[:, 0], score[:, 0], opened[:, 0] = at, np.einsum("nd,nd->n", q, long[at]), False
    seen[rows, at], seen[:, n] = True, True
    active = rows
    while len(active):
        waiting = np.where(opened[active], -np.inf, score[active])
        pick = np.argsort(-waiting, axis=1, kind="stable")[:, :width]
        open_now = np.take_along_axis(waiting, pick, 1) > -np.inf
        some = open_now[:, 0]
        active, pick, open_now = active[some], pick[some], open_now[some]
        if not len(active):
            break
        opened[active[:, None], pick] = True
        near = np.where(open_now[:, :, None], links[np.where(open_now, beam[active[:, None], pick], 0)], -1).reshape(len(active), -1)
        near = np.where(near < 0, n, near)
        near.sort(axis=1)
        fresh = ~seen[active[:, None], near]
        fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
        seen[active[:, None], near] = True
        r, c = np.nonzero(fresh)
        got = np.full(near.shape, -np.inf, np.float32)
        got[r, c] = np.einsum("nd,nd->n", q[active[r]], long[near[r, c]])
        every = np.concatenate([score[active], got], axis=1)
        keep = np.argpartition(-every, ef - 1, axis=1)[:, :ef]
        score[active] = np.take_along_axis(every, keep, 1)
        beam[active] = np.take_along_axis(np.concatenate([beam[active], np.where(fresh, near, -1)], axis=1), keep, 1)
        opened[active] = np.take_along_axis(np.concatenate([opened[active], ~fresh], axis=1), keep, 1)
        opened[active] |= score[active] == -np.inf
    return np.where(score > -np.inf, beam, -1), score


def _walk(long: np.ndarray, links: np.ndarray, q: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where a greedy walk over ``links`` from ``at`` ends."""
    at, best = at.copy(), np.einsum("nd,nd->n", q, long[at])
    moving = np.arange(len(q))
    while len(moving):
        near = links[at[moving]]
        score = np.where(near >= 0, np.einsum("qd,qld->ql", q[moving], long[near]), -np.inf)
        j = score.argmax(axis=1)
        got = score[np.arange(len(moving)), j]
        up = got > best[moving]
        at[moving[up]], best[moving[up]] = near[np.arange(len(moving)), j][up], got[up]
        moving = moving[up]
    return at


def _insert(long: np.ndarray, links: list[np.ndarray], top: np.ndarray, entry: int, batch: np.ndarray, ef: int) -> None:
    """Links the nodes of ``batch`` into every one of their levels."""
    at = np.full(len(batch), entry)
    for level in range(len(links) - 1, -1, -1):
        width = links[level].shape[1]
        mine = np.flatnonzero(top[batch] >= level)
        cand = np.full((len(batch), 0), -1)
        if entry >= 0 and level <= top[entry]:
            found, score = _beam(long, links[level], long[batch], at, ef) if len(mine) == len(batch) or level == 0 else (None, None)
            if found is None:
                at = _walk(long, links[level], long[batch], at)
                found = np.full((len(batch), ef), -1)
                if len(mine):
                    found[mine], _ = _beam(long, links[level], long[batch[mine]], at[mine], ef)
            else:
                at = found[np.arange(len(batch)), score.argmax(axis=1)]
            cand = found
        if not len(mine):
            continue
        nodes = batch[mine]
        peers = long[nodes] @ long[nodes].T
        np.fill_diagonal(peers, -np.inf)
        most = min(len(nodes) - 1, 2 * width)
        near = nodes[np.argpartition(-peers, most - 1, axis=1)[:, :most]] if most > 0 else np.full((len(nodes), 0), -1)
        links[level][nodes, : width // 2] = _choose(long, nodes, np.concatenate([cand[mine], near], axis=1), width // 2)
        # links back, the nearest ones where a node has too many
        source, target = np.repeat(nodes, width // 2), links[level][nodes, : width // 2].ravel()
        source, target = source[target >= 0], target[target >= 0]
        new = ~(links[level][target] == source[:, None]).any(axis=1)
        source, target = source[new], target[new]
        if not len(target):
            continue
        order = np.lexsort((-np.einsum("nd,nd->n", long[source], long[target]), target))
        source, target = source[order], target[order]
        owner, first = np.unique(target, return_index=True)
        place = np.arange(len(target)) - np.repeat(first, np.diff(np.append(first, len(target))))
        used = (links[level][owner] >= 0).sum(axis=1)
        room = used + np.bincount(np.searchsorted(owner, target)) <= width
        easy = room[np.searchsorted(owner, target)]
        links[level][target[easy], (used[np.searchsorted(owner, target)] + place)[easy]] = source[easy]
        full, easy = owner[~room], easy | (place >= width)
        if len(full):
            more = np.full((len(full), width), -1)
            more[np.searchsorted(full, target[~easy]), place[~easy]] = source[~easy]
            links[level][full] = _choose(long, full, np.concatenate([links[level][full], more], axis=1), width)


def build(ids: np.ndarray, vectors: np.ndarray, ef: int = 64) -> Graph:
    """The graph of one shard, by insertion; ``ef`` is the beam of the walk that finds candidates."""
    vectors = np.ascontiguousarray(vectors, np.float64) + 0.0
    _, first, inverse = np.unique(vectors.view(f"V{vectors.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
    by_node = np.lexsort((ids, inverse))
    ids_sorted, bounds = ids[by_node], np.searchsorted(inverse[by_node], np.arange(len(first) + 1))
    nodes = vectors[first]
    top = _level(nodes)
    long = lengthen(nodes)
    links = [np.full((len(nodes), LOW_LINKS if level == 0 else LINKS), -1, np.int32) for level in range(int(top.max()) + 1)]
    # one of the highest level is the entry point, the others follow in a seeded order
    order = np.argsort(-top, kind="stable")
    order = np.concatenate([order[:1], np.random.default_rng(len(order)).permutation(order[1:])])
    entry, done, size = -1, 0, 64
    while done < len(order):
        _insert(long, links, top, entry, order[done : done + size], ef)
        entry, done, size = int(order[0]), done + size, min(2 * size, BATCH)
    members = [np.flatnonzero(top >= level).astype(np.int32) for level in range(len(links))]
    return Graph(ids_sorted, bounds, nodes, members, [x[m] for x, m in zip(links, members, strict=True)])


def search(graph: Graph, queries: np.ndarray, k: int, ef: int = 96) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (q, k) by falling nearness and their scores; -1 where there are fewer."""
    long, n = graph.long, len(graph.vectors)
    q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    at = np.full(len(queries), int(graph.members[-1][0]))
    for level in range(len(graph.members) - 1, 0, -1):
        links = np.full((n, graph.links[level].shape[1]), -1, np.int32)
        links[graph.members[level]] = graph.links[level]
        at = _walk(long, links, q, at)
    beam, _ = _beam(long, graph.links[0], q, at, max(ef, 2 * k))
    exact = np.where(beam >= 0, np.einsum("qd,qed->qe", queries, graph.vectors[np.maximum(beam, 0)]), -np.inf)
    smallest = np.where(beam >= 0, graph.ids[graph.bounds[np.maximum(beam, 0)]], np.iinfo(np.int64).max)
    order = np.lexsort((smallest, -exact))[:, :k]
    return np.where(np.take_along_axis(exact, order, 1) > -np.inf, np.take_along_axis(beam, order, 1), -1), np.take_along_axis(exact, order, 1)


INDEX = "dim int, shard int, ids binary, bounds binary, vectors binary, sizes array<int>, members array<binary>, links array<binary>"


def _pack(graph: Graph) -> dict:
    return {"ids": graph.ids.astype("<i8").tobytes(), "bounds": graph.bounds.astype("<i8").tobytes(), "vectors": graph.vectors.tobytes(), "sizes": [x.shape[1] for x in graph.links], "members": [x.tobytes() for x in graph.members], "links": [x.tobytes() for x in graph.links]}


def _unpack(row: dict) -> Graph:
    return Graph(np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["bounds"], "<i8"), np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]), [np.frombuffer(x, np.int32) for x in row["members"]], [np.frombuffer(x, np.int32).reshape(-1, w) for x, w in zip(row["links"], row["sizes"], strict=True)])


def clean(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v, dim) of the rows that take part."""
    v = F.col("v")
    some = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return some.where(fine).withColumn("dim", F.size("v"))


def _matrix(data: pa.Table, column: str, dim: int) -> np.ndarray:
    return data[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def index(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each shard of ``clean`` rows, with its graph as flat arrays."""

    def make(data: pa.Table) -> pa.Table:
        dim, shard = data["dim"][0].as_py(), data["shard"][0].as_py()
        graph = build(data["id"].to_numpy(), _matrix(data, "v", dim))
        return pa.Table.from_pylist([{"dim": dim, "shard": shard, **_pack(graph)}], pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("ids", pa.binary()), ("bounds", pa.binary()), ("vectors", pa.binary()), ("sizes", pa.list_(pa.int32())), ("members", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))]))

    return rows.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInArrow(make, INDEX)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, ef: int = 96, shard_rows: int = 8192, block_rows: int = 512, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` to each of ``queries`` but its own row."""
    rows, asked = clean(vectors, key, vector), clean(queries, key, vector).dropDuplicates(["id", "v"])
    shards = max(1, -(-rows.count() // shard_rows))
    blocks = max(1, -(-asked.count() // block_rows))

    def block(data: pa.Table) -> pa.Table:
        dim = data["dim"][0].as_py()
        return pa.table({"dim": pa.array([dim], pa.int32()), "qids": pa.array([data["id"].to_numpy().astype("<i8").tobytes()], pa.binary()), "qs": pa.array([_matrix(data, "v", dim).tobytes()], pa.binary())})

    packed = asked.withColumn("block", F.pmod(F.xxhash64("id", "v", F.lit("block")), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInArrow(block, "dim int, qids binary, qs binary")
    spread = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                graph = _unpack(row)
                qids, qs = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["qs"], np.float64).reshape(-1, row["dim"])
                nodes, scores = search(graph, qs, k + 1, ef)
                found = []
                for qid, q, ns, ss in zip(qids.tolist(), qs, nodes, scores, strict=True):
                    mine: list[dict] = []
                    for node, score in zip(ns.tolist(), ss.tolist(), strict=True):
                        if node >= 0:
                            ids = graph.ids[graph.bounds[node] : graph.bounds[node + 1]]
                            some = ids[: k + 1].tolist()
                            own = bool((graph.vectors[node] == q).all())
                            if own and qid not in some and qid in ids:
                                some.append(qid)
                            mine += [{"score": score, "vec_id": x, "own": own and x == qid} for x in some]
                    mine.sort(key=lambda x: (-x["score"], x["vec_id"]))
                    found.append([x for j, x in enumerate(mine) if j <= k or x["own"]])
                kind = pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("own", pa.bool_())]))
                marks = [int.from_bytes(hashlib.blake2b(q.tobytes(), digest_size=8).digest(), "little", signed=True) for q in qs]
                yield pa.record_batch([pa.array(qids), pa.array(marks, pa.int64()), pa.array(found, kind)], names=["query_id", "mark", "found"])

    hits = spread.join(index(rows, shards), ["dim", "shard"]).select("dim", "qids", "qs", "ids", "bounds", "vectors", "sizes", "members", "links").mapInArrow(run, "query_id bigint, mark bigint, found array<struct<score:double,vec_id:bigint,own:boolean>>")
    merged = hits.groupBy("query_id", "mark").agg(F.flatten(F.collect_list("found")).alias("f"))
    own = F.filter("f", lambda x: x["own"])
    # of equal rows with the query's id one is the query itself
    rest = F.concat(F.filter("f", lambda x: ~x["own"]), F.slice(own, 2, F.greatest(F.size(own), F.lit(1))))
    ordered = F.slice(F.array_sort(F.transform(rest, lambda x: F.struct((-x["score"]).alias("far"), x["vec_id"].alias("vec_id")))), 1, k)
    return merged.select("query_id", F.posexplode(ordered).alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
