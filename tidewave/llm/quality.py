"""Operator 7: document quality from a linear-chain conditional random field over lines.

Every line is described by its make-up (length, capitals, symbols, digits, word lengths, words that repeat the one
before) and by that of the lines next to it. A two-state chain labels lines good or bad; a document's score is the
mean of its lines' forward-backward marginals of good, weighted by their lengths; a logistic fit of two numbers
then makes it a chance of label 1.

Labels mark documents, so in training each line bears its document's label. The chain is fitted on at most
``train_docs`` labelled documents (smallest hashes of doc_id); everything else covers all rows and whole texts.

Defined results: null, empty and blank texts are one empty line and get that line's marginal; equal texts get equal
scores; lines are what \\n separates; extra columns are kept by ``score_column``; an empty table of labels gives a
constant score of 0.5; a null doc_id has no label and its ``held_out`` is false; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import BYTE_POWERS, BYTE_VALUES, IS_SPACE, portions, sampled, slice_hashes, table, utf8, words

N_OWN = 10
THRESHOLD = 0.3
_bytes = np.arange(256)
IS_UPPER = ((_bytes >= 65) & (_bytes <= 90)).astype(np.int64)
IS_DIGIT = ((_bytes >= 48) & (_bytes <= 57)).astype(np.int64)
IS_LETTER = (((_bytes | 32) >= 97) & ((_bytes | 32) <= 122) | (_bytes >= 128)).astype(np.int64)
IS_POINT = np.isin(_bytes, list(b".,;:'\"-()?")).astype(np.int64)
IS_SYMBOL = ((_bytes > 32) & (_bytes < 127) & (IS_LETTER + IS_DIGIT + IS_POINT == 0)).astype(np.int64)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with those of their neighbours, length weights, and each document's first line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([breaks + 1, offsets]))
    starts = starts[starts < len(data)]
    # a document that is empty, or ends in a break, still has its last, empty line
    owner = np.searchsorted(offsets, breaks, "right") - 1
    first = np.arange(len(offsets) - 1) + np.searchsorted(breaks, offsets[:-1])
    total = len(breaks) + len(offsets) - 1
    begin, end = np.empty(total, np.int64), np.empty(total, np.int64)
    is_first = np.zeros(total, bool)
    is_first[first] = True
    begin[is_first], begin[~is_first] = offsets[:-1], breaks + 1
    is_last = np.append(is_first[1:], True)
    end[is_last], end[~is_last] = offsets[1:], breaks
    del starts, owner

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(flags[data], out=sums[1:])
        return sums[end] - sums[begin]

    ws, we, _ = words(data, offsets)
    hashes = slice_hashes(BYTE_VALUES[data], ws, we, BYTE_POWERS) if len(ws) else np.zeros(0, np.uint64)
    w0, w1 = np.searchsorted(ws, begin), np.searchsorted(ws, end)
    same = np.zeros(len(ws) + 1, np.int64)
    same[2:] = np.cumsum(hashes[1:] == hashes[:-1]) if len(ws) > 1 else 0
    lone = np.zeros(len(ws) + 1, np.int64)
    np.cumsum((we - ws == 1) & (IS_SYMBOL[data[ws]] > 0), out=lone[1:])
    n = np.maximum(end - begin, 1).astype(np.float64)
    n_words = (w1 - w0).astype(np.float64)
    letters, upper, symbols = count(IS_LETTER), count(IS_UPPER), count(IS_SYMBOL)
    solid = np.maximum(count((~IS_SPACE).astype(np.int64)), 1)
    per_word = np.maximum(n_words, 1)
    repeats = np.where(n_words > 1, same[w1] - same[np.minimum(w0 + 1, w1)], 0)
    own = np.stack([np.log1p(end - begin) / 8, upper / np.maximum(letters, 1), symbols / solid, count(IS_DIGIT) / solid, count(IS_POINT) / solid, np.minimum(solid / per_word / 10, 3), repeats / np.maximum(n_words - 1, 1), (lone[w1] - lone[w0]) / per_word, (n_words == 0).astype(np.float64), np.minimum(symbols / per_word, 3)], axis=1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][~is_first[1:]] = own[:-1][~is_first[1:]]
    after[:-1][~is_last[:-1]] = own[1:][~is_last[:-1]]
    return np.concatenate([own, before, after, np.ones((total, 1))], axis=1), n, first


@dataclass(frozen=True)
class ChainModel:
    """Weights of good over bad, and the 2 x 2 log-potentials of neighbouring states."""

    weights: np.ndarray
    links: np.ndarray
    scale: tuple[float, float] = (0.0, 1.0)

    def marginals(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of each line and the expected counts of neighbouring states, by scaled forward-backward."""
        total = len(x)
        ends = np.append(first[1:], total)
        lengths = ends - first
        order = np.argsort(-lengths, kind="stable")
        begin, lengths = first[order], lengths[order]
        z = np.clip(x @ self.weights, -30, 30) / 2
        local = np.exp(np.stack([-z, z], axis=1))
        local /= local.sum(axis=1, keepdims=True)
        links = np.exp(self.links)
        forward, backward = np.empty((total, 2)), np.ones((total, 2))
        longest = int(lengths[0]) if len(lengths) else 0
        active = np.searchsorted(-lengths, -np.arange(longest), "left")  # documents longer than t
        for t in range(longest):
            at = begin[: active[t]] + t
            a = local[at] if t == 0 else (forward[at - 1] @ links) * local[at]
            forward[at] = a / a.sum(axis=1, keepdims=True)
        pairs = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            at = begin[: active[t + 1]] + t
            b = local[at + 1] * backward[at + 1]
            m = forward[at][:, :, None] * links[None] * b[:, None, :]
            pairs += (m / m.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            b = b @ links.T
            backward[at] = b / b.sum(axis=1, keepdims=True)
        p = forward * backward
        return p[:, 1] / p.sum(axis=1), pairs

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, n, first = line_features(data, offsets)
        good, _ = self.marginals(x, first)
        share = np.add.reduceat(good * n, first) / np.add.reduceat(n, first)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] + self.scale[1] * odds(share), -40, 40)))


def odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 0.001, 0.999)
    return np.log(share / (1 - share))


def calibrate(share: np.ndarray, y: np.ndarray, steps: int = 50, decay: float = 0.02) -> tuple[float, float]:
    """Logistic fit of document labels on the log-odds of their weighted marginals, by Newton steps."""
    p = np.array([0.0, 1.0])
    x = np.stack([np.ones(len(share)), odds(share)], axis=1)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -40, 40)))
        g = x.T @ (y - q) - decay * (p - (0.0, 1.0))
        h = (x * (q * (1 - q))[:, None]).T @ x + decay * np.eye(2)
        p = p + np.clip(np.linalg.solve(h, g), -2, 2)
    return float(p[0]), float(p[1])


def fit(x: np.ndarray, y: np.ndarray, first: np.ndarray, steps: int = 150, rate: float = 0.2, decay: float = 2e-4) -> ChainModel:
    """Maximum likelihood with weight decay by Adam over all lines; y has a label for each line."""
    model = ChainModel(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if not len(x):
        return model
    inner = np.ones(len(x), bool)
    inner[first] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    p, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
    for step in range(1, steps + 1):
        model = ChainModel(p[:-4], p[-4:].reshape(2, 2))
        good, pairs = model.marginals(x, first)
        g = np.concatenate([x.T @ (y - good), (seen - pairs).ravel()]) / len(x) - decay * p
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ChainModel(p[:-4], p[-4:].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 4000, folds: int = 5, train_lines: int = 1000) -> ChainModel:
    """Fits on at most ``train_docs`` labelled documents outside fold 0; only line features reach the driver.

    At most ``train_lines`` lines of a document, spread evenly over it, are used, which bounds what the driver holds.
    """
    some = labels.where(F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != 0)).select("doc_id", "quality")
    sample = sampled(some, F.col("doc_id"), train_docs).select("doc_id", "quality")

    @F.arrow_udf("binary")
    def described(text: pa.Array) -> pa.Array:
        out = []
        for part in portions(iter([pa.record_batch([text], names=["text"])]), "text"):
            x, _, first = line_features(*utf8(part.column(0)))
            out += [a[np.arange(0, len(a), -(-len(a) // train_lines))].astype(np.float32).tobytes() for a in np.split(x, first[1:])]
        return pa.array(out, pa.binary())

    # one text for each sampled label, however often its doc_id is repeated
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = texts.select("doc_id", "quality", described("text").alias("x")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["quality"], r["x"]))
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, 3 * N_OWN + 1).astype(np.float64) for r in rows]
    if not parts:
        return fit(np.zeros((0, 3 * N_OWN + 1)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    sizes = [len(p) for p in parts]
    x, first, y = np.concatenate(parts), np.cumsum([0, *sizes[:-1]]), np.array([r["quality"] for r in rows])
    model = fit(x, np.repeat(y, sizes), first)
    n = np.maximum(1, np.expm1(x[:, 0] * 8))  # line lengths
    good, _ = model.marginals(x, first)
    share = np.add.reduceat(good * n, first) / np.add.reduceat(n, first)
    return replace(model, scale=calibrate(share, y))


def score_column(model: ChainModel, text: str = "text") -> F.Column:
    """Quality score of a text column, computed once for each row."""

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        out = [model.scores(*utf8(part.column(0))) for part in portions(iter([pa.record_batch([column], names=["text"])]), "text")]
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return scored.asNondeterministic()(F.col(text).cast("string"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", score_column(model).alias("score"))
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
