"""Operator 5: language identification by hierarchical discrimination.

Texts become relative counts of hashed byte 1-, 2- and 3-grams (case folded, other signs as one space). Linear
support vector machines with squared hinge loss first tell families of languages apart (one against the rest), then
one-versus-one machines tell the languages of the chosen family apart by votes, ties by summed margins. All margins
are sums of weights over the n-grams of the whole text.

Machines are fitted on at most ``per_lang`` documents (smallest hashes) of each language, outside the held-out fold;
a doc_id that repeats counts once for a language, with its smallest text. Predictions read only the text.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no training rows every text
is ``und``; with one language every other text is that language; a null doc_id is held out of training, and its
``held_out`` is false; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import portions, sampled, table, utf8

# Families of languages by code; a language not named is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr"),
}
DIM = 1 << 12
_b = np.arange(256)
FOLDED = np.where((_b >= 65) & (_b <= 90), _b + 32, _b)
FOLDED = np.where(((FOLDED >= 97) & (FOLDED <= 122)) | (_b >= 128), FOLDED, 32).astype(np.uint32)


def family(lang: str) -> str:
    return next((k for k, v in FAMILIES.items() if lang in v), lang)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature number of each n-gram, and how many n-grams stand before each document's first.

    A space stands before every document; n-grams that hold nothing but spaces have the number 0 and weigh nothing.
    """
    n = len(offsets) - 1
    code = np.full(len(data) + n, 32, np.uint32)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    code[at] = FOLDED[data]
    latin = np.flatnonzero((code[:-1] == 0xC3) & (code[1:] >= 0x80) & (code[1:] <= 0x9E)) + 1
    code[latin] += 32
    begin = offsets[:-1] + np.arange(n)
    one = code.copy()
    two = code.copy()
    two[1:] += code[:-1] << np.uint32(8)
    three = two.copy()
    three[2:] += code[:-2] << np.uint32(16)
    two[begin], three[begin] = 32, 32
    inner = begin[begin + 1 < len(code)] + 1
    three[inner] = two[inner]
    every = np.empty((len(code), 3), np.uint32)
    for k, (x, blank) in enumerate(((one, 0x20), (two, 0x2020), (three, 0x202020))):
        every[:, k] = (x * np.uint32(2654435761) + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(20)
        every[(x == blank) | (x == 32) | (x == 0x2020), k] = 0
    return every, np.append(begin, len(code))


def histograms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    every, begin = grams(data, offsets)
    out = np.zeros((len(offsets) - 1, DIM), np.float32)
    for i in range(len(out)):
        x = every[begin[i] : begin[i + 1]].ravel()
        c = np.bincount(x[x > 0], minlength=DIM)
        out[i] = c / max(1, c.sum())
    return out


def svm(x: np.ndarray, y: np.ndarray, steps: int = 200, cost: float = 1e-5, rate: float = 2.0) -> np.ndarray:
    """Weights and bias (last) for y of 1 and -1: squared hinge loss with weight decay, by Adam from zero."""
    w, m, v = np.zeros(x.shape[1] + 1), 0.0, 0.0
    balance = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    for step in range(1, steps + 1):
        loss = np.maximum(0, 1 - y * (x @ w[:-1].astype(np.float32) + w[-1])) * y * balance
        g = np.append(x.T @ loss.astype(np.float32), loss.sum()) - cost * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += rate * (0.98**step) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w


@dataclass(frozen=True)
class Hierarchy:
    families: tuple[tuple[str, tuple[str, ...]], ...]
    weights: np.ndarray  # a column for each family (if there are two or more) and then for each pair within families

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(offsets) - 1
        if not self.families:
            return ["und"] * n, np.zeros(n)
        every, begin = grams(data, offsets)
        some = np.add.reduceat((every > 0).sum(axis=1), begin[:-1]) if n else np.zeros(0)
        margin = np.empty((n, self.weights.shape[1]))
        for j in range(self.weights.shape[1]):
            w = self.weights[:-1, j].astype(np.float32).copy()
            w[0] = 0
            hit = w[every[:, 0]] + w[every[:, 1]] + w[every[:, 2]]
            margin[:, j] = np.add.reduceat(hit.astype(np.float64), begin[:-1]) / np.maximum(some, 1) + self.weights[-1, j]
        chance = 1 / (1 + np.exp(-np.clip(3 * margin, -50, 50)))
        several = len(self.families) > 1
        top = margin[:, : len(self.families)].argmax(axis=1) if several else np.zeros(n, int)
        score = chance[np.arange(n), top] if several else np.ones(n)
        langs, column = np.empty(n, object), len(self.families) if several else 0
        for f, (_, members) in enumerate(self.families):
            votes, sums, sure = np.zeros((n, len(members))), np.zeros((n, len(members))), np.ones((n, len(members)))
            for a, b in combinations(range(len(members)), 2):
                d, c = margin[:, column], chance[:, column]
                votes[:, a] += d >= 0
                votes[:, b] += d < 0
                sums[:, a] += np.tanh(d)
                sums[:, b] -= np.tanh(d)
                sure[:, a], sure[:, b] = np.minimum(sure[:, a], c), np.minimum(sure[:, b], 1 - c)
                column += 1
            best = (votes * 1000 + sums).argmax(axis=1)
            mine = top == f
            langs[mine] = np.array(members, object)[best[mine]]
            score[mine] *= sure[np.arange(n), best][mine]
        return langs.tolist(), score


def fit(x: np.ndarray, langs: list[str]) -> Hierarchy:
    known = sorted(set(langs))
    groups = sorted({family(k) for k in known})
    families = tuple((g, tuple(k for k in known if family(k) == g)) for g in groups)
    lang, of = np.array(langs, object), np.array([family(k) for k in langs], object)
    columns = [svm(x, np.where(of == g, 1.0, -1.0)) for g in groups] if len(groups) > 1 else []
    for _, members in families:
        for a, b in combinations(members, 2):
            rows = (lang == a) | (lang == b)
            columns.append(svm(x[rows], np.where(lang[rows] == a, 1.0, -1.0)))
    return Hierarchy(families, np.stack(columns, axis=1) if columns else np.zeros((DIM + 1, 0)))


def train(docs: DataFrame, per_lang: int = 1000, folds: int = 3, held: int = 1) -> Hierarchy:
    """Fits on at most ``per_lang`` doc_ids of each language outside the held-out fold; only histograms reach the driver."""
    some = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % folds != held)).select("doc_id", "lang")
    sample = sampled(some, F.col("doc_id"), per_lang, by="lang").select("doc_id", "lang")

    @F.arrow_udf("binary")
    def described(text: pa.Array) -> pa.Array:
        out = []
        for part in portions(iter([pa.record_batch([text], names=["text"])]), "text"):
            out += [r.astype(np.float16).tobytes() for r in np.sqrt(histograms(*utf8(part.column(0))))]
        return pa.array(out, pa.binary())

    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text").join(F.broadcast(sample), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("doc_id", "lang", described("text").alias("x")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["x"]))
    if not rows:
        return Hierarchy((), np.zeros((DIM + 1, 0)))
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32) ** 2
    return fit(x, [r["lang"] for r in rows])


def language_columns(model: Hierarchy, text: str = "text") -> F.Column:
    """Struct (lang, score) of a text column, computed once for each row."""
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def predicted(column: pa.Array) -> pa.Array:
        langs, scores = [], []
        for part in portions(iter([pa.record_batch([column], names=["text"])]), "text"):
            a, b = model.predict(*utf8(part.column(0)))
            langs += a
            scores += b.tolist()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))

    return predicted.asNondeterministic()(F.col(text).cast("string"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs)
    found = docs.select("doc_id", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("some"), language_columns(model).alias("p"))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"), F.when(F.col("some"), F.col("p.lang")).otherwise("und").alias("lang_pred"), F.when(F.col("some"), F.col("p.score")).otherwise(0.0).alias("score"))
