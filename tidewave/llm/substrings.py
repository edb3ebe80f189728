"""Operator 10: removal of long repeated word sequences by de Bruijn compaction.

Edges of the graph are the windows of ``span`` consecutive words. Each window has a minimizer, the leftmost smallest
hash among its runs of ``SEED`` words, which depends on its words alone, so equal windows have equal minimizers.
Neighbouring windows with one minimizer form a segment: a path of edges that one hash stands for.

1. Segments are counted by minimizer; only those whose minimizer stands in several segments go on.
2. Segments that are found whole more than once are repeated edges altogether. Each such kind keeps the coordinates of
   its first and last source; the words that stand there are read and compared, and a kind whose words differ goes.
   Where segments with one minimizer differ, their windows are compared one by one: once for every distinct segment,
   at its first source coordinates.
3. Repeated segments that follow each other in a text are joined to longer paths wherever the graph does not branch
   (each has one follower and each follower one predecessor), by joins on segments; a text keeps one row for a path.
4. Each text is joined with its repeated paths and windows; covered words are removed, judged on the input.

A window is known by 128 bits: a 64-bit hash of its minimizer and one of all its words, built on two independent hashes
of words; a text by two 64-bit hashes of its whole text. Texts that occur more than once count as often as they occur. Counts are combined
before each shuffle, so hot passages do not gather in one task; lists are held by text alone, never by passage.

Defined results: words are runs without space and the characters 9 to 13, taken unchanged; null counts as empty; texts
of fewer than ``span`` words keep all words; repeated rows repeat each other; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewave.llm.common import WORD_POWERS, WORD_POWERS2, mix, portions, run_hashes, slice_hashes, table, utf8, word_hashes, words
from tidewave.llm.tables import Work

SPAN, SEED = 35, 6
LOOKED = ["k1", "k2", "start", "lone", "seed", "whole", "told"]


def windows(data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """Second word hashes, each document's first word, and of every window its first word, document and minimizer's place and hash."""
    ws, we, at = words(data, offsets)
    hashes = word_hashes(data, ws, we)
    others = word_hashes(data, ws, we, second=True)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    if len(hashes) < span:
        none = np.zeros(0, np.int64)
        return others, at, none, none, none, np.zeros(0, np.uint64)
    first = np.flatnonzero(owner[: len(owner) - span + 1] == owner[span - 1 :])
    seeds = run_hashes(hashes, SEED)
    places = np.lib.stride_tricks.sliding_window_view(seeds, span - SEED + 1)
    place = np.concatenate([x + places[x].argmin(axis=1) for x in np.array_split(first, max(1, len(first) // 100_000))])
    return others, at, first, owner[first], place, seeds[place]


def segments(data: np.ndarray, offsets: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """(document, start, windows, minimizer, hash) of all segments; start counts words within the document."""
    hashes, at, first, owner, place, seed = windows(data, offsets, span)
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none
    new = np.ones(len(first), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(first)))
    start = first[begin]
    whole = mix(slice_hashes(hashes, start, start + n + span - 1, WORD_POWERS2))
    return owner[begin], start - at[owner[begin]], n, seed[begin].view(np.int64), whole.view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", text.alias("text")).withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit("b"), "text")})


def repeated_spans(docs: DataFrame, work: Work, span: int = SPAN) -> DataFrame:
    """(k1, k2, spans): for each text that has any, the word ranges of its repeated paths and windows."""
    keyed = _keyed(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            doc, start, n, seed, whole = segments(*utf8(part.column(2)), span)
            own = pa.array(doc)
            yield pa.record_batch([part.column(0).take(own), part.column(1).take(own), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(seed), pa.array(whole)], names=["k1", "k2", "start", "n", "seed", "whole"])

    # what is joined below is written first, so that joins are between plain tables and hot keys can be split
    found = work.saved(keyed.select("k1", "k2", "text").mapInArrow(cut, "k1 bigint, k2 bigint, start int, n int, seed bigint, whole bigint"))
    several = work.saved(found.groupBy("seed").agg(F.count("*").alias("times"), F.min("whole").alias("low"), F.max("whole").alias("high")).where("times > 1").select("seed", (F.col("low") != F.col("high")).alias("mixed")))
    shared = work.saved(found.join(several, "seed"))
    work.drop(found)
    at = F.struct("k1", "k2", "start", "n")
    kinds = work.saved(shared.groupBy("seed", "whole", "mixed").agg(F.count("*").alias("times"), F.min(at).alias("source"), F.max(at).alias("last")))

    kind = ["seed", "whole"]
    windowed = kinds.where("mixed").select("source.*", (F.col("times") == 1).alias("lone"), F.lit(False).alias("told"), *kind)
    several_places = kinds.where("source <> last")
    told = [several_places.select(f"{c}.*", F.lit(False).alias("lone"), F.lit(True).alias("told"), *kind) for c in ("source", "last")]
    asked = windowed.unionByName(told[0]).unionByName(told[1])
    asked = work.saved(asked.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "n", "lone", "told", *kind)).alias("asked")))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            data, offsets = utf8(part.column(2))
            hashes, at, first, owner, _, seed = windows(data, offsets, span)
            ws, we, _ = words(data, offsets)
            raw = data.tobytes()
            whole = mix(slice_hashes(hashes, first, first + span, WORD_POWERS)) if len(first) else first
            base = np.searchsorted(owner, np.arange(part.num_rows))
            rows, places, lone, read = [], [], [], []
            for row, some in enumerate(part.column(3).to_pylist()):
                for x in some:
                    if x["told"]:
                        a = at[row] + x["start"]
                        b = a + x["n"] + span - 1
                        read.append((x["seed"], x["whole"], b" ".join(raw[i:j] for i, j in zip(ws[a:b].tolist(), we[a:b].tolist(), strict=True))))
                    else:
                        k = np.arange(x["start"], x["start"] + x["n"])
                        rows.append(np.full(len(k), row))
                        places.append(k)
                        lone.append(np.full(len(k), x["lone"]))
            row, place = np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *places])
            own, window = pa.array(row), base[row] + place
            blank = lambda kind, n: pa.nulls(n, kind)
            yield pa.record_batch([part.column(0).take(own), part.column(1).take(own), pa.array(place.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, bool), *lone])), pa.array(seed[window].view(np.int64)), pa.array(whole[window].view(np.int64)), blank(pa.binary(), len(row))], names=LOOKED)
            seeds, wholes, told = zip(*read, strict=True) if read else ((), (), ())
            n = len(read)
            yield pa.record_batch([blank(pa.int64(), n), blank(pa.int64(), n), blank(pa.int32(), n), blank(pa.bool_(), n), pa.array(seeds, pa.int64()), pa.array(wholes, pa.int64()), pa.array(told, pa.binary())], names=LOOKED)

    looked = work.saved(keyed.select("k1", "k2", "text").join(asked, ["k1", "k2"]).mapInArrow(look, "k1 bigint, k2 bigint, start int, lone boolean, seed bigint, whole bigint, told binary"))
    single = looked.where("told IS NULL")
    again = work.saved(single.groupBy("seed", "whole").agg(F.count("*").alias("times")).where("times > 1").select("seed", "whole"))
    alone = single.where("lone").join(again, ["seed", "whole"]).select("k1", "k2", "start", (F.col("start") + span).alias("end"))

    # kinds whose words are not the same at both sources
    false = looked.where("told IS NOT NULL").groupBy(kind).agg((F.min("told") != F.max("told")).alias("differs")).where("differs").select(kind)
    true = kinds.where("times > 1").select(kind).join(false, kind, "left_anti")
    paths = compact(work, shared.join(work.saved(true), kind), span)
    return paths.unionByName(alone).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def compact(work: Work, repeated: DataFrame, span: int = SPAN) -> DataFrame:
    """(k1, k2, start, end): repeated segments of each text joined to paths that do not branch."""
    once = repeated.groupBy("k1", "k2", "start").agg(F.first("n").alias("n"), F.first(F.xxhash64("seed", "whole")).alias("edge"))
    along = Window.partitionBy("k1", "k2").orderBy("start")
    follows = F.lead("start").over(along) == F.col("start") + F.col("n")
    steps = work.saved(once.select("k1", "k2", "start", "n", "edge", F.when(follows, F.lead("edge").over(along)).alias("next")))
    links = steps.where("next IS NOT NULL").select("edge", "next").distinct()
    one_after = links.groupBy("edge").agg(F.min("next").alias("next"), F.count("*").alias("ways")).where("ways = 1").select("edge", "next")
    one_before = links.groupBy("next").agg(F.count("*").alias("ways")).where("ways = 1").select("next")
    straight = one_after.join(one_before, "next").withColumn("straight", F.lit(True))
    joined = steps.join(straight, ["edge", "next"], "left")
    breaks = joined.withColumn("new", F.when(F.coalesce(F.lag("straight").over(along), F.lit(False)), 0).otherwise(1))
    numbered = breaks.withColumn("path", F.sum("new").over(along))
    return numbered.groupBy("k1", "k2", "path").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("stop")).select("k1", "k2", "start", (F.col("stop") + span - 1).alias("end"))


def remove(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept words are joined by one space."""
    work = Work(docs.sparkSession)
    spans = work.saved(repeated_spans(docs, work, span))
    work.keep_only(spans)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text"):
            data, offsets = utf8(part.column(1))
            ws, we, at = words(data, offsets)
            raw, gone, kept = data.tobytes(), [], []
            for row, some in enumerate(part.column(2).to_pylist()):
                mine = slice(at[row], at[row + 1])
                marks = np.zeros(at[row + 1] - at[row] + 1, np.int64)
                if some:
                    np.add.at(marks, [x["start"] for x in some], 1)
                    np.add.at(marks, [x["end"] for x in some], -1)
                out = np.cumsum(marks[:-1]) > 0
                gone.append(int(out.sum()))
                kept.append(b" ".join(raw[a:b] for a, b in zip(ws[mine][~out].tolist(), we[mine][~out].tolist(), strict=True)).decode())
            yield pa.record_batch([part.column(0), pa.array(np.diff(at)), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = _keyed(docs).join(spans, ["k1", "k2"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(keep, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
