"""Pipeline from raw documents to tokens: quality, near duplicates, personal data, source mix, encoding.

Each stage works on all that the one before kept and returns the columns of ``documents``; the last returns tokens.

Defined results, stage by stage: a null, empty or blank text has a quality score like any other (that of one empty
line), is nobody's near copy, holds no personal data and is never taken by the mix. Of equal rows and near copies one
stays; rows without a doc_id stay all; a doc_id that stands for several texts keeps one row for each. A null source is a
source of its own. Extra columns go through all stages but the last. An empty table gives no rows in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm import jaccard, mixing, pieces, pii, quality
from tidewave.llm.common import fresh, table
from tidewave.llm.tables import Work, scratch


def _small_batches(spark: SparkSession) -> None:
    """Batches between Spark and Python of about 1 MB where the session has Spark's default of 64, since texts are long."""
    if spark.conf.get(key := "spark.sql.execution.arrow.maxBytesPerBatch") in ("64m", "67108864", "67108864b"):
        spark.conf.set(key, f"{1 << 20}b")


def _retold(docs: DataFrame, text: F.Column) -> DataFrame:
    """``docs`` with another text and its length."""
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line chain scores at the threshold or above."""
    _small_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "score")
    return docs.withColumn(score, quality.score_column(model)).where(F.col(score) >= quality.THRESHOLD).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    _small_batches(spark)
    return jaccard.one_of_each(docs).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    _small_batches(spark)
    return _retold(docs, pii.redact_column(pii.train(docs)))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time the mix takes a document, with its whole text; documents without words are never taken."""
    return mixing.mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, ids): every row of the mix as piece ids with an end id."""
    import public_tokenizers

    _small_batches(spark)
    blob = pieces.model_bytes(path or public_tokenizers.path("piece_bpe_32k.model"))
    rows = docs.select(F.struct("doc_id", "source").alias("row"), "text")
    return pieces.encode(rows, blob, key="row", decode=False).select("row.doc_id", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again.

    Tables of a stage are removed when its result is written, and that when the next one is; the mix's own stays, since
    the tokens are read from it (``tables.clear`` removes it).
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        work = Work(spark)
        with scratch(spark):
            docs = work.saved(stage(spark, docs, sf_dir))
        if before:
            before.clear()
        before = work
    return STAGES[-1][1](spark, docs, sf_dir)
