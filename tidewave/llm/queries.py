"""Queries and SQL of this subpackage for the driver's registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewave.llm import bytepairs, jaccard, language, media, mixing, neighbours, pages, pieces, pii, quality, resampling, substrings, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1,
    "op2_media_columns": media.op2,
    "op3_neighbours": neighbours.op3,
    "op4_html_extraction": pages.op4,
    "op5_language_id": language.op5,
    "op6_sentencepiece": pieces.op6,
    "op7_quality": quality.op7,
    "op8_jaccard_join": jaccard.op8,
    "op9_mixing": mixing.op9,
    "op10_substring_dedup": substrings.op10,
    "op11_whitening": whitening.op11,
    "op12_byte_pairs": bytepairs.op12,
    "op13_resampling": resampling.op13,
}

ORACLE_SQL: dict[str, str] = {"op9_mixing": mixing.OP9_SQL, "op13_resampling": resampling.OP13_SQL}
