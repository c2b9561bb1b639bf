"""Registered queries of the timeline operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.queries import detection, forms, media, records, sources, spans, words

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**detection.QUERIES, **spans.QUERIES, **records.QUERIES, **words.QUERIES, **media.QUERIES, **forms.QUERIES, **sources.QUERIES}
ORACLE_SQL: dict[str, str] = {**detection.ORACLE_SQL, **spans.ORACLE_SQL, **records.ORACLE_SQL, **words.ORACLE_SQL, **media.ORACLE_SQL, **forms.ORACLE_SQL, **sources.ORACLE_SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which moments of a stream should a person look at, best first?"""
    return detection.ranked_moments(spark, sf_dir).orderBy("score", "source_ts", ascending=[False, True])
