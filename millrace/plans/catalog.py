"""The registered queries of the engine's own operators, each beside the SQL that it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_queries, circuit_queries, corpus_queries, join_queries, measure_queries, outcome_queries, report_queries, stream_queries, text_queries, training_queries

MODULES = (corpus_queries, outcome_queries, text_queries, chat_queries, circuit_queries, stream_queries, report_queries, join_queries, measure_queries, training_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus preparation end to end: length filter, first occurrences, hash split, counts by split."""
    return corpus_queries.QUERIES["corpus_split_counts"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
