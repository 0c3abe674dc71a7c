"""Registry of the core's queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorefield.plans import corpus_queries, event_queries, graph_queries, more_queries, row_queries, search_queries, tag_queries, vector_queries

MODULES = (search_queries, tag_queries, vector_queries, corpus_queries, graph_queries, event_queries, more_queries, row_queries)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return search_queries.R.queries["q073_multi"](spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.R.sql.items()}
