"""Every query of the library outside ``llm``, by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cuelight.plans import cut_queries, editing_queries, index_queries, library_queries, retrieval_queries, scene_queries, serving_queries, text_queries

PARTS = (retrieval_queries, scene_queries, index_queries, text_queries, cut_queries, editing_queries, library_queries, serving_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for part in PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in PARTS for k, v in part.SQL.items()}
