"""All queries of the core with the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselar.plans import citation_queries, entity_queries, graph_queries, link_queries, pipeline_queries, retrieval_queries, text_queries  # noqa: F401
from tesselar.plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the relations are spread over their predicates."""
    return graph_queries.g_pred_cum(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
