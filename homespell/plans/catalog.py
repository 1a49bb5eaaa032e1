"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from homespell.plans import decision_queries, ingest_queries, model_queries, study_queries

_MODULES = (ingest_queries, study_queries, decision_queries, model_queries)

QUERIES = {name: query for module in _MODULES for name, query in module.registry.queries.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["b18_repeat_sale_features"].run(spark, sf)
