"""All queries of the library's own operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.plans import pair_queries, sequence_queries, source_queries, structure_queries, vector_queries  # noqa: F401
from pairloom.plans.catalog import ORACLES, QUERIES, Query


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs without excluded ids, weighted by score bin, with their vectors' cosine: weighted error by bin."""
    return pair_queries.weighted_cosine_error(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
