"""All queries of the core by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rohspark.plans import data_queries, roh_queries


def queries() -> dict:
    return {**roh_queries.QUERIES, **data_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**roh_queries.SQL, **data_queries.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of homozygosity from calls to classed segments."""
    return roh_queries.roh_size_class(spark, sf_dir)
