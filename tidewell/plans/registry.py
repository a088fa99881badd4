"""All queries of the catalogue, with the SQL that each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell.plans import catalogue_search, discoveries, entities, links, listings, maintenance, relations, scores, streams, texts  # noqa: F401  they register their queries
from tidewell.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["search_relevance"](spark, sf_dir)
