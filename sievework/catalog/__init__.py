"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievework.catalog import (  # noqa: F401
    activity, charts, cleaning, deriving, fitting, profiling, storing, testing,
)
from sievework.catalog.registry import QUERIES, SQL, Query


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["clean_and_summarise"](spark, folder)
