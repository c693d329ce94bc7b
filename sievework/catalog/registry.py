"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL where SQL can express it on whole tables."""
    def register(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query '{name}' exists")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round double columns, so that the order of summation does not show."""
    return df.withColumns({n: F.round(F.col(n), digits) for n in names})


def sql_left_bin(x: str, lo: str, width: str, n: int) -> str:
    """SQL twin of left-closed bins."""
    g = f"least(greatest(floor(({x} - {lo}) / {width}), 0), {n - 1})"
    moved = (f"CASE WHEN {x} < {lo} + {g} * {width} THEN {g} - 1 "
             f"WHEN {x} >= {lo} + ({g} + 1) * {width} THEN {g} + 1 ELSE {g} END")
    return f"CAST(least(greatest({moved}, 0), {n - 1}) AS INTEGER)"


def sql_right_bin(x: str, lo: str, width: str, n: int) -> str:
    """SQL twin of right-closed bins."""
    g = f"least(greatest(ceil(({x} - {lo}) / {width}) - 1, 0), {n - 1})"
    moved = (f"CASE WHEN {x} <= {lo} + {g} * {width} THEN {g} - 1 "
             f"WHEN {x} > {lo} + ({g} + 1) * {width} THEN {g} + 1 ELSE {g} END")
    return f"CAST(least(greatest({moved}, 0), {n - 1}) AS INTEGER)"
