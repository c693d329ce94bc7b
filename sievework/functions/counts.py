"""Value counts: the shared base of modes, unique counts and tops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.schema import col, is_missing


def present_value(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, in its own type."""
    return F.when(~is_missing(df, name), col(name))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """One row per distinct value (NULL included): ``value, n``."""
    return df.select(present_value(df, name).alias("value")).groupBy("value").agg(
        F.count(F.lit(1)).alias("n"))


def top_value(counts: DataFrame) -> DataFrame:
    """One row from value counts: rows, non-null rows, distinct values, most frequent value.

    Of equally frequent values the smallest wins.
    """
    known = F.col("value").isNotNull()
    first = F.min(F.when(known, F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value"))))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("count"),
        F.count_if(known).alias("unique"),
        first.alias("best"),
    ).select("rows", "count", "unique", F.col("best.value").alias("top"), (-F.col("best.neg")).alias("freq"))


def mode_of(df: DataFrame, name: str):
    """Most frequent non-missing value, or None."""
    return top_value(value_counts(df, name)).first()["top"]
