"""Duplicate rows: remove, list, count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.schema import col, require_columns


def remove(df: DataFrame) -> DataFrame:
    """One copy of every row."""
    return df.dropDuplicates()


def _counted(df: DataFrame) -> DataFrame:
    """Distinct rows with their copy count ``_n``: each task collapses its copies before the one shuffle."""
    return df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))


def copies(df: DataFrame) -> DataFrame:
    """Every copy of every repeated row."""
    out = _counted(df).where("_n > 1").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.select(*[col(c) for c in df.columns])


def overview(df: DataFrame) -> DataFrame:
    """``n_rows, n_extra_copies, n_all_copies, pct`` in one row."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    share = F.round(100 * F.col("n_all_copies") / F.nullif(F.col("n_rows"), F.lit(0)), 2)
    counts = _counted(df).agg(
        total("_n").alias("n_rows"), total(F.col("_n") - 1).alias("n_extra_copies"),
        total(F.when(F.col("_n") > 1, F.col("_n"))).alias("n_all_copies"))
    return counts.withColumn("pct", F.coalesce(share, F.lit(0.0)))


def examples(df: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` copies of repeated rows, in row order of the columns."""
    return copies(df).orderBy(*[col(c) for c in df.columns]).limit(n)


def by_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column], last: bool = False) -> DataFrame:
    """First (or last) row per key in the given order, which should be free of ties.

    Written as an aggregate, so each task reduces its rows to one per key
    before anything is shuffled and a hot key costs no more than another.
    """
    require_columns(df, keys)
    order = F.struct(*[c if isinstance(c, Column) else col(c) for c in order_by])
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    row = F.struct(*[col(c) for c in rest])
    kept = (F.max_by if last else F.min_by)(row, order).alias("_kept")
    out = df.groupBy(*[col(c) for c in keys]).agg(kept)
    return out.select(*[
        col(c) if c in keys else F.col("_kept").getField(c).alias(c) for c in df.columns])
