"""Rows and cells with missing values: drop, or fill from the rest of the column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.counts import mode_of
from sievework.functions import sketches
from sievework.functions.quantiles import quantiles
from sievework.functions.schema import (
    as_number, col, is_floating, is_missing, is_numeric, require_columns, require_numeric, type_of,
)

STRATEGIES = ("mean", "median", "mode", "constant")


def drop_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep rows without a missing value in ``cols`` (None: any column)."""
    cols = list(cols) if cols else df.columns
    require_columns(df, cols)
    keep = F.lit(True)
    for c in cols:
        keep = keep & ~is_missing(df, c)
    return df.where(keep)


def dropped_rows_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``rows_before, rows_removed, rows_after`` of :func:`drop_rows`."""
    cols = list(cols) if cols else df.columns
    require_columns(df, cols)
    any_missing = F.lit(False)
    for c in cols:
        any_missing = any_missing | is_missing(df, c)
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(any_missing).alias("rows_removed"),
        F.count_if(~any_missing).alias("rows_after"),
    )


def columns_with_missing(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    cols = list(cols) if cols else df.columns
    require_columns(df, cols)
    row = df.agg(*[F.coalesce(F.bool_or(is_missing(df, c)), F.lit(False)).alias(f"m{i}")
                   for i, c in enumerate(cols)]).first()
    return [c for i, c in enumerate(cols) if row[f"m{i}"]]


def drop_cols(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop those of ``cols`` that hold any missing value."""
    return df.drop(*columns_with_missing(df, cols))


def fit_fill(df: DataFrame, cols: Sequence[str], strategy: str, value=None, approximate: bool = False) -> dict[str, object]:
    """Fill value per column; columns without one (all missing, or text for mean) are left out.

    ``approximate`` takes medians from sketches, within their error of rank.
    """
    require_columns(df, cols)
    numeric = [c for c in cols if is_numeric(type_of(df, c))]
    if strategy == "mean":
        if not numeric:
            return {}
        row = df.agg(*[F.avg(as_number(c)).alias(f"v{i}") for i, c in enumerate(numeric)]).first()
        found = {c: row[f"v{i}"] for i, c in enumerate(numeric)}
    elif strategy == "median" and approximate:
        found = {c: q[0] for c, q in sketches.approximate(df, numeric, [0.5]).items()} if numeric else {}
    elif strategy == "median":
        found = {c: q[0] for c, q in quantiles(df, {c: as_number(c) for c in numeric}, [0.5]).items()} if numeric else {}
    elif strategy == "mode":
        found = {c: mode_of(df, c) for c in cols}
    elif strategy == "constant":
        found = {c: "0" if value is None else value for c in cols}
    else:
        raise ValueError(f"Unknown strategy: {strategy}. Choose from {STRATEGIES}")
    return {c: v for c, v in found.items() if v is not None}


def apply_fill(df: DataFrame, values: dict[str, object], into: str | None = None) -> DataFrame:
    """Replace missing cells by fitted values; works on streams too.

    A floating point value (a mean or a median) makes an integer column double;
    any other value keeps the column's type.
    """
    filled = {}
    for c, v in values.items():
        kind = type_of(df, c)
        if isinstance(v, float) and is_numeric(kind) and not is_floating(kind):
            kind = T.DoubleType()
        filled[into or c] = F.when(is_missing(df, c), F.lit(v).cast(kind)).otherwise(col(c).cast(kind))
    return df.withColumns(filled) if filled else df


def fill(df: DataFrame, cols: Sequence[str] | None = None, strategy: str = "mean", value=None,
         into: str | None = None, approximate: bool = False) -> DataFrame:
    """Fill missing values by column mean, median (exact or ``approximate``), mode or a constant."""
    cols = list(cols) if cols else df.columns
    if into and len(cols) != 1:
        raise ValueError("into needs exactly one column")
    return apply_fill(df, fit_fill(df, cols, strategy, value, approximate), into)


def fill_feature(df: DataFrame, column: str, strategy: str = "mean", value=None,
                 into: str | None = None) -> DataFrame:
    """:func:`fill` for one column that raises where no fill value exists."""
    require_columns(df, [column])
    strategy = strategy.lower()
    if strategy in ("mean", "median"):
        require_numeric(df, [column])
    if strategy == "constant" and value is None:
        raise ValueError("a fill value is required when strategy='constant'")
    fitted = fit_fill(df, [column], strategy, value)
    if strategy == "mode" and not fitted:
        raise ValueError(f"Column '{column}' has no mode available for filling")
    if not fitted:
        return df if into in (None, column) else df.withColumn(into, col(column))
    return apply_fill(df, fitted, into)


def fill_report(df: DataFrame, cols: Sequence[str], strategy: str, value=None) -> DataFrame:
    """``column, strategy, fill_value, n_filled`` of a fill."""
    fitted = fit_fill(df, cols, strategy, value)
    missing = df.agg(*[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    rows = [(c, strategy, None if fitted.get(c) is None else str(fitted[c]),
             missing[f"m{i}"] if c in fitted else 0) for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "column string, strategy string, fill_value string, n_filled long")
