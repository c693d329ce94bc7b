"""Categorical encoding: numbers for labels, indicator columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.schema import col, is_missing, require_categorical, require_columns

# Up to this many distinct values the value table is ranked in one task and broadcast.
SMALL_VALUE_TABLE = 100_000
VALUES_PER_RANGE = 500_000
SPLIT_CANDIDATES = 20_000
#: Indicator columns that a plan can still name; a caller may allow more.
MAX_COLUMNS = 10_000


def _text_splits(values: DataFrame, n: int) -> list[str]:
    """Texts that cut distinct values into ranges; only the balance depends on which are drawn."""
    ranges = min(1024, -(-n // VALUES_PER_RANGE))
    if ranges < 2:
        return []
    drawn = sorted(r["v"] for r in values.sample(min(1.0, SPLIT_CANDIDATES / n), seed=1).collect())
    if not drawn:
        return []
    return sorted({drawn[len(drawn) * i // ranges] for i in range(1, ranges)})


def _range_of(v: Column, splits: Sequence[str], first: int = 0) -> Column:
    """Binary search over the splits as nested conditions."""
    if not splits:
        return F.lit(first)
    mid = len(splits) // 2
    return F.when(v < splits[mid], _range_of(v, splits[:mid], first)).otherwise(
        _range_of(v, splits[mid + 1:], first + mid + 1))


def label_table(df: DataFrame, column: str, missing_text: str = "nan") -> tuple[DataFrame, bool]:
    """``v, code`` with codes 0.. in text order, and whether the table is small enough to broadcast."""
    values = df.select(F.coalesce(F.when(~is_missing(df, column), col(column).cast("string")),
                                  F.lit(missing_text)).alias("v")).distinct()
    n = values.count()
    small = n <= SMALL_VALUE_TABLE
    splits = [] if small else _text_splits(values, n)
    ranged = values.withColumn("r", _range_of(F.col("v"), splits))
    within = F.row_number().over(Window.partitionBy("r").orderBy("v"))
    if not splits:
        return ranged.select("v", (within - 1).alias("code")), small
    sizes = ranged.groupBy("r").agg(F.count(F.lit(1)).alias("held"))
    # At most 1024 range sizes, so this window is small.
    before = sizes.select("r", (F.sum("held").over(Window.orderBy("r")) - F.col("held")).alias("before"))
    return ranged.join(F.broadcast(before), "r").select(
        "v", (F.col("before") + within - 1).cast("int").alias("code")), small


def label(df: DataFrame, cols: Sequence[str], missing_text: str = "nan") -> DataFrame:
    """Replace each column by the position of its text among the sorted distinct texts.

    Missing values form a class of their own, sorted as ``missing_text``.
    """
    order = df.columns
    out = df
    for c in cols:
        if c not in df.columns:
            continue
        table, small = label_table(df, c, missing_text)
        table = table.withColumnsRenamed({"v": "_v", "code": "_code"})
        key = F.coalesce(F.when(~is_missing(out, c), col(c).cast("string")), F.lit(missing_text))
        out = out.withColumn("_key", key)
        joined = out.join(F.broadcast(table) if small else table, F.col("_key") == F.col("_v"), "left")
        out = joined.withColumn(c, F.col("_code")).select(*[col(n) for n in order])
    return out


def categories(df: DataFrame, column: str, max_values: int = MAX_COLUMNS) -> list:
    """Sorted distinct values; they are counted first, and more than ``max_values`` raise an error with their number."""
    values = df.where(~is_missing(df, column)).select(col(column).alias("v")).distinct()
    rows = values.limit(max_values + 1).collect()
    if len(rows) > max_values:
        raise ValueError(
            f"Column '{column}' has {values.count()} distinct values, more than {max_values}; one-hot encoding would add "
            "as many columns. Use label encoding or binning, or raise max_values.")
    return sorted(r["v"] for r in rows)


def one_hot(df: DataFrame, cols: Sequence[str], max_values: int = MAX_COLUMNS) -> DataFrame:
    """Replace each column by 0/1 columns ``{column}_{value}``; a missing value sets none of them.

    The result has a column for every value, all of which the plan names.
    """
    require_columns(df, cols)
    added = {}
    for c in cols:
        for v in categories(df, c, max_values):
            added[f"{c}_{v}"] = F.when(col(c) == F.lit(v), 1).otherwise(0)
    return df.withColumns(added).drop(*cols) if added else df.drop(*cols)


def one_hot_append(df: DataFrame, column: str, prefix: str | None = None, drop_first: bool = False,
                   max_values: int = 50) -> DataFrame:
    """Keep the column and append boolean columns ``{prefix}_{value}``."""
    require_categorical(df, [column])
    values = categories(df, column, max_values)
    added = {
        f"{prefix or column}_{v}": F.coalesce(col(column) == F.lit(v), F.lit(False))
        for v in (values[1:] if drop_first else values)
    }
    return df.withColumns(added) if added else df
