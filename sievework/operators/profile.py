"""Summaries of a table and of single columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.bins import histogram_bins, value_ranges
from sievework.functions.counts import top_value, value_counts
from sievework.functions.quantiles import grouped_quantiles, quantiles
from sievework.functions.schema import (
    as_number, col, is_missing, is_numeric, numeric_columns, require_categorical, require_columns,
    require_numeric, type_of,
)
from sievework.functions.stats import sample_kurtosis, sample_skewness
from sievework.functions.work import one_row
from sievework.operators import dedup


def _stacked(row: DataFrame, entries: Sequence[Column]) -> DataFrame:
    """One wide row of aggregates as one row per entry."""
    return row.select(F.inline(F.array(*entries)))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _missing_counts(df: DataFrame) -> list[Column]:
    return [F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)]


def overview(df: DataFrame) -> DataFrame:
    """``n_rows, n_cols, n_missing, n_duplicates, numeric_columns, categorical_columns`` in one row.

    Duplicates are the copies beyond the first; the column lists are comma separated.
    """
    counts = df.agg(*_missing_counts(df))
    total = reduce(lambda a, b: a + b, [F.col(f"m{i}") for i in range(len(df.columns))])
    numeric = numeric_columns(df)
    others = [c for c in df.columns if c not in numeric]
    table = counts.select(total.alias("n_missing")).withColumn("d", one_row(dedup.overview(df)))
    return table.select(
        "d.n_rows", F.lit(len(df.columns)).alias("n_cols"), "n_missing",
        F.col("d.n_extra_copies").alias("n_duplicates"), F.lit(",".join(numeric)).alias("numeric_columns"),
        F.lit(",".join(others)).alias("categorical_columns"))


def columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """``column, dtype, non_null, missing, missing_pct, unique`` per column.

    Each column is counted by value in its own small plan that reads only that
    column; several distinct counts in one aggregate would multiply the rows.
    ``approximate`` does all columns in one scan with sketches.
    """
    def pct(missing: Column, rows: Column) -> Column:
        return F.coalesce(F.round(100 * missing / F.nullif(rows, F.lit(0)), 2), F.lit(0.0))

    if approximate:
        aggs = [F.count(F.lit(1)).alias("rows"), *_missing_counts(df)]
        aggs += [F.approx_count_distinct(F.when(~is_missing(df, c), col(c))).alias(f"u{i}")
                 for i, c in enumerate(df.columns)]
        return _stacked(df.agg(*aggs), [F.struct(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            (F.col("rows") - F.col(f"m{i}")).alias("non_null"), F.col(f"m{i}").alias("missing"),
            pct(F.col(f"m{i}"), F.col("rows")).alias("missing_pct"), F.col(f"u{i}").alias("unique"),
        ) for i, f in enumerate(df.schema)])
    return _union([
        top_value(value_counts(df, f.name)).select(
            F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("count").alias("non_null"), (F.col("rows") - F.col("count")).alias("missing"),
            pct(F.col("rows") - F.col("count"), F.col("rows")).alias("missing_pct"), "unique")
        for f in df.schema])


def missing_overview(df: DataFrame) -> DataFrame:
    """``column, missing, missing_pct`` of columns with missing values, most first."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *_missing_counts(df))
    table = _stacked(row, [F.struct(
        F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"),
        F.round(100 * F.col(f"m{i}") / F.nullif(F.col("rows"), F.lit(0)), 2).alias("missing_pct"),
    ) for i, c in enumerate(df.columns)])
    return table.where("missing > 0").orderBy(F.desc("missing"), "column")


def scale_review(df: DataFrame) -> DataFrame:
    """``column, min, max, mean`` per numeric column."""
    names = numeric_columns(df)
    if not names:
        raise ValueError("No numeric columns")
    aggs = []
    for i, c in enumerate(names):
        x = as_number(c)
        aggs += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"mean{i}")]
    return _stacked(df.agg(*aggs), [F.struct(
        F.lit(c).alias("column"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max"),
        F.col(f"mean{i}").alias("mean")) for i, c in enumerate(names)])


def describe_numeric(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 4) -> DataFrame:
    """``column, count, mean, std, min, q25, q50, q75, max`` per numeric column."""
    names = list(cols) if cols else numeric_columns(df)
    require_numeric(df, names)
    if not names:
        raise ValueError("No numeric columns")
    quarters = quantiles(df, {c: as_number(c) for c in names}, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(names):
        x = as_number(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}")]

    def shown(c: Column, name: str) -> Column:
        return F.round(c.cast("double"), digits).alias(name)

    return _stacked(df.agg(*aggs), [F.struct(
        F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), shown(F.col(f"mean{i}"), "mean"),
        shown(F.col(f"std{i}"), "std"), shown(F.col(f"lo{i}"), "min"),
        shown(F.lit(quarters[c][0]), "q25"), shown(F.lit(quarters[c][1]), "q50"),
        shown(F.lit(quarters[c][2]), "q75"), shown(F.col(f"hi{i}"), "max"),
    ) for i, c in enumerate(names)])


def describe_categorical(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``column, count, unique, top, freq`` per non-numeric column; the smallest of tied tops."""
    names = list(cols) if cols else [c for c in df.columns if c not in numeric_columns(df)]
    require_columns(df, names)
    if not names:
        raise ValueError("No categorical columns")
    return _union([
        top_value(value_counts(df, c)).select(
            F.lit(c).alias("column"), "count", "unique", F.col("top").cast("string").alias("top"), "freq")
        for c in names])


def describe_all(df: DataFrame) -> DataFrame:
    """Numeric, categorical and time columns in one table.

    Values of timestamp and date columns are seconds since the epoch.
    """
    stats = ("mean", "std", "min", "q25", "q50", "q75", "max")
    tops = {"unique": "long", "top": "string", "freq": "long"}
    times = [f.name for f in df.schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    texts = [c for c in df.columns if not is_numeric(type_of(df, c)) and c not in times]
    order = ["column", "count", *tops, *stats]
    parts = []
    if numeric_columns(df):
        parts.append(describe_numeric(df).withColumns({n: F.lit(None).cast(t) for n, t in tops.items()}))
    if times:
        seconds = df.select(*[F.unix_micros(col(c).cast("timestamp")).cast("double").alias(c) / 1e6 for c in times]).toDF(*times)
        parts.append(describe_numeric(seconds).withColumn("std", F.lit(None).cast("double"))
                     .withColumns({n: F.lit(None).cast(t) for n, t in tops.items()}))
    if texts:
        parts.append(describe_categorical(df, texts).withColumns(
            {s: F.lit(None).cast("double") for s in stats}))
    return _union([p.select(*order) for p in parts])


def stats_1d(df: DataFrame, column: str) -> DataFrame:
    """``n, mean, median, std, skew, kurtosis`` of a numeric column in one row."""
    require_numeric(df, [column])
    x = as_number(column)
    median = quantiles(df, {column: x}, [0.5])[column][0]
    return df.agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.lit(median).cast("double").alias("median"),
        F.stddev_samp(x).alias("std"), sample_skewness(x).alias("skew"), sample_kurtosis(x).alias("kurtosis"))


def stats_1d_categorical(df: DataFrame, column: str) -> DataFrame:
    """``n, unique, top, freq`` of a categorical column in one row."""
    require_columns(df, [column])
    return top_value(value_counts(df, column)).select(
        F.col("count").alias("n"), "unique", F.col("top").cast("string").alias("top"), "freq")


# The suggestions, in order of precedence, and the scale ratio that triggers one.
SCALE_RATIO = 100
NEXT_STEPS = ("handle_missing", "remove_duplicates", "scale_columns", "explore")


def recommend(df: DataFrame) -> DataFrame:
    """The next step the data suggests, with the numbers it rests on."""
    names = numeric_columns(df)
    sizes = [F.abs(F.avg(as_number(c))).alias(f"a{i}") for i, c in enumerate(names)]
    counts = df.agg(*_missing_counts(df), *sizes)
    total = reduce(lambda a, b: a + b, [F.col(f"m{i}") for i in range(len(df.columns))])
    positive = F.filter(F.array(F.lit(0.0), *[F.col(f"a{i}") for i in range(len(names))]), lambda v: v > 0)
    ratio = F.when(F.size("means") >= 2, F.array_max("means") / F.array_min("means"))
    step = F.when(F.col("n_missing") > 0, NEXT_STEPS[0]).when(F.col("n_duplicates") > 0, NEXT_STEPS[1]).when(
        F.coalesce(F.col("scale_ratio") >= SCALE_RATIO, F.lit(False)), NEXT_STEPS[2]).otherwise(NEXT_STEPS[3])
    return (
        counts.select(total.alias("n_missing"), positive.alias("means"))
        .withColumn("d", one_row(dedup.overview(df)))
        .select("n_missing",
                F.coalesce(F.round(100 * F.col("n_missing") / F.nullif(
                    F.col("d.n_rows") * len(df.columns), F.lit(0)), 2), F.lit(0.0)).alias("missing_pct"),
                F.col("d.n_all_copies").alias("n_duplicates"), F.col("d.pct").alias("duplicate_pct"),
                ratio.alias("scale_ratio"))
        .withColumn("next_step", step))


# --- comparisons ----------------------------------------------------------


def compare(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """``side, n, mean, std`` of a numeric column before and after a step."""
    def one(df: DataFrame, side: str) -> DataFrame:
        require_numeric(df, [column])
        x = as_number(column)
        return df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std")).select(
            F.lit(side).alias("side"), "n", "mean", "std")
    return one(before, "before").unionByName(one(after, "after"))


def compare_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """``rows_before, rows_after, rows_removed`` in one row."""
    left = before.agg(F.count(F.lit(1)).alias("rows_before"))
    right = after.agg(F.count(F.lit(1)).alias("rows_after"))
    return left.withColumn("rows_after", one_row(right).getField("rows_after")).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def compare_distribution(before: DataFrame, after: DataFrame, column: str, bins: int = 30,
                         top: int = 15) -> DataFrame:
    """``side, label, value``: bin counts of a numeric column, or the most frequent values."""
    def sides(make) -> DataFrame:
        return make(before).withColumn("side", F.lit("before")).unionByName(
            make(after).withColumn("side", F.lit("after"))).select("side", "label", "value")

    if is_numeric(type_of(before, column)):
        def hist(df: DataFrame) -> DataFrame:
            span = value_ranges(df, [as_number(column)])[0]
            if span is None:
                return df.sparkSession.createDataFrame([], "label string, value long")
            code = histogram_bins(span, bins).left_closed(as_number(column))
            return df.select(code.alias("b")).where("b is not null").groupBy(
                F.col("b").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("value"))
        return sides(hist)

    def most(df: DataFrame) -> DataFrame:
        return value_counts(df, column).where("value is not null").orderBy(
            F.desc("n"), F.col("value")).limit(top).select(
            F.col("value").cast("string").alias("label"), F.col("n").alias("value"))
    return sides(most)


def compare_histograms(before: DataFrame, after: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """``side, bin, lo, hi, value``: counts of a numeric column on edges that both tables share.

    A bin is the same range of values on both sides; every bin is listed for
    both, empty ones with 0.  Without any value there are no rows.
    """
    x = as_number(column)
    for df in (before, after):
        require_numeric(df, [column])
    spans = [s for s in (value_ranges(before, [x])[0], value_ranges(after, [x])[0]) if s]
    if not spans:
        return before.sparkSession.createDataFrame([], "side string, bin int, lo double, hi double, value long")
    shared = histogram_bins((min(lo for lo, _ in spans), max(hi for _, hi in spans)), bins)
    code = shared.left_closed(x).alias("bin")
    counts = _union([df.select(F.lit(side).alias("side"), code).where("bin IS NOT NULL").groupBy("side", "bin").agg(F.count(F.lit(1)).alias("value"))
                     for df, side in ((before, "before"), (after, "after"))])
    grid = shared.table(before.sparkSession).withColumn("side", F.explode(F.array(F.lit("before"), F.lit("after"))))
    return grid.join(counts, ["side", "bin"], "left").select("side", "bin", "lo", "hi", F.coalesce("value", F.lit(0)).alias("value"))


# --- per category ---------------------------------------------------------


def _grouped(df: DataFrame, x: str, by: str, hue: str | None) -> tuple[DataFrame, list[str]]:
    require_numeric(df, [x])
    require_categorical(df, [by])
    keys = [by] if hue in (None, by) else [by, hue]
    require_columns(df, keys)
    rows = df.select(*[col(k) for k in keys], as_number(x).alias("_x"))
    return rows.where(F.col("_x").isNotNull() & col(by).isNotNull()), keys


def box_stats(df: DataFrame, x: str, by: str, hue: str | None = None) -> DataFrame:
    """``by[, hue], n, mean, std, min, q1, median, q3, max`` per category."""
    rows, keys = _grouped(df, x, by, hue)
    moments = rows.groupBy(*[col(k) for k in keys]).agg(
        F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"),
        F.min("_x").alias("min"), F.max("_x").alias("max"))
    quarters = grouped_quantiles(rows, keys, F.col("_x"), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    quarters = quarters.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "q1", "median", "q3")
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return moments.join(quarters, same).select(
        *[col(k) for k in keys], "n", "mean", "std", "min", "q1", "median", "q3", "max")


def grouped_bar(df: DataFrame, x: str, by: str, hue: str | None = None) -> DataFrame:
    """``by[, hue], value, count, std`` with the mean of x per category."""
    rows, keys = _grouped(df, x, by, hue)
    return rows.groupBy(*[col(k) for k in keys]).agg(
        F.avg("_x").alias("value"), F.count("_x").alias("count"), F.stddev_samp("_x").alias("std"))
