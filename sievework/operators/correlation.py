"""Correlation matrices: Pearson, Spearman, Kendall tau-b on pairwise complete rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.quantiles import average_ranks, column_splits, with_range
from sievework.functions.schema import as_number, numeric_columns, require_numeric
from sievework.functions.stats import correlation, correlation_p_value
from sievework.functions.work import one_row, settle

CELLS_PER_STRIP = 500_000


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """``r, r2, p_value, n`` over the complete pairs in one row."""
    require_numeric(df, [x, y])
    a, b = as_number(x), as_number(y)
    row = df.agg(correlation(a, b).alias("r"), F.count_if(a.isNotNull() & b.isNotNull()).alias("n")).first()
    r, n = row["r"], row["n"]
    return df.sparkSession.createDataFrame(
        [(r, None if r is None else r * r, correlation_p_value(r, n), n)],
        "r double, r2 double, p_value double, n long")


def _cells(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct complete pairs with their counts."""
    return df.select(as_number(x).alias("x"), as_number(y).alias("y")).where(
        "x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).cast("double").alias("c"))


def _rank_moments(cells: DataFrame, rank_x: DataFrame, rank_y: DataFrame) -> DataFrame:
    """``xy, xx, yy``: moments of the average ranks around their mean, in one row."""
    rx = rank_x.toDF("x", "rx", "n")
    ry = rank_y.select("value", "rank").toDF("y", "ry")
    middle = (F.col("n") + 1) / 2
    ranked = cells.join(rx, "x").join(ry, "y").select(
        "c", (F.col("rx") - middle).alias("dx"), (F.col("ry") - middle).alias("dy"))
    return ranked.agg(F.sum(F.expr("c * dx * dy")).alias("xy"), F.sum(F.expr("c * dx * dx")).alias("xx"),
                      F.sum(F.expr("c * dy * dy")).alias("yy"))


def spearman_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[float | None]:
    """Pearson r of average ranks for several pairs of columns.

    Columns without missing values are ranked once for all pairs; others anew
    among the complete rows of each pair.  Pairs run side by side, ten to a job.
    """
    names = sorted({c for pair in pairs for c in pair})
    splits = dict(zip(names, column_splits(df, [as_number(c) for c in names])))
    sizes = df.agg(F.count(F.lit(1)), *[F.count(as_number(c)) for c in names]).first()
    whole = {c: average_ranks(df.select(as_number(c).alias("v"), F.lit(1).alias("w")), "v", "w", splits[c])
             for i, c in enumerate(names) if sizes[i + 1] == sizes[0]}

    def one(x: str, y: str) -> DataFrame:
        cells = _cells(df, x, y)
        if x in whole and y in whole:
            return _rank_moments(cells, whole[x], whole[y])
        return _rank_moments(cells, average_ranks(cells, "x", "c", splits[x]), average_ranks(cells, "y", "c", splits[y]))

    found: list[float | None] = []
    for start in range(0, len(pairs), 10):
        parts = [one(x, y).withColumn("i", F.lit(i)) for i, (x, y) in enumerate(pairs[start:start + 10])]
        for row in sorted(reduce(DataFrame.unionByName, parts).collect(), key=lambda r: r["i"]):
            scale = math.sqrt((row["xx"] or 0.0) * (row["yy"] or 0.0))
            found.append(row["xy"] / scale if scale else None)
    return found


def spearman(df: DataFrame, x: str, y: str) -> float | None:
    return spearman_pairs(df, [(x, y)])[0]


# --- Kendall --------------------------------------------------------------


def rising_pairs(x: np.ndarray, y: np.ndarray, c: np.ndarray) -> float:
    """Weighted number of pairs with x_i < x_j and y_i < y_j, in O(n log n).

    Rows are put in order of x (equal x by falling y, so they never count) and
    pairs are counted at the highest bit in which their y ranks differ.
    """
    order = np.lexsort((-y, x))
    weight = c[order].astype(float)
    rank = np.unique(y, return_inverse=True)[1][order]
    total = 0.0
    for bit in range(int(rank.max()).bit_length() if len(rank) else 0):
        prefix = rank >> (bit + 1)
        line_up = np.argsort(prefix, kind="stable")
        p, one, w = prefix[line_up], ((rank >> bit) & 1)[line_up], weight[line_up]
        zeros = np.cumsum(np.where(one == 0, w, 0.0))
        start = np.searchsorted(p, p, side="left")
        before = zeros - np.where(start > 0, zeros[start - 1], 0.0)
        total += float(np.sum(np.where(one == 1, w * before, 0.0)))
    return total


def _count_strip(strip: pd.DataFrame) -> pd.DataFrame:
    n = rising_pairs(strip["a"].to_numpy(), strip["b"].to_numpy(), strip["c"].to_numpy())
    return pd.DataFrame({"n": [n]})


def _rising_ranges(totals: DataFrame, ranges: int) -> float:
    """Weighted pairs of cells (bx, by, c) with a smaller x range and a smaller y range.

    Such a pair differs at one highest bit of the number of its y range.  For
    each bit the cells are added up per leading bits, x range and this bit; the
    zeros of earlier x ranges come before the ones.  A window holds one row for
    each x range that its leading bits have, however many rows there are.
    """
    parts = []
    for bit in range(max(1, ranges.bit_length())):
        lead, one = F.shiftright("by", bit + 1), F.shiftright("by", bit).bitwiseAND(F.lit(1)) == 1
        held = totals.groupBy(lead.alias("lead"), "bx").agg(
            F.sum(F.when(one, F.col("c")).otherwise(0.0)).alias("ones"), F.sum(F.when(~one, F.col("c")).otherwise(0.0)).alias("zeros"))
        upto = Window.partitionBy("lead").orderBy("bx").rowsBetween(Window.unboundedPreceding, -1)
        parts.append(held.select((F.col("ones") * F.coalesce(F.sum("zeros").over(upto), F.lit(0.0))).alias("n")))
    return reduce(DataFrame.unionByName, parts).agg(F.sum("n")).first()[0] or 0.0


def _concordant(cells: DataFrame, xs: Sequence[float], ys: Sequence[float]) -> float:
    """Pairs rising in both columns.

    Both columns are cut into ranges.  Pairs in different x ranges and
    different y ranges are counted from the totals of the ranges that hold
    cells; pairs that share the x range, or else the y range, are counted strip
    by strip, each in a task of its own.  A value that fills a range is alone in
    it and cannot rise within it.
    """
    grid = with_range(with_range(cells, "x", xs, "bx"), "y", ys, "by")
    inside = 0.0
    if xs and ys:
        inside = _rising_ranges(settle(grid.groupBy("bx", "by").agg(F.sum("c").alias("c"))), len(ys))
    same_x = grid.select(F.lit(0).alias("axis"), F.col("bx").alias("strip"), F.col("x").alias("a"),
                         F.col("y").alias("b"), "c")
    strips = same_x
    if xs:
        same_y = grid.select(F.lit(1).alias("axis"), F.col("by").alias("strip"),
                             F.col("bx").cast("double").alias("a"), F.col("y").alias("b"), "c")
        strips = same_x.unionByName(same_y)
    held = strips.groupBy("axis", "strip").agg(F.min("a").alias("a0"), F.max("a").alias("a1"),
                                               F.min("b").alias("b0"), F.max("b").alias("b1"))
    # Strips with a single value on a side hold no rising pair.
    live = held.where("a0 < a1 and b0 < b1").select("axis", "strip")
    counted = strips.join(live, ["axis", "strip"], "left_semi").groupBy("axis", "strip").applyInPandas(
        _count_strip, "n double")
    return inside + (counted.agg(F.sum("n")).first()[0] or 0.0)


def kendall(df: DataFrame, x: str, y: str) -> float | None:
    """Kendall tau-b: rising minus falling pairs over the pairs untied in x and in y."""
    cells = settle(_cells(df, x, y))
    def ties(name: str) -> Column:
        counts = cells.groupBy(name).agg(F.sum("c").alias("c"))
        return one_row(counts.agg(F.sum(F.expr("c * (c - 1) / 2")).alias("t"))).getField("t")

    row = cells.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("cells"),
                    F.sum(F.expr("c * (c - 1) / 2")).alias("both")).withColumns(
        {"tx": ties("x"), "ty": ties("y")}).first()
    n, tx, ty, both = row["n"], row["tx"], row["ty"], row["both"]
    if not n or n < 2:
        return None
    pairs = n * (n - 1) / 2
    if pairs == tx or pairs == ty:
        return None
    strips = math.ceil(row["cells"] / CELLS_PER_STRIP)
    xs, ys = column_splits(cells, [F.col("x"), F.col("y")], strips)
    rising = _concordant(cells, xs, ys)
    falling = pairs - tx - ty + both - rising
    return (rising - falling) / math.sqrt((pairs - tx) * (pairs - ty))


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None, method: str = "pearson") -> DataFrame:
    """``col_a, col_b, r`` for every ordered pair of numeric columns, four digits; NULL for constants."""
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"Unsupported method '{method}'. Use pearson, spearman, or kendall.")
    known = numeric_columns(df)
    names = known if cols is None else [c for c in cols if c in known]
    if cols is not None:
        missing = [c for c in cols if c not in df.columns]
        if missing:
            raise ValueError(f"Invalid column(s): {missing}")
    if len(names) < 2:
        raise ValueError("Need at least 2 numeric columns for a correlation matrix")
    upper = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    if method == "pearson":
        def one(i: int, j: int) -> Column:
            a, b = as_number(names[i]), as_number(names[j])
            return correlation(a, b) if i < j else F.when(F.min(a) < F.max(a), F.lit(1.0))

        row = df.agg(*[one(i, j).alias(f"r{i}_{j}") for i, j in upper])
        value = {(i, j): F.col(f"r{i}_{j}") for i, j in upper}
    else:
        row = df.sparkSession.range(1)
        varied = _varied(df, names)
        live = [(i, j) for i, j in upper if i < j and varied[i] and varied[j]]
        pairs = [(names[i], names[j]) for i, j in live]
        found = spearman_pairs(df, pairs) if method == "spearman" else [kendall(df, a, b) for a, b in pairs]
        known = dict(zip(live, found)) | {(i, i): 1.0 for i in range(len(names)) if varied[i]}
        value = {pair: F.lit(known.get(pair)).cast("double") for pair in upper}
    entries = [F.struct(F.lit(names[i]).alias("col_a"), F.lit(names[j]).alias("col_b"),
                        F.round(value[min(i, j), max(i, j)], 4).alias("r"))
               for i in range(len(names)) for j in range(len(names))]
    return row.select(F.inline(F.array(*entries)))


def _varied(df: DataFrame, names: Sequence[str]) -> list[bool]:
    """Whether each column holds two different values."""
    row = df.agg(*[F.coalesce(F.min(as_number(c)) < F.max(as_number(c)), F.lit(False)).alias(f"v{i}")
                   for i, c in enumerate(names)]).first()
    return list(row)
