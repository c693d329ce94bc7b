"""Scaling and outliers.  Constants are fitted once and applied as literals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions import sketches
from sievework.functions.quantiles import quantiles
from sievework.functions.schema import as_number, col, require_numeric, type_of
from sievework.functions.stats import deviation

METHODS = ("standard", "minmax", "robust")


def fit_scale(df: DataFrame, cols: Sequence[str], method: str = "standard", approximate: bool = False) -> dict[str, tuple[float, float]]:
    """``column -> (centre, width)``; a width of zero is replaced by one.

    ``approximate`` takes the quartiles of ``robust`` from sketches.
    """
    if method not in METHODS:
        raise ValueError(f"Unknown method: {method}. Choose from {list(METHODS)}")
    require_numeric(df, cols)
    if method == "robust":
        probs = [0.25, 0.5, 0.75]
        quarters = sketches.approximate(df, cols, probs) if approximate else quantiles(df, {c: as_number(c) for c in cols}, probs)
        found = {c: (q[1], None if q[1] is None else q[2] - q[0]) for c, q in quarters.items()}
    else:
        aggs = []
        for i, c in enumerate(cols):
            x = as_number(c)
            if method == "standard":
                aggs += [F.avg(x).alias(f"c{i}"), deviation(x).alias(f"w{i}")]
            else:
                aggs += [F.min(x).alias(f"c{i}"), (F.max(x) - F.min(x)).alias(f"w{i}")]
        row = df.agg(*aggs).first()
        found = {c: (row[f"c{i}"], row[f"w{i}"]) for i, c in enumerate(cols)}
    empty = [c for c, (centre, _) in found.items() if centre is None]
    if empty:
        raise ValueError(f"Cannot scale all-null columns: {empty}")
    return {c: (centre, width or 1.0) for c, (centre, width) in found.items()}


def apply_scale(df: DataFrame, fitted: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({
        c: (as_number(c) - F.lit(centre)) / F.lit(width) for c, (centre, width) in fitted.items()})


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard", approximate: bool = False) -> DataFrame:
    """Replace columns by (x - centre) / width: mean and population std, min and range, or median and IQR."""
    return apply_scale(df, fit_scale(df, cols, method, approximate))


def fit_zscore(df: DataFrame, column: str) -> tuple[float, float]:
    """Mean and sample standard deviation, for ``apply_feature``."""
    require_numeric(df, [column])
    x = as_number(column)
    row = df.agg(F.avg(x).alias("mean"), deviation(x, sample=True).alias("std")).first()
    if not row["std"]:
        raise ValueError(f"Column '{column}' cannot be standardized because its std is 0 or missing")
    return row["mean"], row["std"]


def fit_normalize(df: DataFrame, column: str) -> tuple[float, float]:
    """Minimum and range, for ``apply_feature``."""
    require_numeric(df, [column])
    x = as_number(column)
    row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    if row["lo"] is None or row["lo"] == row["hi"]:
        raise ValueError(f"Column '{column}' cannot be normalized because min = max or no values exist")
    return row["lo"], row["hi"] - row["lo"]


def apply_feature(df: DataFrame, column: str, fitted: tuple[float, float], into: str) -> DataFrame:
    """New column (x - centre) / width; a plain projection, so it works on a stream."""
    centre, width = fitted
    return df.withColumn(into, (as_number(column) - F.lit(centre)) / F.lit(width))


def zscore(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """New column (x - mean) / sample std."""
    return apply_feature(df, column, fit_zscore(df, column), into or f"{column}_zscore")


def normalize(df: DataFrame, column: str, into: str | None = None) -> DataFrame:
    """New column (x - min) / (max - min)."""
    return apply_feature(df, column, fit_normalize(df, column), into or f"{column}_normalized")


# --- outliers -------------------------------------------------------------


def fit_fences(df: DataFrame, column: str, k: float = 1.5, approximate: bool = False) -> dict[str, float] | None:
    """Quartiles (from a sketch if ``approximate``) and the fences ``k`` IQRs beyond them; None when all is missing."""
    require_numeric(df, [column])
    probs = [0.25, 0.75]
    q1, q3 = (sketches.approximate(df, [column], probs) if approximate else quantiles(df, {column: as_number(column)}, probs))[column]
    if q1 is None:
        return None
    iqr = q3 - q1
    return {"q1": q1, "q3": q3, "iqr": iqr, "lower_bound": q1 - k * iqr, "upper_bound": q3 + k * iqr}


def outlier_report(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """``q1, q3, iqr, lower_bound, upper_bound, n_outliers`` in one row."""
    fences = fit_fences(df, column, k)
    if fences is None:
        fences = dict.fromkeys(("q1", "q3", "iqr", "lower_bound", "upper_bound"))
    x = as_number(column)
    outside = (x < F.lit(fences["lower_bound"])) | (x > F.lit(fences["upper_bound"]))
    count = df.agg(F.count_if(outside).alias("n_outliers"))
    return count.select(*[F.lit(v).cast("double").alias(n) for n, v in fences.items()], "n_outliers")


def flag_outliers(df: DataFrame, column: str, k: float = 1.5, into: str = "is_outlier") -> DataFrame:
    """The outlier mask as a boolean column; missing values are no outliers."""
    fences = fit_fences(df, column, k)
    if fences is None:
        return df.withColumn(into, F.lit(False))
    x = as_number(column)
    return df.withColumn(into, F.coalesce(
        (x < fences["lower_bound"]) | (x > fences["upper_bound"]), F.lit(False)))


def clip(df: DataFrame, column: str, lower: float | None, upper: float | None,
         into: str | None = None) -> DataFrame:
    """Move values beyond a bound onto it; missing stays missing.  Works on streams."""
    x = as_number(column)
    out = x
    if upper is not None:
        out = F.when(x > F.lit(upper), F.lit(float(upper))).otherwise(out)
    if lower is not None:
        out = F.when(x < F.lit(lower), F.lit(float(lower))).otherwise(out)
    return df.withColumn(into or column, out)


def outliers(df: DataFrame, column: str, how: str = "remove", k: float = 1.5) -> DataFrame:
    """``remove`` rows outside the fences (and rows without a value), or ``cap`` them."""
    if how not in ("remove", "cap"):
        raise ValueError(f"Unknown way: {how}. Choose 'remove' or 'cap'.")
    fences = fit_fences(df, column, k)
    if how == "remove":
        if fences is None:
            return df.where(F.lit(False))
        # Plain comparisons with literals, so that the filter reaches the file
        # scan; NaN sorts above every number and fails the upper one.
        kind = type_of(df, column)
        lower, upper = F.lit(fences["lower_bound"]), F.lit(fences["upper_bound"])
        x = col(column) if kind.typeName() == "double" else col(column).cast("double")
        return df.where((x >= lower) & (x <= upper))
    if fences is None:
        return df
    return clip(df, column, fences["lower_bound"], fences["upper_bound"])


def fit_caps(df: DataFrame, cols: Sequence[str], q: float = 0.99) -> dict[str, float]:
    """Upper caps of the columns that have values."""
    require_numeric(df, cols)
    found = quantiles(df, {c: as_number(c) for c in cols}, [q])
    return {c: v[0] for c, v in found.items() if v[0] is not None}


def cap_upper(df: DataFrame, cols: Sequence[str], q: float = 0.99, suffix: str = "_clean",
              caps: Mapping[str, float] | None = None) -> DataFrame:
    """New columns with values above the ``q`` quantile set to it; all-missing columns are skipped."""
    caps = fit_caps(df, cols, q) if caps is None else caps
    return df.withColumns({
        f"{c}{suffix}": F.when(as_number(c) > F.lit(cap), F.lit(cap)).otherwise(as_number(c))
        for c, cap in caps.items()})


def cap_table(df: DataFrame, cols: Sequence[str], q: float = 0.99) -> DataFrame:
    """``column, cap`` with caps rounded to four digits."""
    caps = fit_caps(df, cols, q)
    return df.sparkSession.createDataFrame(
        [(c, round(v, 4)) for c, v in caps.items()], "column string, cap double")
