"""The data behind one- and two-column charts, as tidy tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.bins import Bins, auto_bins, histogram_bins, value_ranges
from sievework.functions.schema import (
    MISSING_LABEL, as_number, col, is_categorical, is_missing, is_numeric, require_categorical,
    require_columns, require_numeric, type_of,
)
from sievework.functions.work import one_row, spread
from sievework.operators import profile
from sievework.operators.encode import categories

MAX_POINTS = 5000
# Leaves the upper 16 bits of a hash.
HASH_SHIFT = 44
# Up to this many labels a table with one row per label is broadcast.
MAX_LABELS = 10_000


def where(df: DataFrame, predicate: str) -> DataFrame:
    """Rows matching SQL predicate text that names at least one column."""
    if not predicate or not predicate.strip():
        raise ValueError("Filter expression is empty")
    if not any(c in predicate for c in df.columns):
        raise ValueError(f"No valid column names found in filter '{predicate}'")
    try:
        return df.where(F.expr(predicate))
    except AnalysisException as exc:
        raise ValueError(f"Filter '{predicate}' is not valid: {exc}") from exc


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """First ``n`` rows in the given order."""
    require_columns(df, order_by)
    return df.orderBy(*[col(c) for c in order_by]).limit(n)


def log_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column, log_available``: whether all present values are positive."""
    require_numeric(df, cols)
    row = df.agg(*[F.coalesce(F.min(as_number(c)) > 0, F.lit(False)).alias(f"l{i}") for i, c in enumerate(cols)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"l{i}").alias("log_available")) for i, c in enumerate(cols)])))


def counts_log_available(table: DataFrame, value: str = "value") -> DataFrame:
    """``log_available`` in one row: whether every count of a chart table is positive."""
    return table.agg(F.coalesce(F.min(col(value)) > 0, F.lit(False)).alias("log_available"))


def group_label(df: DataFrame, name: str) -> Column:
    """Category as text, missing ones under a label of their own."""
    return F.coalesce(F.when(~is_missing(df, name), col(name).cast("string")), F.lit(MISSING_LABEL))


def _share(value: Column, total: Column) -> Column:
    return F.coalesce(value / F.nullif(total, F.lit(0)), F.lit(0.0))


# --- one column -----------------------------------------------------------


def category_counts(df: DataFrame, column: str, normalize: bool = False, order: str | None = "desc") -> DataFrame:
    """``category, value`` with counts or shares."""
    require_columns(df, [column])
    counts = df.groupBy(group_label(df, column).alias("category")).agg(F.count(F.lit(1)).alias("value"))
    if normalize:
        total = counts.agg(F.sum("value")).scalar()
        counts = counts.withColumn("value", F.col("value") / total)
    if order is None:
        return counts
    direction = F.asc if order.lower() == "asc" else F.desc
    return counts.orderBy(direction("value"), "category")


def _bins_for(df: DataFrame, column: str, bins: int | str) -> Bins:
    x = as_number(column)
    if bins == "auto":
        found = auto_bins(df, x, whole_numbers=type_of(df, column).typeName() in ("byte", "short", "integer", "long"))
    else:
        span = value_ranges(df, [x])[0]
        found = histogram_bins(span, int(bins)) if span else None
    if found is None:
        raise ValueError(f"Column '{column}' has no valid numeric values")
    return found


def _filled(bins: Bins, counts: DataFrame, df: DataFrame, normalize: bool) -> DataFrame:
    """Counts per bin with the empty bins added."""
    table = bins.table(df.sparkSession).join(counts, "bin", "left")
    out = table.select("bin", "lo", "hi", F.coalesce(F.col("value"), F.lit(0)).alias("value"))
    if normalize:
        out = out.withColumn("value", _share(F.col("value"), counts.agg(F.sum("value")).scalar()))
    return out


def histogram(df: DataFrame, column: str, bins: int | str = 30, normalize: bool = False) -> DataFrame:
    """``bin, lo, hi, value`` with equal-width bins over the value range; empty bins are kept."""
    require_numeric(df, [column])
    found = _bins_for(df, column, bins)
    code = found.left_closed(as_number(column))
    # One row per bin at most.
    counts = df.select(code.alias("bin")).where("bin is not null").groupBy("bin").agg(
        F.count(F.lit(1)).alias("value"))
    return _filled(found, counts, df, normalize)


# --- two numeric columns --------------------------------------------------


def pairs(df: DataFrame, x: str, y: str, *others: str) -> DataFrame:
    """The complete (x, y) pairs as doubles ``x, y`` plus other columns."""
    require_numeric(df, [x, y])
    require_columns(df, others)
    rows = df.select(as_number(x).alias("x"), as_number(y).alias("y"), *[col(c) for c in others])
    return rows.where("x is not null and y is not null")


def _xy_ranges(rows: DataFrame) -> list[tuple[float, float]]:
    spans = value_ranges(rows, [F.col("x"), F.col("y")])
    if spans[0] is None:
        raise ValueError("No valid numeric pairs")
    return spans


def histogram2d(df: DataFrame, x: str, y: str, bins: int | tuple[int, int] = 40) -> DataFrame:
    """``bx, by, x_lo, y_lo, n`` for every cell of the grid."""
    nx, ny = (bins, bins) if isinstance(bins, int) else bins
    rows = pairs(df, x, y)
    spans = _xy_ranges(rows)
    bx, by = histogram_bins(spans[0], nx), histogram_bins(spans[1], ny)
    counts = rows.groupBy(bx.left_closed(F.col("x")).alias("bx"), by.left_closed(F.col("y")).alias("by")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = bx.table(df.sparkSession).select(F.col("bin").alias("bx"), F.col("lo").alias("x_lo"),
                                            F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("by"))
    # The count table has at most one row per grid cell.
    return grid.join(F.broadcast(counts), ["bx", "by"], "left").select(
        "bx", "by", "x_lo", (F.lit(by.lo) + F.col("by") * F.lit(by.width)).alias("y_lo"),
        F.coalesce("n", F.lit(0)).alias("n"))


def _rank(seed: int, names: Sequence[str]) -> Column:
    """A row's place in a sample: the first 60 bits of a digest of seed and key that any engine can work out."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[col(c).cast("string") for c in names])), 1, 15)
    return F.conv(digits, 16, 10).cast("long")


def sample(df: DataFrame, n: int = MAX_POINTS, key: Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows (or all) without replacement, the same ones on every run.

    Rows are ranked by a hash of ``key`` (None: the whole row) and the first
    ``n`` are kept.  Row counts per hash range tell from which range on no row
    can be among them, so only about ``n`` rows are ever sorted.
    """
    names = list(key) if key else df.columns
    hashed = df.withColumn("_h", _rank(seed, names))
    part = F.shiftright("_h", HASH_SHIFT)
    sizes = hashed.groupBy(part.alias("b")).agg(F.count(F.lit(1)).alias("held"))
    # At most 65,536 hash ranges.
    before = F.sum("held").over(Window.orderBy("b")) - F.col("held")
    last = sizes.select("b", before.alias("before")).where(F.col("before") < n).agg(F.max("b")).first()[0]
    if last is None:
        return df.where(F.lit(False))
    return hashed.where(part <= last).orderBy("_h").limit(n).select(*[col(c) for c in df.columns])


def scatter(df: DataFrame, x: str, y: str, hue: str | None = None, n: int = MAX_POINTS,
            key: Sequence[str] | None = None) -> DataFrame:
    """Sample of the complete pairs: ``x, y[, hue]`` under their own names."""
    require_numeric(df, [x, y])
    cols = [x, y] + ([hue] if hue and hue not in (x, y) else [])
    complete = df.where(~is_missing(df, x) & ~is_missing(df, y))
    return sample(complete, n, key).select(*[col(c) for c in cols])


def raw_line(df: DataFrame, x: str, y: str, n: int = MAX_POINTS, key: Sequence[str] | None = None) -> DataFrame:
    """Sampled complete pairs ``x, y`` sorted by x."""
    rows = scatter(df, x, y, n=n, key=key)
    return rows.select(as_number(x).alias("x"), as_number(y).alias("y")).orderBy("x", "y")


def _binned_mean(rows: DataFrame, bins: Bins, labels: Sequence[str]) -> DataFrame:
    means = rows.groupBy(*labels, bins.left_closed(F.col("x")).alias("bin")).agg(
        F.avg("y").alias("y"), F.count("y").alias("n"))
    mid = (F.lit(bins.lo) + F.col("bin") * F.lit(bins.width) + (
        F.lit(bins.lo) + (F.col("bin") + 1) * F.lit(bins.width))) * 0.5
    return means.select(*labels, "bin", mid.alias("x"), "y", "n")


def line(df: DataFrame, x: str, y: str, bins: int = 30) -> DataFrame:
    """``bin, x, y, n``: mean of y per equal-width bin of x, at the middle of the bin."""
    rows = pairs(df, x, y)
    lo, hi = _xy_ranges(rows)[0]
    return _binned_mean(rows, Bins(lo, hi, bins), [])


def grouped_line(df: DataFrame, x: str, y: str, group: str, bins: int = 30) -> DataFrame:
    """``label, bin, x, y, n, n_points``: one binned line per category with edges shared by all."""
    require_categorical(df, [group])
    require_numeric(df, [x, y])
    span = value_ranges(df, [as_number(x)])[0]
    rows = df.select(group_label(df, group).alias("label"), as_number(x).alias("x"), as_number(y).alias("y"))
    return _labelled_line(rows, span, bins)


def _labelled_line(rows: DataFrame, span: tuple[float, float] | None, bins: int) -> DataFrame:
    if span is None:
        raise ValueError("No valid numeric pairs")
    table = _binned_mean(rows.where("x is not null and y is not null"), Bins(*span, bins), ["label"])
    return table.withColumn("n_points", F.sum("n").over(Window.partitionBy("label")))


def grouped_raw_line(df: DataFrame, x: str, y: str, group: str, n: int = MAX_POINTS,
                     key: Sequence[str] | None = None, seed: int = 0) -> DataFrame:
    """``label, x, y``: at most ``n`` sampled pairs per category, sorted by x."""
    require_categorical(df, [group])
    require_numeric(df, [x, y])
    names = list(key) if key else df.columns
    rows = df.select(group_label(df, group).alias("label"), as_number(x).alias("x"), as_number(y).alias("y"),
                     _rank(seed, names).alias("_h"))
    rows = rows.where("x is not null and y is not null").withColumn("_b", F.shiftright("_h", HASH_SHIFT))
    # Rows per label and hash range tell from which range on no row can be among the first n.
    sizes = rows.groupBy("label", "_b").agg(F.count(F.lit(1)).alias("held"))
    before = F.sum("held").over(Window.partitionBy("label").orderBy("_b")) - F.col("held")
    last = sizes.withColumn("before", before).where(F.col("before") < n).groupBy("label").agg(
        F.max("_b").alias("_last"))
    bounded = last.limit(MAX_LABELS + 1).collect()
    if len(bounded) <= MAX_LABELS:
        last = F.broadcast(df.sparkSession.createDataFrame(bounded, last.schema))
    first = Window.partitionBy("label").orderBy("_h")
    kept = rows.join(last, "label").where("_b <= _last").withColumn("_n", F.row_number().over(first)).where(
        F.col("_n") <= n)
    return kept.select("label", "x", "y").orderBy("label", "x", "y")


def group_histogram(df: DataFrame, column: str, group: str, bins: int = 30, normalize: bool = False) -> DataFrame:
    """``label, bin, x, y, n_points``: histogram line per category with shared edges."""
    require_numeric(df, [column])
    require_categorical(df, [group])
    rows = df.select(group_label(df, group).alias("label"), as_number(column).alias("v"))
    return _labelled_histogram(rows, bins, normalize)


def _labelled_histogram(rows: DataFrame, bins: int, normalize: bool) -> DataFrame:
    span = value_ranges(rows, [F.col("v")])[0]
    if span is None:
        raise ValueError("No valid numeric values")
    found = histogram_bins(span, bins)
    counts = rows.groupBy("label", found.left_closed(F.col("v")).alias("bin")).agg(F.count("v").alias("c"))
    # Every label gets every bin: a row per label holding the counts of its bins, spread over the bin numbers.
    per_label = counts.groupBy("label").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "c")))).alias("m"),
        F.sum("c").alias("n_points"))
    spread = per_label.select("label", "n_points", "m", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    count = F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0))
    y = _share(count, F.col("n_points")) if normalize else count
    mid = (F.lit(found.lo) + F.col("bin") * F.lit(found.width) + (
        F.lit(found.lo) + (F.col("bin") + 1) * F.lit(found.width))) * 0.5
    return spread.select("label", "bin", mid.alias("x"), y.alias("y"), "n_points")


def joint(df: DataFrame, x: str, y: str, bins: int = 30, n: int = MAX_POINTS,
          key: Sequence[str] | None = None, hue: str | None = None) -> dict[str, DataFrame]:
    """``points`` (sample) and ``marginals`` (``axis, bin, lo, hi, value`` of both columns)."""
    rows = pairs(df, x, y)
    spans = _xy_ranges(rows)
    sides = []
    for axis, span in zip(("x", "y"), spans):
        found = histogram_bins(span, bins)
        counts = rows.groupBy(found.left_closed(F.col(axis)).alias("bin")).agg(F.count(F.lit(1)).alias("value"))
        sides.append(_filled(found, counts, df, False).select(F.lit(axis).alias("axis"), "bin", "lo", "hi", "value"))
    return {"points": scatter(df, x, y, hue, n, key), "marginals": sides[0].unionByName(sides[1])}


#: Cells of the fine grid in one standard deviation of the kernel.
CELLS_PER_WIDTH = 16
#: Standard deviations from which on a kernel counts as zero; it is below 2e-15 of its peak there.
KERNEL_REACH = 8.25


def density2d(df: DataFrame, x: str, y: str, grid: int = 60, approximate: bool = False) -> DataFrame:
    """``gx, gy, x, y, density``: Gaussian kernel density of all complete pairs on a grid.

    The kernel covariance is the sample covariance times n^(-1/3).  Each task
    adds its rows' kernels on the whole grid and passes on one number per grid
    point.  With ``approximate`` rows are first counted on a fine grid, so that
    the kernels cost as much as there are cells in use, whatever the number of
    rows; no value is off by more than 1 / (4 CELLS_PER_WIDTH^2) of the density
    that equal pairs would have in their place.
    """
    rows = pairs(df, x, y)
    fit = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"),
        F.max("y").alias("y1"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_samp("x").alias("xx"),
        F.var_samp("y").alias("yy"), F.covar_samp("x", "y").alias("xy")).first()
    if fit["n"] < 2:
        raise ValueError("At least two valid points are required for a density")
    cov = np.array([[fit["xx"], fit["xy"]], [fit["xy"], fit["yy"]]]) * fit["n"] ** (-1 / 3)
    if fit["x0"] == fit["x1"] or fit["y0"] == fit["y1"] or np.linalg.det(cov) <= 0:
        raise ValueError("The pairs lie on a line; no density exists")
    # Coordinates in which the kernel is the unit circle; the first follows from x alone.
    whiten = np.linalg.inv(np.linalg.cholesky(cov))
    centre = np.array([fit["mx"], fit["my"]])
    step_x = (fit["x1"] - fit["x0"]) / max(grid - 1, 1)
    step_y = (fit["y1"] - fit["y0"]) / max(grid - 1, 1)
    corner = np.array([fit["x0"], fit["y0"]])
    norm = fit["n"] * 2 * np.pi * float(np.sqrt(np.linalg.det(cov)))
    sums = (_binned_kernels if approximate else _kernels)(rows, whiten, centre, corner, np.array([step_x, step_y]), grid)
    points = df.sparkSession.range(grid * grid).select(
        F.pmod("id", F.lit(grid)).cast("int").alias("gx"), F.floor(F.col("id") / grid).cast("int").alias("gy"))
    return points.join(F.broadcast(sums), ["gx", "gy"], "left").select(  # one row for each point of the grid
        "gx", "gy", (F.lit(fit["x0"]) + F.col("gx") * F.lit(step_x)).alias("x"),
        (F.lit(fit["y0"]) + F.col("gy") * F.lit(step_y)).alias("y"), (F.coalesce("s", F.lit(0.0)) / norm).alias("density"))


def _kernels(rows: DataFrame, whiten: np.ndarray, centre: np.ndarray, corner: np.ndarray, step: np.ndarray,
             grid: int) -> DataFrame:
    """``gx, gy, s``: sums of the rows' kernels at every point of the grid."""
    points = np.array([corner + step * (a, b) for b in range(grid) for a in range(grid)])
    at = (points - centre) @ whiten.T

    def add_up(batches):
        total = np.zeros(len(at))
        for batch in batches:
            w = (batch[["x", "y"]].to_numpy(dtype=float) - centre) @ whiten.T
            for i in range(0, len(w), 1024):
                part = w[i:i + 1024]
                d = (at[:, 0, None] - part[None, :, 0]) ** 2 + (at[:, 1, None] - part[None, :, 1]) ** 2
                total += np.exp(-0.5 * d).sum(axis=1)
        yield pd.DataFrame({"gx": np.arange(len(at)) % grid, "gy": np.arange(len(at)) // grid, "s": total})

    return spread(rows).mapInPandas(add_up, "gx int, gy int, s double").groupBy("gx", "gy").agg(F.sum("s").alias("s"))


def _binned_kernels(rows: DataFrame, whiten: np.ndarray, centre: np.ndarray, corner: np.ndarray, step: np.ndarray,
                    grid: int) -> DataFrame:
    """Like ``_kernels``, from rows dealt linearly to the corners of their cells, first along u, then along v."""
    per = CELLS_PER_WIDTH
    scale = (whiten * per).tolist()
    u0, v0 = (whiten @ (corner - centre) * per).tolist()
    along_u, v_by_x, along_v = scale[0][0] * float(step[0]), scale[1][0] * float(step[0]), scale[1][1] * float(step[1])
    x, y = F.col("x") - F.lit(float(centre[0])), F.col("y") - F.lit(float(centre[1]))
    placed = rows.select((x * scale[0][0]).alias("u"), (x * scale[1][0] + y * scale[1][1]).alias("v"))
    parts = placed.select(F.floor("u").alias("i"), F.floor("v").alias("j"), (F.col("u") - F.floor("u")).alias("p"),
                          (F.col("v") - F.floor("v")).alias("q"))
    # Four sums a cell hold all that its rows give to the four corners.
    cells = parts.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"), F.sum("q").alias("q"),
                                        F.sum(F.col("p") * F.col("q")).alias("pq"))
    corners = cells.select(F.inline(F.expr(
        "array(struct(i, j, n - p - q + pq AS w), struct(i + 1 AS i, j, p - pq AS w), "
        "struct(i, j + 1 AS j, q - pq AS w), struct(i + 1 AS i, j + 1 AS j, pq AS w))"))).where("w <> 0")

    def spread_over(table: DataFrame, name: str, place: Column, start: Column, width: float, keys: list) -> DataFrame:
        """The weights of ``place`` on the grid lines ``start + name * width`` within reach."""
        reach = KERNEL_REACH * per
        first = F.greatest(F.ceil((place - reach - start) / width), F.lit(0))
        last = F.least(F.floor((place + reach - start) / width), F.lit(grid - 1))
        near = table.select("*", first.alias("_a"), last.alias("_z")).where("_a <= _z").withColumn(
            name, F.explode(F.sequence("_a", "_z")))
        d = (place - start - F.col(name) * F.lit(width)) / per
        return near.groupBy(*keys, name).agg(F.sum(F.col("w") * F.exp(-0.5 * d * d)).alias("w"))

    columns = spread_over(corners, "gx", F.col("i"), F.lit(u0), along_u, ["j"])
    sums = spread_over(columns, "gy", F.col("j"), F.lit(v0) + F.col("gx") * F.lit(v_by_x), along_v, ["gx"])
    return sums.select(F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), F.col("w").alias("s"))


# --- categories -----------------------------------------------------------


def contingency(df: DataFrame, x: str, y: str, wide: bool = False) -> DataFrame:
    """Counts per pair of categories, zeros included: ``y, x, n``, or one column per x category."""
    require_categorical(df, [x, y])
    rows = df.select(group_label(df, y).alias("__y"), group_label(df, x).alias("x"))
    if wide:
        names = categories(rows, "x")
        return rows.groupBy("__y").pivot("x", names).count().na.fill(0).withColumnRenamed("__y", "y")
    counts = rows.groupBy("__y", "x").agg(F.count(F.lit(1)).alias("n"))
    names = one_row(counts.agg(F.collect_set("x").alias("names"))).getField("names")
    cells = counts.select("__y").distinct().select("__y", F.explode(names).alias("x"))
    return cells.join(counts, ["__y", "x"], "left").select(
        F.col("__y").alias("y"), "x", F.coalesce("n", F.lit(0)).alias("n"))


def filter_groups(df: DataFrame, predicates: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Rows with the label of each predicate they satisfy; a row may appear under several.

    Invalid and empty predicates are skipped; :func:`filter_report` says why.
    """
    usable = {label: text for label, (text, problem) in _checked(df, predicates).items() if not problem}
    if not usable:
        raise ValueError("No valid groups could be constructed")
    labels = F.array_compact(F.array(*[F.when(F.expr(text), F.lit(label)) for label, text in usable.items()]))
    return df.withColumn("label", F.explode(labels))


def _named(predicates: Mapping[str, str] | Sequence[str]) -> dict[str, str]:
    if isinstance(predicates, Mapping):
        return dict(predicates)
    return {f"Group {i + 1}": text for i, text in enumerate(predicates)}


def _checked(df: DataFrame, predicates) -> dict[str, tuple[str, str]]:
    out = {}
    for label, text in _named(predicates).items():
        try:
            where(df, text)
            out[label] = (text, "")
        except ValueError as exc:
            out[label] = (text or "", str(exc))
    return out


def filter_report(df: DataFrame, predicates: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """``label, n, problem`` per predicate: invalid, empty and zero-row filters are named."""
    checked = _checked(df, predicates)
    valid = [label for label, (_, problem) in checked.items() if not problem]
    counts = df.agg(*[F.count_if(F.expr(checked[label][0])).alias(f"c{i}") for i, label in enumerate(valid)]).first() if valid else {}
    rows = []
    for label, (text, problem) in checked.items():
        n = counts[f"c{valid.index(label)}"] if label in valid else 0
        if not problem and n == 0:
            problem = "empty selection"
        rows.append((label, n, problem or None))
    return df.sparkSession.createDataFrame(rows, "label string, n long, problem string")


def multiline(df: DataFrame, column: str, x: str | None = None, group_by: str | None = None,
              filters: Mapping[str, str] | Sequence[str] | None = None, bins: int = 30,
              normalize: bool = False) -> DataFrame:
    """Histogram lines (no ``x``) or binned mean lines, split by a category or by predicates."""
    if (group_by is None) == (filters is None):
        raise ValueError("Provide exactly one of group_by and filters")
    require_numeric(df, [column] + ([x] if x else []))
    if group_by is not None:
        return grouped_line(df, x, column, group_by, bins) if x else group_histogram(
            df, column, group_by, bins, normalize)
    labelled = filter_groups(df, filters)
    if x is None:
        return _labelled_histogram(labelled.select("label", as_number(column).alias("v")), bins, normalize)
    rows = labelled.select("label", as_number(x).alias("x"), as_number(column).alias("y"))
    return _labelled_line(rows, value_ranges(rows, [F.col("x")])[0], bins)


def two_columns(df: DataFrame, x: str, y: str, hue: str | None = None, kind: str | None = None, **options):
    """The chart table for two columns, chosen by their types.

    Numeric pairs: hist, joint, scatter, contour, line.  Numeric by category
    (swapped if needed): box, bar, violin, swarm, swarmonbox.  Two categories:
    contingency.
    """
    require_columns(df, [x, y] + ([hue] if hue else []))
    numeric = [is_numeric(type_of(df, c)) for c in (x, y)]
    category = [is_categorical(type_of(df, c)) for c in (x, y)]
    if all(numeric):
        run = {
            "hist": lambda: histogram2d(df, x, y, **options),
            "joint": lambda: joint(df, x, y, hue=hue, **options),
            "scatter": lambda: scatter(df, x, y, hue, **options),
            "contour": lambda: density2d(df, x, y, **options),
            "line": lambda: grouped_line(df, x, y, hue, **options) if hue else line(df, x, y, **options),
        }
        return _chosen(run, (kind or "hist").lower())
    if all(category):
        return contingency(df, x, y)
    if not ((numeric[0] and category[1]) or (category[0] and numeric[1])):
        raise ValueError(f"Columns '{x}' and '{y}' must be numeric or categorical")
    number, label = (x, y) if numeric[0] else (y, x)
    run = {
        "box": lambda: profile.box_stats(df, number, label, hue),
        "bar": lambda: profile.grouped_bar(df, number, label, hue),
    } | {points: lambda: category_points(df, number, label, hue, **options)
         for points in ("violin", "swarm", "swarmonbox")}
    return _chosen(run, (kind or "box").lower())


def _chosen(run: Mapping[str, object], kind: str):
    if kind not in run:
        raise ValueError(f"Invalid kind '{kind}'. Allowed: {', '.join(run)}")
    return run[kind]()


def category_points(df: DataFrame, x: str, by: str, hue: str | None = None, n: int = MAX_POINTS,
                    key: Sequence[str] | None = None) -> DataFrame:
    """Sampled rows ``x, by[, hue]`` with both present, for violin and swarm charts."""
    require_numeric(df, [x])
    require_categorical(df, [by])
    cols = [x, by] + ([hue] if hue and hue not in (x, by) else [])
    return sample(df.where(~is_missing(df, x) & ~is_missing(df, by)), n, key).select(*[col(c) for c in cols])
