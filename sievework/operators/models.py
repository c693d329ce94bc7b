"""Curves through (x, y) clouds: polynomial, robust line, LOWESS.

Each fit is a few aggregate passes over the rows; the driver only sees sums.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.quantiles import quantile
from sievework.functions.schema import as_number, require_numeric
from sievework.functions.stats import deviation
from sievework.functions.work import settle, spread

CURVE_POINTS = 200


def _cloud(df: DataFrame, x: str, y: str, log_x: bool = False) -> tuple[DataFrame, float, float]:
    """Complete pairs ``x`` (as fitted), ``y`` and the range of the untransformed x."""
    require_numeric(df, [x, y])
    rows = df.select(as_number(x).alias("raw"), as_number(y).alias("y")).where("raw is not null and y is not null")
    span = rows.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).first()
    if span["lo"] is None:
        raise ValueError("No valid numeric pairs")
    if log_x and span["lo"] <= 0:
        raise ValueError(f"log_x is invalid because column '{x}' contains non-positive values")
    fitted = F.log("raw") if log_x else F.col("raw")
    return rows.select(fitted.alias("x"), "y"), span["lo"], span["hi"]


def _curve(spark, lo: float, hi: float, coefficients: Sequence[float], log_x: bool, points: int) -> DataFrame:
    """``x, y_fit`` of a polynomial (highest power first) on equal steps from lo to hi."""
    x = np.linspace(lo, hi, points)
    y = np.polyval(coefficients, np.log(x) if log_x else x)
    return spark.createDataFrame(pd.DataFrame({"x": x, "y_fit": y}), "x double, y_fit double")


def _coefficients(spark, coefficients: Sequence[float]) -> DataFrame:
    top = len(coefficients) - 1
    return spark.createDataFrame(
        [(top - i, float(c)) for i, c in enumerate(coefficients)], "power int, coefficient double")


# --- polynomial -----------------------------------------------------------


def _fit_poly(rows: DataFrame, order: int) -> np.ndarray:
    if not 1 <= order <= 5:
        raise ValueError("order must be between 1 and 5")
    row = rows.agg(F.avg("x").alias("m"), deviation(F.col("x")).alias("s")).first()
    m, s = row["m"], row["s"] or 1.0
    z = (F.col("x") - F.lit(m)) / F.lit(s)
    powers = [F.lit(1.0)]
    for _ in range(2 * order):
        powers.append(powers[-1] * z)
    row = rows.agg(*[F.sum(p).alias(f"s{i}") for i, p in enumerate(powers)],
                   *[F.sum(powers[i] * F.col("y")).alias(f"t{i}") for i in range(order + 1)]).first()
    a = np.array([[row[f"s{i + j}"] for j in range(order + 1)] for i in range(order + 1)])
    b = np.array([row[f"t{i}"] for i in range(order + 1)])
    in_z = np.linalg.lstsq(a, b, rcond=None)[0]
    # Back from powers of (x - m) / s to powers of x.
    return (np.poly1d(in_z[::-1])(np.poly1d([1 / s, -m / s]))).coeffs


def poly_fit(df: DataFrame, x: str, y: str, order: int = 1, log_x: bool = False) -> DataFrame:
    """``power, coefficient`` of the least squares polynomial, highest power first."""
    rows, _, _ = _cloud(df, x, y, log_x)
    found = _fit_poly(rows, order)
    return _coefficients(df.sparkSession, np.concatenate([np.zeros(order + 1 - len(found)), found]))


def poly_curve(df: DataFrame, x: str, y: str, order: int = 1, log_x: bool = False,
               points: int = CURVE_POINTS) -> DataFrame:
    """``x, y_fit`` of the polynomial over the range of x."""
    rows, lo, hi = _cloud(df, x, y, log_x)
    return _curve(df.sparkSession, lo, hi, _fit_poly(rows, order), log_x, points)


# --- robust line ----------------------------------------------------------

# The Huber threshold, the normal consistency factor of the
# median absolute deviation, and the stopping rule.
HUBER_T = 1.345
MAD_FACTOR = 0.6745
MAX_STEPS = 50
TOLERANCE = 1e-8


def _fit_robust(rows: DataFrame) -> tuple[float, float]:
    """Slope and intercept by iteratively reweighted least squares."""
    if not rows.agg(deviation(F.col("x"))).first()[0]:
        raise ValueError("x is constant; no line can be fitted")
    rows = spread(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        m = rows.agg(F.avg("x")).first()[0]
        x, y = F.col("x") - F.lit(m), F.col("y")

        def solve(w: Column) -> tuple[float, float]:
            row = rows.agg(F.sum(w).alias("w"), F.sum(w * x).alias("wx"), F.sum(w * y).alias("wy"),
                           F.sum(w * x * x).alias("wxx"), F.sum(w * x * y).alias("wxy")).first()
            det = row["w"] * row["wxx"] - row["wx"] ** 2
            slope = (row["w"] * row["wxy"] - row["wx"] * row["wy"]) / det
            return slope, (row["wy"] - slope * row["wx"]) / row["w"]

        slope, level = solve(F.lit(1.0))
        for _ in range(MAX_STEPS):
            residual = F.abs(y - F.lit(slope) * x - F.lit(level))
            scale = quantile(rows, residual, 0.5) / MAD_FACTOR
            if scale == 0:
                break
            bound = HUBER_T * scale
            weight = F.when(residual <= bound, F.lit(1.0)).otherwise(F.lit(bound) / residual)
            before = (slope, level)
            slope, level = solve(weight)
            moved = max(abs(slope - before[0]), abs(level - before[1]))
            if moved <= TOLERANCE * max(abs(slope), abs(level), 1e-300):
                break
        return slope, level - slope * m
    finally:
        rows.unpersist()


def robust_fit(df: DataFrame, x: str, y: str, log_x: bool = False) -> DataFrame:
    """``power, coefficient`` of a Huber-weighted line."""
    rows, _, _ = _cloud(df, x, y, log_x)
    return _coefficients(df.sparkSession, _fit_robust(rows))


def robust_curve(df: DataFrame, x: str, y: str, log_x: bool = False, points: int = CURVE_POINTS) -> DataFrame:
    rows, lo, hi = _cloud(df, x, y, log_x)
    return _curve(df.sparkSession, lo, hi, _fit_robust(rows), log_x, points)


# --- LOWESS ---------------------------------------------------------------

# Share of the rows in a neighbourhood, robustness steps.
FRACTION = 0.66
ROBUST_STEPS = 3
#: Distinct x that are fitted from dense tables; more are fitted block by block, with the same values.
MAX_ANCHORS = 1000
#: Distinct x in a block, and the most blocks there are.
BLOCK_CELLS = 4096
MAX_BLOCKS = 2048
#: Powers of the distance in tricube times square: 0 to 11.
POWERS = 12
_CHOOSE = [[math.comb(p, q) for q in range(p + 1)] for p in range(POWERS)]


@dataclass(frozen=True)
class _Smooth:
    """Fitted values at the anchors; linear in between."""

    x: np.ndarray
    y: np.ndarray

    def at(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.x, self.y)


def _reaches(distinct: list, n: int, fraction: float) -> tuple[np.ndarray, np.ndarray]:
    """The distinct x, and the distance that reaches the k-th nearest row from each."""
    x = np.array([r["x"] for r in distinct])
    weight = np.array([r["n"] for r in distinct], dtype=float)
    k = _neighbours(n, fraction)
    reach = np.empty(len(x))
    for i, a in enumerate(x):
        d = np.abs(x - a)
        order = np.argsort(d, kind="stable")
        far = int(np.searchsorted(np.cumsum(weight[order]), k * (1 - 1e-12), side="left"))
        reach[i] = d[order[min(far, len(x) - 1)]]
    return x, reach


def _neighbours(n: int, fraction: float) -> int:
    return max(1, int(fraction * n + 1e-10))


def _local_sums(rows: DataFrame, at: np.ndarray, reach: np.ndarray, smooth: _Smooth | None,
                cut: float | None) -> _Smooth:
    """Weighted line at every anchor: each task adds its rows' terms for all anchors."""
    span = np.where(reach > 0, reach, 1.0)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((5, len(at)))
        for batch in batches:
            xs, ys = batch["x"].to_numpy(dtype=float), batch["y"].to_numpy(dtype=float)
            for i in range(0, len(xs), 2048):
                x, y = xs[i:i + 2048], ys[i:i + 2048]
                d = x[:, None] - at[None, :]
                u = np.minimum(np.abs(d) / span, 1.0)
                w = 1 - u * u * u
                w = w * w * w
                if smooth is not None and cut is not None:
                    r = np.minimum(np.abs(y - smooth.at(x)) / cut, 1.0)
                    w *= ((1 - r * r) ** 2)[:, None]
                wd = w * d
                total += np.stack([w.sum(0), wd.sum(0), np.einsum("ij,ij->j", wd, d), y @ w, y @ wd])
        yield pd.DataFrame({"a": np.arange(len(at)), **{f"s{j}": total[j] for j in range(5)}})

    schema = "a int, " + ", ".join(f"s{j} double" for j in range(5))
    sums = rows.mapInPandas(add_up, schema).groupBy("a").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(5)])
    s = sums.orderBy("a").toPandas().drop(columns="a").to_numpy().T
    live = s[0] > 0
    w = np.where(live, s[0], 1.0)
    mean_d, mean_y = s[1] / w, s[3] / w
    var = np.maximum(s[2] / w - mean_d ** 2, 1e-12)
    slope = (s[4] / w - mean_d * mean_y) / var
    return _Smooth(at[live], (mean_y - slope * mean_d)[live])


def _residual(smooth: _Smooth):
    @F.pandas_udf(T.DoubleType())
    def residual(x: pd.Series, y: pd.Series) -> pd.Series:
        return (y - smooth.at(x.to_numpy())).abs()
    return residual


def _shifted(moments: np.ndarray, ratio: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Moments about another centre and in another unit: ``ratio`` is old unit by new, ``step`` the old centre seen from the new."""
    up, right = [np.ones_like(ratio)], [np.ones_like(step)]
    for _ in range(1, POWERS):
        up.append(up[-1] * ratio)
        right.append(right[-1] * step)
    scaled = [moments[..., q] * up[q] for q in range(POWERS)]
    return np.stack([sum(_CHOOSE[p][q] * scaled[q] * right[p - q] for q in range(p + 1)) for p in range(POWERS)], axis=-1)


class _Tree:
    """Sums of centred powers over runs of leaves, which are single x or whole blocks in the order of x.

    ``moments`` has the weights in row 0 and weight times y in row 1; each node
    is centred on itself and measured in its own half width, so no digits are
    lost where a sum is seen from a place within its reach.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray, moments: np.ndarray):
        size = 1 << max(0, (len(lo) - 1).bit_length())
        pad = size - len(lo)
        lo, hi = np.r_[lo, np.full(pad, hi[-1])], np.r_[hi, np.full(pad, hi[-1])]
        moments = np.concatenate((moments, np.zeros((2, pad, POWERS))), axis=1)
        self.levels = [(*_frame(lo, hi), moments)]
        while len(lo) > 1:
            lo, hi = lo[::2], hi[1::2]
            centre, unit = _frame(lo, hi)
            below, width, inner = self.levels[-1]
            moments = sum(_shifted(inner[:, i::2], width[i::2] / unit, (below[i::2] - centre) / unit) for i in (0, 1))
            self.levels.append((centre, unit, moments))

    def sums(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Sums over the leaves from left to before right of ((x - at) / unit) ^ p, for weights and weight times y."""
        out = np.zeros((2, len(at), POWERS))
        left, right = left.copy(), np.maximum(left, right)
        for centre, width, moments in self.levels:
            for odd, node in (((left & 1) == 1, left), ((right & 1) == 1, right - 1)):
                own = np.flatnonzero(odd & (left < right))
                at_node = node[own]
                out[:, own] += _shifted(moments[:, at_node], width[at_node] / unit[own], (centre[at_node] - at[own]) / unit[own])
                if node is left:
                    left = left + (odd & (left < right))
            right = right - ((right & 1 == 1) & (left < right))
            left, right = left >> 1, right >> 1
        return out


def _frame(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unit = hi / 2 - lo / 2
    return lo + unit, np.where(unit > 0, unit, 1.0)


def _leaf_moments(w: np.ndarray, wy: np.ndarray) -> np.ndarray:
    out = np.zeros((2, len(w), POWERS))
    out[:, :, 0] = w, wy
    return out


def _reach(a: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: np.ndarray, k: float) -> np.ndarray:
    """The distance from each ``a`` (leaf ``own``) within which there are k rows; only whole leaves count."""
    total = np.r_[0, np.cumsum(n)]
    last = len(lo) - 1

    def first_from(d):
        i = np.searchsorted(lo, a - d)
        i = np.where((i > 0) & (a - lo[np.maximum(i - 1, 0)] <= d), i - 1, i)
        return np.where((i < last) & (a - lo[np.minimum(i, last)] > d), i + 1, i)

    def end_of(d):
        j = np.searchsorted(hi, a + d, "right")
        j = np.where((j <= last) & (hi[np.minimum(j, last)] - a <= d), j + 1, j)
        return np.where((j > 0) & (hi[np.maximum(j - 1, 0)] - a > d), j - 1, j)

    best = np.full(len(a), np.inf)
    for distance, count, most in (
            (lambda s: hi[own + s] - a, lambda s, d: total[own + s + 1] - total[np.minimum(first_from(d), own)], last - own),
            (lambda s: a - lo[own - s], lambda s, d: total[np.maximum(end_of(d), own + 1)] - total[own - s], own)):
        low, high = np.zeros(len(a), np.int64), most + 1  # steps away from the own leaf
        while (low < high).any():
            mid = np.minimum((low + high) // 2, most)
            enough = count(mid, distance(mid)) >= k
            open_ = low < high
            high, low = np.where(open_ & enough, mid, high), np.where(open_ & ~enough, mid + 1, low)
        found = low <= most
        best = np.where(found, np.minimum(best, distance(np.minimum(low, most))), best)
    return best


def _lines(a: np.ndarray, span: np.ndarray, own: np.ndarray, lo: np.ndarray, hi: np.ndarray, tree: _Tree) -> np.ndarray:
    """The weighted line of each neighbourhood at its ``a``; NaN where all weights are zero."""
    total, whole = np.zeros((2, 3, len(a))), 0.0
    for left, right, sign in ((np.minimum(np.searchsorted(lo, a - span), own), own, -1.0),
                              (own, np.maximum(np.searchsorted(hi, a + span, "right"), own + 1), 1.0)):
        sums = tree.sums(left, right, a, span)
        whole = whole + sums[0, :, 0]
        for j, factor in enumerate((1, -3, 3, -1)):
            total += factor * sign ** j * np.moveaxis(sums[:, :, 3 * j:3 * j + 3], 2, 1)
    live = total[0, 0] > 1e-12 * whole
    w = np.where(live, total[0, 0], 1.0)
    # Distances come in units of the span, and so does the least variance.
    mean_d, mean_y = total[0, 1] / w, total[1, 0] / w
    var = np.maximum(total[0, 2] / w - mean_d ** 2, 1e-12 / span ** 2)
    slope = (total[1, 1] / w - mean_d * mean_y) / var
    return np.where(live, mean_y - slope * mean_d, np.nan)


class _Blocks:
    """LOWESS at every distinct x, block by block of x.

    Neighbourhoods end in few blocks, which follow from the blocks' counts and
    bounds.  A group fits the x of one block: it has the single x of its own
    block and of those where neighbourhoods can end, and of all others only
    sums of powers.
    """

    def __init__(self, rows: DataFrame, n: int, distinct: int, fraction: float):
        self.rows, self.k = rows, _neighbours(n, fraction) * (1 - 1e-12)
        blocks = min(MAX_BLOCKS, -(-distinct // BLOCK_CELLS))
        probs = [i / blocks for i in range(1, blocks)]
        cells = rows.groupBy("x").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("wy"))
        self.cuts = np.unique(cells.agg(F.percentile_approx("x", probs, 10 * blocks)).first()[0]) if probs else np.zeros(0)
        self.cells = settle(cells.select("x", self.block("x").alias("block"), "n", F.col("n").alias("w"), "wy"))
        bounds = self.cells.groupBy("block").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("n")).toPandas()
        bounds = bounds.sort_values("block")
        self.name = bounds["block"].to_numpy()
        self.lo, self.hi, self.n = (bounds[c].to_numpy(dtype=float) for c in ("lo", "hi", "n"))
        self.needs = self._needs()

    def block(self, x: str) -> Column:
        cuts = self.cuts

        @F.pandas_udf(T.LongType())
        def place(v: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(cuts, v.to_numpy(dtype=float), "right"))
        return place(F.col(x))

    def _bounds(self, a: float) -> tuple[float, float]:
        """Least and largest distance at which k rows can be reached, by whole blocks."""
        touch = np.maximum(np.maximum(self.lo - a, a - self.hi), 0.0)
        inside = np.maximum(np.abs(self.lo - a), np.abs(self.hi - a))
        out = []
        for d in (touch, inside):
            order = np.argsort(d, kind="stable")
            out.append(d[order[min(int(np.searchsorted(np.cumsum(self.n[order]), self.k)), len(d) - 1)]])
        return out[0], out[1]

    def _needs(self) -> dict[int, list[int]]:
        """For each block the blocks whose groups need its single x."""
        out = {int(b): [] for b in self.name}
        for i, b in enumerate(self.name):
            (least, most), (low, high) = self._bounds(self.lo[i]), self._bounds(self.hi[i])
            a, z = self.lo[i], self.hi[i]
            ends = [(a, z), (a - most, z - low), (a + least, z + high)]
            if min(least, low) == 0:  # one x may hold a whole neighbourhood; it then reaches by 1
                ends += [(a - most, z), (a, z + high), (a - 1, z - 1), (a + 1, z + 1)]
            near = np.zeros(len(self.name), bool)
            for start, end in ends:
                slack = 1e-9 * (abs(start) + abs(end))
                near |= (self.hi >= start - slack) & (self.lo <= end + slack)
            for other in self.name[near]:
                out[int(other)].append(int(b))
        return out

    def fit(self, cells: DataFrame) -> DataFrame:
        """(x, block, y_fit) at every distinct x; no y_fit where all weights are zero."""
        needs, k = self.needs, self.k
        name, lo, hi, n = self.name, self.lo, self.hi, self.n
        frame = {int(b): (c, u) for b, c, u in zip(name, *_frame(lo, hi))}

        def add_up(own: pd.DataFrame) -> pd.DataFrame:
            block = int(own["block"].iloc[0])
            centre, unit = frame[block]
            powers = ((own["x"].to_numpy() - centre) / unit)[None, :] ** np.arange(POWERS)[:, None]
            return pd.DataFrame({"block": [block], "m": [[float(v) for c in ("w", "wy") for v in powers @ own[c].to_numpy()]]})

        sums = {r["block"]: r["m"] for r in cells.groupBy("block").applyInPandas(add_up, "block long, m array<double>").collect()}
        moments = np.array([sums[b] for b in name.tolist()]).reshape(len(name), 2, POWERS).transpose(1, 0, 2)

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch["group"] = [needs[b] for b in batch["block"].tolist()]
                yield batch.explode("group").astype({"group": "int64"})

        def lines(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("x")
            block, x = own["block"].to_numpy(), own["x"].to_numpy()
            group = int(own["group"].iloc[0])
            rest = ~np.isin(name, block)
            start = np.r_[x, lo[rest]]
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.r_[x, hi[rest]][order]
            leaves = np.concatenate((_leaf_moments(own["w"].to_numpy(), own["wy"].to_numpy()), moments[:, rest]), axis=1)[:, order]
            count = np.r_[own["n"].to_numpy(), n[rest]][order]
            tree, mine = _Tree(start, end, leaves), x[block == group]
            fits = []
            for i in range(0, len(mine), 8192):
                a = mine[i:i + 8192]
                at = np.searchsorted(start, a)
                span = _reach(a, at, start, end, count, k)
                fits.append(_lines(a, np.where(span > 0, span, 1.0), at, start, end, tree))
            return pd.DataFrame({"x": mine, "block": group, "y_fit": np.concatenate(fits)})

        dealt = cells.mapInPandas(deal, "x double, block long, n double, w double, wy double, group long")
        fits = dealt.groupBy("group").applyInPandas(lines, "x double, block long, y_fit double")
        return settle(fits.withColumn("y_fit", F.nanvl("y_fit", F.lit(None).cast("double"))))

    def at(self, fits: DataFrame, places: DataFrame) -> DataFrame:
        """(x, y_fit) at the distinct x of ``places``, linear between fitted x."""
        live = fits.where("y_fit IS NOT NULL")
        ends = live.groupBy("block").agg(F.min(F.struct("x", "y_fit")).alias("a"), F.max(F.struct("x", "y_fit")).alias("z")).collect()
        ends = sorted((r["block"], tuple(r["a"]), tuple(r["z"])) for r in ends)

        def between(known: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            if not len(wanted):
                return pd.DataFrame({"x": [], "y_fit": []}, dtype=float)
            block = int(wanted["block"].iloc[0])
            points = sorted([*zip(known["x"].tolist(), known["y_fit"].tolist()), *[z for b, _, z in ends if b < block][-1:],
                             *[a for b, a, _ in ends if b > block][:1]])
            x, y = zip(*points)
            return pd.DataFrame({"x": wanted["x"], "y_fit": np.interp(wanted["x"], x, y)})

        wanted = places.select("x").where("x IS NOT NULL").distinct().withColumn("block", self.block("x"))
        return live.groupBy("block").cogroup(wanted.groupBy("block")).applyInPandas(between, "x double, y_fit double")

    def weighted(self, fits: DataFrame) -> DataFrame | None:
        """The cells with robustness weights from the residuals; None if half of the rows are met exactly."""
        full = fits if not fits.where("y_fit IS NULL").limit(1).count() else self.at(fits, self.rows)
        left = settle(self.rows.join(full.select("x", "y_fit"), "x").select("x", "y", F.abs(F.col("y") - F.col("y_fit")).alias("r")))
        median = quantile(left, F.col("r"), 0.5)
        if not median:
            return None
        u = F.least(F.col("r") / (6 * median), F.lit(1.0))
        w = (1 - u * u) * (1 - u * u)
        cells = left.groupBy("x").agg(F.sum(w).alias("w"), F.sum(w * F.col("y")).alias("wy"))
        return settle(self.cells.select("x", "block", "n").join(cells, "x").select("x", "block", "n", "w", "wy"))


def _fit_dense(rows: DataFrame, n: int, distinct: list, fraction: float, steps: int) -> _Smooth:
    at, reach = _reaches(distinct, n, fraction)
    smooth = _local_sums(rows, at, reach, None, None)
    for _ in range(steps):
        median = quantile(rows, _residual(smooth)("x", "y"), 0.5)
        if not median:
            break
        smooth = _local_sums(rows, at, reach, smooth, 6 * median)
    return smooth


def _fit_blocks(rows: DataFrame, n: int, fraction: float, steps: int) -> tuple[_Blocks, DataFrame]:
    blocks = _Blocks(rows, n, rows.select("x").distinct().count(), fraction)
    fits = blocks.fit(blocks.cells)
    for _ in range(steps):
        cells = blocks.weighted(fits)
        if cells is None:
            break
        fits = blocks.fit(cells)
    return blocks, fits


def _fit_lowess(rows: DataFrame, fraction: float, steps: int) -> _Smooth | tuple[_Blocks, DataFrame]:
    rows = spread(rows).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = rows.count()
        distinct = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x").limit(MAX_ANCHORS + 1).collect()
        if len(distinct) <= MAX_ANCHORS:
            return _fit_dense(rows, n, distinct, fraction, steps)
        return _fit_blocks(rows, n, fraction, steps)
    finally:
        rows.unpersist()


def lowess(df: DataFrame, x: str, y: str, fraction: float = FRACTION, steps: int = ROBUST_STEPS,
           log_x: bool = False) -> DataFrame:
    """``x, y_fit``: locally weighted line with robustness steps at every distinct x, sorted by x.

    An x whose neighbourhood has only rows of weight zero is left out.
    """
    rows, _, _ = _cloud(df, x, y, log_x)
    smooth = _fit_lowess(rows, fraction, steps)
    if not isinstance(smooth, _Smooth):
        at = F.exp("x") if log_x else F.col("x")
        return smooth[1].where("y_fit IS NOT NULL").select(at.alias("x"), "y_fit").orderBy("x")
    at = np.exp(smooth.x) if log_x else smooth.x
    return df.sparkSession.createDataFrame(
        pd.DataFrame({"x": at, "y_fit": smooth.y}), "x double, y_fit double").orderBy("x")


def with_lowess(df: DataFrame, x: str, y: str, into: str = "y_fit", fraction: float = FRACTION,
                steps: int = ROBUST_STEPS) -> DataFrame:
    """Every row with its fitted value as a new column."""
    rows, _, _ = _cloud(df, x, y)
    smooth = _fit_lowess(rows, fraction, steps)
    if not isinstance(smooth, _Smooth):
        blocks, fits = smooth
        key, value = f"__x_{uuid.uuid4().hex}", f"__y_{uuid.uuid4().hex}"
        found = blocks.at(fits, df.select(as_number(x).alias("x"))).select(F.col("x").alias(key), F.col("y_fit").alias(value))
        return df.join(found, as_number(x) == F.col(key), "left").withColumn(into, F.col(value)).drop(key, value)

    @F.pandas_udf(T.DoubleType())
    def fitted(v: pd.Series) -> pd.Series:
        return pd.Series(np.where(v.isna(), np.nan, smooth.at(v.to_numpy(dtype=float))))

    return df.withColumn(into, F.nanvl(fitted(as_number(x)), F.lit(None).cast("double")))


def regression(df: DataFrame, x: str, y: str, order: int = 1, log_x: bool = False, robust: bool = False,
               smooth: bool = False, points: int = CURVE_POINTS) -> DataFrame:
    """``x, y_fit`` of the chosen fit: LOWESS, robust line or polynomial."""
    if smooth:
        return lowess(df, x, y, log_x=log_x)
    if robust:
        if order != 1:
            raise ValueError("Robust fitting needs order 1")
        return robust_curve(df, x, y, log_x, points)
    return poly_curve(df, x, y, order, log_x, points)
