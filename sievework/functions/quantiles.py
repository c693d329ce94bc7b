"""Exact quantiles and running totals that never gather a column in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one hash
map.  Here a whole-column quantile is found by narrowing: a sample proposes an
interval around the wanted order statistic, a scan counts what lies below and
inside it, and the few distinct values inside are listed.  The counts prove
that the interval holds the statistic; if it does not, a wider one is tried.
No scan shuffles more than the listed values.

Grouped quantiles and ranks count equal values first (which collapses hot
values on the map side) and then run over value ranges, each of which is its
own window partition.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.schema import col

# Up to this many rows one task may sort, and about this many values are listed.
SMALL_ROWS = 50_000
# Rows drawn to propose an interval (a tenth, within these bounds), and how many
# standard errors wide it is.
SAMPLE_ROWS = 50_000
MAX_SAMPLE_ROWS = 2_000_000
STANDARD_ERRORS = 6
ACCURACY = 5_000
SEED = 17
# Rows one window partition is meant to hold.
ROWS_PER_RANGE = 250_000
MAX_RANGES = 4096


@dataclass
class _Search:
    """One order statistic of a column and the values [lo, hi] known to hold it.

    ``near`` is the quantile's place between ranks, shared by its two order
    statistics, so that both search the same intervals.
    """

    column: str
    rank: int
    near: int
    lo: float
    hi: float
    below: int
    inside: int
    slack: float = 1.0

    def span(self) -> tuple[str, float, float]:
        return self.column, self.lo, self.hi


def _draw(inside: int) -> int:
    return min(inside, max(SAMPLE_ROWS, min(MAX_SAMPLE_ROWS, inside // 10)))


def _margin(search: _Search) -> float:
    return search.slack * (0.5 * STANDARD_ERRORS / math.sqrt(_draw(search.inside)) + 2 / ACCURACY)


def _proposed(rows: DataFrame, searches: list[_Search]) -> list[_Search]:
    """Narrower intervals from a sample of the rows inside; ``inside`` is what to expect in them."""
    keys = {(s.span(), s.near): s for s in searches}
    shares = {k: _draw(s.inside) / s.inside for k, s in keys.items()}
    drawn = rows.withColumn("_u", F.rand(SEED)).where(F.col("_u") < max(shares.values()))
    sketches = []
    for i, (k, s) in enumerate(keys.items()):
        v, margin = F.col(s.column), _margin(s)
        probs = [max(0.0, (s.near - s.below) / s.inside - margin),
                 min(1.0, (s.near + 1 - s.below) / s.inside + margin)]
        held = F.when(v.between(s.lo, s.hi) & (F.col("_u") < shares[k]), v)
        sketches.append(F.percentile_approx(held, probs, ACCURACY).alias(f"s{i}"))
    row = drawn.agg(*sketches).first()
    ends = {k: row[f"s{i}"] for i, k in enumerate(keys)}
    out = []
    for s in searches:
        lo, hi = ends[s.span(), s.near] or (s.lo, s.hi)
        margin = _margin(s)
        # The ends of the sample are not the ends of the data.
        lo = s.lo if (s.near - s.below) / s.inside <= margin else lo
        hi = s.hi if (s.near + 1 - s.below) / s.inside >= 1 - margin else hi
        out.append(replace(s, lo=lo, hi=hi, inside=math.ceil(2 * margin * s.inside)))
    return out


def _counted(rows: DataFrame, searches: list[_Search]) -> list[_Search | float | None]:
    """The statistic where it is an end of its interval, what is left of the interval, or None if it lies outside."""
    spans = list({s.span() for s in searches})
    aggs = []
    for i, (name, lo, hi) in enumerate(spans):
        v = F.col(name)
        aggs += [F.count_if(v < lo).alias(f"b{i}"), F.count_if(v.between(lo, hi)).alias(f"m{i}"),
                 F.count_if(v == lo).alias(f"l{i}"), F.count_if(v == hi).alias(f"h{i}")]
    row = rows.agg(*aggs).first()
    out: list[_Search | float | None] = []
    for s in searches:
        i = spans.index(s.span())
        below, inside, at_lo, at_hi = row[f"b{i}"], row[f"m{i}"], row[f"l{i}"], row[f"h{i}"]
        if not below <= s.rank < below + inside:
            out.append(None)
        elif s.rank < below + at_lo:
            out.append(s.lo)
        elif s.rank >= below + inside - at_hi:
            out.append(s.hi)
        else:
            out.append(replace(s, lo=float(np.nextafter(s.lo, np.inf)), hi=float(np.nextafter(s.hi, -np.inf)),
                               below=below + at_lo, inside=inside - at_lo - at_hi, slack=1.0))
    return out


def _listed(rows: DataFrame, searches: list[_Search]) -> list[float | None]:
    """The order statistic, or None where the interval does not hold it.

    Two scans in one job: plain counts, and a filter that leaves the few rows
    inside an interval to be grouped.
    """
    spans = list({s.span() for s in searches})
    below, inside, anywhere = [], [], F.lit(False)
    for i, (name, lo, hi) in enumerate(spans):
        v = F.col(name)
        held = v.between(lo, hi)
        below.append(F.count_if(v < lo).alias(f"b{i}"))
        inside.append(F.when(held, F.struct(F.lit(i).alias("i"), v.alias("value"))))
        anywhere = anywhere | held
    counts = rows.agg(*below).select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("value"), F.col(f"b{i}").alias("n"))
        for i in range(len(spans))])))
    values = rows.where(anywhere).select(F.inline(F.array_compact(F.array(*inside)))).groupBy("i", "value").agg(
        F.count(F.lit(1)).alias("n"))
    seen: list[list[tuple]] = [[] for _ in spans]
    for row in counts.unionByName(values).collect():
        seen[row["i"]].append((row["value"], row["n"]))
    tables = []
    for pairs in seen:
        start = next(n for v, n in pairs if v is None)
        held = sorted((v, n) for v, n in pairs if v is not None)
        tables.append((start, held, start + np.cumsum([n for _, n in held], dtype=np.int64)))
    out = []
    for s in searches:
        start, held, ends = tables[spans.index(s.span())]
        out.append(float(held[int(np.searchsorted(ends, s.rank, side="right"))][0])
                   if held and start <= s.rank < ends[-1] else None)
    return out


def _statistics(rows: DataFrame, searches: list[_Search]) -> list[float]:
    """Exact order statistics, each starting from the whole range of its column."""
    found: dict[int, float] = {}
    left = dict(enumerate(searches))
    while left:
        wide = {i: s for i, s in left.items() if s.inside > SMALL_ROWS}
        tried = dict(left)
        if wide:
            tried.update(zip(wide, _proposed(rows, list(wide.values()))))
        short = all(s.inside <= 2 * SMALL_ROWS for s in tried.values())
        results = (_listed if short else _counted)(rows, list(tried.values()))
        for i, result in zip(tried, results):
            if result is None:
                left[i] = replace(left[i], slack=left[i].slack * 4)
            elif isinstance(result, _Search):
                left[i] = result
            else:
                found[i] = result
                del left[i]
    return [found[i] for i in range(len(searches))]


def quantiles(df: DataFrame, values: Mapping[str, Column],
              probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of several columns (NULLs skipped).

    The driver sees counts, interval bounds and at most some ten thousand
    distinct values per wanted quantile, whatever the size of the table.
    """
    probs = [float(p) for p in probs]
    names = {name: f"v{i}" for i, name in enumerate(values)}
    rows = df.select(*[v.cast("double").alias(names[name]) for name, v in values.items()])
    aggs = []
    for v in names.values():
        aggs += [F.count(v).alias(f"{v}_n"), F.min(v).alias(f"{v}_lo"), F.max(v).alias(f"{v}_hi")]
    first = rows.agg(*aggs).first()
    sizes = {name: first[f"{v}_n"] for name, v in names.items()}
    if max(sizes.values(), default=0) <= SMALL_ROWS:
        # Few enough rows for one task, as counted above.
        row = rows.agg(*[F.percentile(v, probs).alias(v) for v in names.values()]).first()
        return {name: list(row[v] or [None] * len(probs)) for name, v in names.items()}
    searches = {}
    for name, v in names.items():
        for p in probs if sizes[name] else []:
            at = p * (sizes[name] - 1)
            for rank in (math.floor(at), math.ceil(at)):
                searches[name, rank] = _Search(
                    v, rank, math.floor(at), first[f"{v}_lo"], first[f"{v}_hi"], 0, sizes[name])
    found = dict(zip(searches, _statistics(rows, list(searches.values()))))
    return {name: [_interpolated(found, name, sizes[name], p) for p in probs] for name in values}


def _interpolated(found: Mapping[tuple[str, int], float], name: str, n: int, p: float) -> float | None:
    if n == 0:
        return None
    at = p * (n - 1)
    low, high = found[name, math.floor(at)], found[name, math.ceil(at)]
    return low + (high - low) * (at - math.floor(at))


def quantile(df: DataFrame, value: Column, p: float) -> float | None:
    return quantiles(df, {"x": value}, [p])["x"][0]


# --- value ranges ---------------------------------------------------------


def _borders(cuts: Sequence[float]) -> list[float]:
    """Sorted range borders; a value met twice gets a range of its own."""
    borders: set[float] = set()
    for i, cut in enumerate(cuts):
        borders.add(cut)
        if i and cuts[i - 1] == cut:
            borders.add(float(np.nextafter(cut, np.inf)))
    return sorted(borders)


def column_splits(df: DataFrame, values: Sequence[Column], ranges: int | None = None) -> list[list[float]]:
    """Inner borders that cut each column into ranges of about equal row counts.

    A value so frequent that it fills a range gets a range of its own.  With
    ``ranges=None`` the number follows from the row count.
    """
    rows = df.select(*[v.cast("double").alias(f"c{i}") for i, v in enumerate(values)])
    names = rows.columns
    n = max(rows.agg(*[F.count(c) for c in names]).first())
    if ranges is None:
        ranges = min(MAX_RANGES, math.ceil(n / ROWS_PER_RANGE))
    if ranges < 2:
        return [[] for _ in names]
    probs = [i / ranges for i in range(1, ranges)]
    # Only the balance of the ranges rests on the sample.
    sample = rows.sample(min(1.0, (SAMPLE_ROWS + 100 * ranges) / n), SEED)
    row = sample.agg(*[F.percentile_approx(c, probs, max(ACCURACY, 4 * ranges)) for c in names]).first()
    return [_borders(cuts or []) for cuts in row]


def range_splits(df: DataFrame, value: Column, ranges: int | None = None) -> list[float]:
    return column_splits(df, [value], ranges)[0]


def with_range(df: DataFrame, name: str, splits: Sequence[float], into: str) -> DataFrame:
    """Number of the value range a row falls in (0 .. len(splits)); the column must be double."""
    if not splits:
        return df.withColumn(into, F.lit(0))
    bucketizer = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol=name, outputCol=into,
                            handleInvalid="keep")
    # Not nullable, so that a join on it adds no filter that evaluates it early.
    return bucketizer.transform(df).withColumn(into, F.coalesce(col(into).cast("int"), F.lit(-1)))


def running_total(df: DataFrame, value: str, weight: str, splits: Sequence[float],
                  into: str, total: str | None = None, by: Sequence[str] = (), wanted=None) -> DataFrame:
    """Sum of ``weight`` over all rows of the group up to and including this value.

    ``df`` has one row per (group, value).  Every value range is summed on its
    own; the totals of the ranges before it come from a small table.  With
    ``wanted``, a condition on the weight before, in and of all ranges of the
    group, only the rows of ranges that meet it are sorted and returned.
    """
    by = list(by)
    if not splits:
        # One range: the whole table is small enough for a window per group.
        group = Window.partitionBy(*[col(c) for c in by])
        upto = group.orderBy(col(value)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = df.withColumn(into, F.sum(weight).over(upto))
        return out.withColumn(total, F.sum(weight).over(group)) if total else out
    ranged = with_range(df, value, splits, "_range")
    upto = Window.partitionBy(*[col(c) for c in by]).orderBy("_range")
    offsets = (
        ranged.groupBy(*[col(c) for c in by], "_range").agg(F.sum(weight).alias("_held"))
        .withColumn("_before", F.sum("_held").over(upto) - F.col("_held"))
        .withColumn("_total", F.sum("_held").over(Window.partitionBy(*[col(c) for c in by])))
    )
    if wanted is not None:
        offsets = offsets.where(wanted(F.col("_before"), F.col("_held"), F.col("_total")))
    renamed = offsets.select(*[col(c).alias(f"_k{i}") for i, c in enumerate(by)],
                             F.col("_range").alias("_r"), "_before", "_total")
    match = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        match = match & col(c).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*[col(c) for c in by], "_range").orderBy(col(value)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    out = ranged.join(renamed, match).withColumn(into, F.col("_before") + F.sum(weight).over(within))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_range", "_r", "_before", "_total", *[f"_k{i}" for i in range(len(by))])


def grouped_quantiles(df: DataFrame, by: Sequence[str], value: Column,
                      probs: Mapping[str, float], ranges: int | None = None) -> DataFrame:
    """Exact quantiles per group: one row per group with one column per entry of ``probs``.

    Groups may be of any size; a group larger than a value range is spread
    over several window partitions.
    """
    by = list(by)
    known = df.select(*[col(c) for c in by], value.cast("double").alias("_v")).where("_v is not null")
    splits = range_splits(known, F.col("_v"), ranges)
    cells = known.groupBy(*[col(c) for c in by], "_v").agg(F.count(F.lit(1)).alias("_c"))

    def holds_rank(before: Column, held: Column, n: Column) -> Column:
        hit = F.lit(False)
        for p in probs.values():
            for rank in (F.floor(F.lit(float(p)) * (n - 1)), F.ceil(F.lit(float(p)) * (n - 1))):
                hit = hit | ((rank >= before) & (rank < before + held))
        return hit

    ranked = running_total(cells, "_v", "_c", splits, "_upto", "_n", by, holds_rank)
    picks = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.floor(at), F.ceil(at)
        picks += [
            F.min(F.when(F.col("_upto") > low, F.col("_v"))).alias(f"_{name}_a"),
            F.min(F.when(F.col("_upto") > high, F.col("_v"))).alias(f"_{name}_b"),
        ]
    found = ranked.groupBy(*[col(c) for c in by]).agg(F.max("_n").alias("_n"), *picks)
    outs = []
    for name, p in probs.items():
        at = F.lit(float(p)) * (F.col("_n") - 1)
        a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        outs.append((a + (b - a) * (at - F.floor(at))).alias(name))
    return found.select(*[col(c) for c in by], *outs)


def average_ranks(counts: DataFrame, value: str, weight: str, splits: Sequence[float]) -> DataFrame:
    """``value, rank, total``: the average rank of the rows of each distinct value, from counted rows."""
    distinct = counts.groupBy(col(value).alias("value")).agg(F.sum(weight).alias("w"))
    ranked = running_total(distinct, "value", "w", splits, "upto", "total")
    return ranked.select("value", (F.col("upto") - (F.col("w") - 1) / 2).alias("rank"), "total")
