"""Equal-width bins: edges known to the driver, bin numbers as native expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.quantiles import quantiles


@dataclass(frozen=True)
class Bins:
    """``n`` bins from ``lo`` to ``hi``; ``padded`` if they were made around a single value."""

    lo: float
    hi: float
    n: int
    padded: bool = False

    @property
    def width(self) -> float:
        return (self.hi - self.lo) / self.n

    def edge(self, i: int) -> float:
        return self.hi if i == self.n else self.lo + i * self.width

    @property
    def _type(self) -> str:
        return "int" if self.n < 1 << 31 else "long"

    @property
    def edges(self) -> list[float]:
        return [self.edge(i) for i in range(self.n + 1)]

    def midpoint(self, i: int) -> float:
        return 0.5 * (self.edge(i) + self.edge(i + 1))

    def _clamped(self, c: Column) -> Column:
        # greatest/least skip NULL, so a missing value has to be kept apart.
        return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(0)), F.lit(self.n - 1)).cast(self._type))

    def _edge_of(self, i: Column) -> Column:
        return F.lit(self.lo) + i * F.lit(self.width)

    def left_closed(self, x: Column) -> Column:
        """Bin number with bins [lo, hi), the last one closed; NULL stays NULL."""
        if self.width == 0:
            return F.when(x.isNotNull(), F.lit(self.n - 1))
        guess = self._clamped(F.floor((x - F.lit(self.lo)) / F.lit(self.width)))
        # The quotient can land one bin off next to an edge; the edges decide.
        moved = F.when(x < self._edge_of(guess), guess - 1).when(
            x >= self._edge_of(guess + 1), guess + 1).otherwise(guess)
        return self._clamped(moved)

    def right_closed(self, x: Column) -> Column:
        """Bin number with bins (lo, hi], the first one closed; NULL stays NULL."""
        guess = self._clamped(F.ceil((x - F.lit(self.lo)) / F.lit(self.width)) - 1)
        moved = F.when(x <= self._edge_of(guess), guess - 1).when(
            x > self._edge_of(guess + 1), guess + 1).otherwise(guess)
        return self._clamped(moved)

    def table(self, spark) -> DataFrame:
        """``bin, lo, hi, mid`` for every bin, made in the tasks: the data may ask for any number of bins."""
        i = F.col("id")
        hi = F.when(i == self.n - 1, F.lit(float(self.hi))).otherwise(self._edge_of(i + 1)).alias("hi")
        edges = spark.range(self.n).select(i.cast(self._type).alias("bin"), self._edge_of(i).cast("double").alias("lo"), hi)
        return edges.withColumn("mid", 0.5 * (F.col("lo") + F.col("hi")))


def value_ranges(df: DataFrame, values: list[Column]) -> list[tuple[float, float] | None]:
    """Smallest and largest value of each expression in one aggregate."""
    aggs = []
    for i, v in enumerate(values):
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}")]
    row = df.agg(*aggs).first()
    return [None if row[f"lo{i}"] is None else (row[f"lo{i}"], row[f"hi{i}"]) for i in range(len(values))]


def histogram_bins(span: tuple[float, float], n: int) -> Bins:
    """Bins over the value range; a constant column gets one unit around it."""
    lo, hi = span
    return Bins(lo - 0.5, hi + 0.5, n) if lo == hi else Bins(lo, hi, n)


def auto_bins(df: DataFrame, value: Column, whole_numbers: bool = False) -> Bins | None:
    """Bin count from the data: the finer of the Sturges and Freedman-Diaconis widths."""
    row = df.agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    if not row["n"]:
        return None
    n, lo, hi = row["n"], row["lo"], row["hi"]
    if lo == hi:
        return histogram_bins((lo, hi), 1)
    q1, q3 = quantiles(df, {"x": value}, [0.25, 0.75])["x"]
    sturges = (hi - lo) / (math.log2(n) + 1)
    freedman = 2 * (q3 - q1) / n ** (1 / 3)
    width = min(sturges, freedman) if freedman > 0 else sturges
    if whole_numbers:
        width = max(width, 1.0)
    return Bins(lo, hi, max(1, math.ceil((hi - lo) / width)))
