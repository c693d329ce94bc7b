"""Quantile sketches as stored state: of bounded size, mergeable over versions and batches.

A table of sketches has one row per group and column: ``column, n, sketch``
(and the group's columns).  Sketches of parts of a table merge to one of the
whole, so a new version or a stream batch costs a reading of its own rows only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.schema import as_number, col, require_numeric

#: Size of a sketch; the rank of a returned quantile is off by some 2.3 / SIZE^0.9 of the rows.
SIZE = 2000
#: Bound of that error for ``SIZE`` which all but a few in a thousand sketches keep, doubled for merges.
RANK_ERROR = 0.005


def sketch(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """``by, column, n, sketch`` of numeric columns, all in one aggregation; missing values are left out."""
    require_numeric(df, cols)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(as_number(c)).alias(f"_n{i}"), F.kll_sketch_agg_double(as_number(c).cast("double"), F.lit(size)).alias(f"_s{i}")]
    rows = df.groupBy(*[col(c) for c in by]).agg(*aggs)
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("n"), F.col(f"_s{i}").alias("sketch")) for i, c in enumerate(cols)]
    return rows.select(*[col(c) for c in by], F.inline(F.array(*entries)))


def merge(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, column, n, sketch``: the sketches of each column (and group) as one."""
    return sketches.where("n > 0").groupBy(*[col(c) for c in by], "column").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantiles(sketches: DataFrame, probs: Sequence[float]) -> DataFrame:
    """The table with one row per probability: ``p, value`` instead of the sketch; groups without values have none."""
    asked = F.array(*[F.lit(float(p)) for p in probs])
    rest = [c for c in sketches.columns if c != "sketch"]
    found = F.arrays_zip(asked.alias("p"), F.kll_sketch_get_quantile_double("sketch", asked).alias("value"))
    return sketches.where("n > 0").select(*[col(c) for c in rest], F.inline(found).alias("p", "value"))


def approximate(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Approximate quantiles of several columns from one reading: column -> values, None without values."""
    found: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    # One row for each column and probability.
    for row in quantiles(sketch(df, cols), probs).collect():
        for i, p in enumerate(probs):
            if p == row["p"]:
                found[row["column"]][i] = row["value"]
    return found


def keep(stream: DataFrame, cols: Sequence[str], folder: str, checkpoint: str, available_now: bool = False):
    """Start a query that stores one table of sketches per batch of a stream under ``folder``.

    A batch that is run again after a failure replaces its own sketches.
    """
    def store(batch: DataFrame, number: int) -> None:
        sketch(batch, cols).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def union(tables: Sequence[DataFrame]) -> DataFrame:
    """Sketches of several versions in one table, to be merged."""
    return reduce(DataFrame.unionByName, tables)
