"""Fitted constants as a table, so that a stream or a later run can apply them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "column string, name string, value double"


def fit_table(spark: SparkSession, fitted: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """``column, name, value`` rows of fitted constants."""
    return spark.createDataFrame(
        [(c, name, float(v)) for c, values in fitted.items() for name, v in values.items()], SCHEMA)


def read_fit(table: DataFrame) -> dict[str, dict[str, float]]:
    """The constants back as ``column -> name -> value`` (one row per constant)."""
    out: dict[str, dict[str, float]] = {}
    for row in table.select("column", "name", "value").collect():
        out.setdefault(row["column"], {})[row["name"]] = row["value"]
    return out


def store(spark: SparkSession, folder: str, version: int, fitted: Mapping[str, Mapping[str, float]]) -> None:
    """Write the constants as one version of the fit; the same version again replaces it."""
    fit_table(spark, fitted).coalesce(1).write.mode("overwrite").parquet(f"{folder}/version={version}")


def newest(spark: SparkSession, folder: str) -> dict[str, dict[str, float]]:
    """The constants of the highest version stored."""
    stored = spark.read.schema(SCHEMA + ", version long").parquet(folder)
    return read_fit(stored.where(F.col("version") == stored.agg(F.max("version")).first()[0]))


def keep_applied(stream: DataFrame, folder: str, apply: Callable[[DataFrame, dict], DataFrame], target: str,
                 checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Start a query that writes ``apply(batch, constants)`` of each batch under ``target``.

    Each batch reads the newest version of the fit, so a fit made again
    meanwhile is used without a restart.  A batch that is run again after a
    failure replaces its own rows.
    """
    def write(batch: DataFrame, number: int) -> None:
        apply(batch, newest(batch.sparkSession, folder)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
