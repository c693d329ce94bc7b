"""Shared working storage for steps that must not be recomputed."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir`` where the cluster names one.

    Only a local session without that setting (as in tests) gets a temporary
    folder; on a cluster the folder must be named, since a temporary one would
    be another on each machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to reliable storage and go on from there."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have the files of tables that are no longer held removed: their shuffles and what ``settle`` wrote.

    Spark removes them once the driver's garbage collection finds the tables
    gone, and a driver with little garbage may not collect it for a long time.
    """
    spark.sparkContext._jvm.System.gc()


def new_folder(spark: SparkSession, purpose: str) -> str:
    return os.path.join(shared_dir(spark), f"{purpose}-{uuid.uuid4().hex}")


def one_row(df: DataFrame) -> Column:
    """A one-row table (a global aggregate) as a struct column, by scalar subquery."""
    return df.select(F.struct("*")).scalar()


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores where the input has too few files to keep them busy.

    The files are known without a job; a table of at least as many as there are
    cores stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
