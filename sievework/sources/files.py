"""Reading and writing files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _checked(df_of, what: str, path: str) -> DataFrame:
    try:
        df = df_of()
        df.schema
        return df
    except PySparkException as exc:
        raise ValueError(f"Could not load {what} '{path}': {exc}") from exc


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with a header; types are inferred unless a schema is given (cheaper on large data)."""
    reader = spark.read.options(**{"header": True, "inferSchema": schema is None, **options})
    return _checked(lambda: (reader.schema(schema) if schema else reader).csv(path), "CSV", path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              lines: bool = False, **options) -> DataFrame:
    """JSON array of records per file, or one record per line (splittable) with ``lines``."""
    reader = spark.read.options(**{"multiLine": not lines, **options})
    return _checked(lambda: (reader.schema(schema) if schema else reader).json(path), "JSON", path)


def read_table(spark: SparkSession, path: str, **options) -> DataFrame:
    """Choose the reader by file suffix."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    readers = {
        ".csv": lambda: read_csv(spark, path, **options),
        ".json": lambda: read_json(spark, path, **options),
        ".jsonl": lambda: read_json(spark, path, lines=True, **options),
        ".parquet": lambda: _checked(lambda: spark.read.options(**options).parquet(path), "Parquet", path),
        ".orc": lambda: _checked(lambda: spark.read.options(**options).orc(path), "ORC", path),
    }
    if suffix not in readers:
        raise ValueError(f"Unsupported file type: '{suffix}'. Use one of {', '.join(readers)}")
    return readers[suffix]()


# The header marker of an exported event sheet and its columns.
HEADER_MARK = "ab_version"
SHEET_COLUMNS = ("event", "not_set", "A", "B", "total")


def read_event_sheet(spark: SparkSession, path: str) -> DataFrame:
    """Event count sheet exported to one CSV file without a header.

    The first row with a cell ``ab_version`` is the header; the row after it
    is skipped too.  Rows are ordered by the position of their file block and
    then within it, so it does not matter how the file is split.
    """
    # Separators within quotes only make for empty columns at the end.
    widest = spark.read.text(path).agg(F.max(F.size(F.split("value", ",")))).first()[0] or 0
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(max(widest, len(SHEET_COLUMNS)))])
    raw = spark.read.schema(schema).csv(path, header=False)
    rows = raw.select("*", F.struct(
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("_at"))
    marked = F.lit(False)
    for name in schema.names:
        marked = marked | F.coalesce(F.col(name) == HEADER_MARK, F.lit(False))
    header = rows.where(marked).agg(F.min("_at")).first()[0]
    if header is None:
        raise ValueError(f"Could not find a header row containing '{HEADER_MARK}'")

    def later(than) -> Column:
        block, at = F.col("_at.block"), F.col("_at.at")
        return (block > than["block"]) | ((block == than["block"]) & (at > than["at"]))

    skipped = rows.where(later(header)).agg(F.min("_at")).first()[0]
    data = rows.where(later(skipped)) if skipped else rows.where(F.lit(False))
    return data.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(SHEET_COLUMNS)])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    """CSV with a header, one file per partition."""
    df.write.mode(mode).options(**{"header": True, **options}).csv(path)
