"""Column type rules and checks that only look at the schema."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING_LABEL = "<<MISSING>>"


def quoted(name: str) -> str:
    """Column name as it has to be written in an expression."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_floating(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.FloatType, T.DoubleType))


def is_categorical(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.CharType, T.VarcharType, T.BooleanType))


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    absent = [n for n in names if n not in df.columns]
    if absent:
        raise ValueError(f"Invalid column(s): {absent}")


def require_numeric(df: DataFrame, names: Sequence[str]) -> None:
    require_columns(df, names)
    bad = [n for n in names if not is_numeric(type_of(df, n))]
    if bad:
        raise ValueError(f"Column(s) {bad} must be numeric")


def require_categorical(df: DataFrame, names: Sequence[str]) -> None:
    require_columns(df, names)
    bad = [n for n in names if not is_categorical(type_of(df, n))]
    if bad:
        raise ValueError(f"Column(s) {bad} must be categorical-like")


def as_number(name: str) -> Column:
    """The column as double with NaN turned into NULL, so aggregates skip it."""
    return F.nanvl(col(name).cast("double"), F.lit(None).cast("double"))


def is_missing(df: DataFrame, name: str) -> Column:
    """True for NULL, and for NaN in floating point columns; never NULL itself."""
    c = col(name)
    if is_floating(type_of(df, name)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """One notion of missing for the whole table."""
    fixes = {
        f.name: F.nanvl(col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema
        if is_floating(f.dataType)
    }
    return df.withColumns(fixes) if fixes else df


def column_types(df: DataFrame) -> DataFrame:
    """One row per column: name, type, and how the operators treat it (no job on the data)."""
    rows = [
        (f.name, f.dataType.simpleString(), is_numeric(f.dataType), is_categorical(f.dataType))
        for f in df.schema
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, dtype string, is_numeric boolean, is_categorical boolean"
    )


def standardize_names(df: DataFrame) -> DataFrame:
    """Column names stripped and in lower case."""
    return df.toDF(*[c.strip().lower() for c in df.columns])
