"""Column choice, row filters and missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

INDEX_COLUMN = "Unnamed: 0"


def drop_index_col(df: DataFrame) -> DataFrame:
    """Drop the unnamed row number that spreadsheet exports add."""
    return df.drop(INDEX_COLUMN)


def drop_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(names)


def filter_ticker(df: DataFrame, ticker: str, c: str = "ticker") -> DataFrame:
    return df.where(F.col(c) == ticker)


def clip_dates(df: DataFrame, start: str, end: str, c: str = "dt") -> DataFrame:
    """Rows with start <= date < end."""
    return df.where((F.col(c) >= F.lit(start).cast("date")) & (F.col(c) < F.lit(end).cast("date")))


def non_empty_text(df: DataFrame, c: str) -> DataFrame:
    return df.where(F.col(c).isNotNull() & (F.col(c) != ""))


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(how="any", subset=list(subset) if subset else None)


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def null_profile(df: DataFrame) -> DataFrame:
    """Number of NULLs per column, from one pass."""
    row = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in df.columns])
    return row.unpivot([], df.columns, "column_name", "nulls")


def regime(df: DataFrame, level: str, c: str = "volatility_level") -> DataFrame:
    return df.where(F.col(c) == level)


def sort_by(df: DataFrame, cols: Sequence[str], ascending: bool = True) -> DataFrame:
    return df.orderBy(*cols, ascending=ascending)


def first_rows(df: DataFrame, cols: Sequence[str], n: int, ascending: bool = True) -> DataFrame:
    return df.orderBy(*cols, ascending=ascending).limit(n)
