"""Expanding folds and chronological splits.

A fold number on each row stands for all k splits: fold f tests on its own rows and trains
on all rows before, i.e. on `fold is null or fold < f`. Nothing is copied per fold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.operators.ordering import row_index
from tickerloom.session import join_on, small_side

# Number of folds in evaluation and in tuning, share of training rows.
FOLDS, TUNING_FOLDS = 5, 3
TRAIN_SHARE = 0.8


def group_size(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))


def with_size(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Number of rows of the table (a scalar subquery) or of the group (a join)."""
    if not by:
        return df.withColumn("_size", df.agg(F.count(F.lit(1))).scalar())
    return join_on(df, small_side(group_size(df, by)), list(by))


def fold_of(index: Column, size: Column, k: int) -> Column:
    """Test fold of a row: size div (k+1) rows each, counted from the end; NULL before."""
    part = F.floor(F.try_divide(size, F.lit(k + 1)))
    first = size - k * part
    return F.when(index >= first, F.floor(F.try_divide(index - first, part)).cast("int") + 1)


def time_series_folds(df: DataFrame, k: int, date_col: str, seq_col: str | None = None, by: Sequence[str] = (),
                      unit: str = "row") -> DataFrame:
    """Add `row_id` and `fold`. unit="date" keeps the rows of a date in one fold."""
    by = list(by)
    if unit == "date":
        days = df.select(*by, date_col).distinct()
        days = time_series_folds(days, k, date_col, None, by)
        return join_on(df, small_side(days), by + [date_col])
    indexed = with_size(row_index(df, date_col, seq_col, by), by)
    return indexed.withColumn("fold", fold_of(F.col("row_id"), F.col("_size"), k)).drop("_size")


def fold_bounds(df: DataFrame, k: int, date_col: str, by: Sequence[str] = ()) -> DataFrame:
    """First and last date and size of each training and test part.

    Statistics per block are merged over the at most k blocks before a fold.
    """
    by = list(by)
    blocks = df.groupBy(*by, F.coalesce("fold", F.lit(0)).alias("fold")).agg(
        F.min(date_col).alias("test_start"), F.max(date_col).alias("test_end"), F.count(F.lit(1)).alias("test_rows"))
    before = Window.partitionBy(*by).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(
        *by, "fold", F.min("test_start").over(before).alias("train_start"),
        F.max("test_end").over(before).alias("train_end"), F.sum("test_rows").over(before).alias("train_rows"),
        "test_start", "test_end", "test_rows").where(F.col("fold") > 0)


def chrono_split(df: DataFrame, share: float, date_col: str, seq_col: str | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Add `part`: the first int(share * n) rows in time order are train."""
    indexed = with_size(row_index(df, date_col, seq_col, by), by)
    cut = F.floor(F.lit(float(share)) * F.col("_size"))
    return indexed.withColumn("part", F.when(F.col("row_id") < cut, "train").otherwise("test")).drop("_size")


def train_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.coalesce("fold", F.lit(0)) < fold)


def test_rows(df: DataFrame, fold: int) -> DataFrame:
    return df.where(F.col("fold") == fold)
