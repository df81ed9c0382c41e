"""Sinks. Every task writes its own files; nothing is gathered first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickerloom.functions.dates import iso_stamp


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Parquet by default; csv is quoted so that texts over several lines survive."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def prediction_records(df: DataFrame) -> DataFrame:
    """A prediction table under the stored names."""
    return df.select(iso_stamp(F.col("dt").cast("timestamp")).alias("Date"), F.col("fold").alias("Fold"),
                     F.col("ret").alias("Daily_Return"), F.col("daily_return_lag1").alias("Daily_Return_lag1"),
                     F.col("y_true").alias("Ground_Truth"), F.col("y_pred").alias("Model_Prediction"))


def write_predictions(df: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON line per scored date, in one folder per fold."""
    prediction_records(df).withColumn("part_fold", F.col("Fold")).write.mode(mode).partitionBy("part_fold").json(path)


def write_correlations(matrix: DataFrame, path: str, mode: str = "error") -> None:
    write_table(matrix, path, "csv", mode=mode)
