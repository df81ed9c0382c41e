"""Standard scaling with population deviation, fitted on training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def moments(df: DataFrame, cols: Sequence[str], seen: Column | None = None) -> Column:
    """A struct of means and deviations of the rows where `seen` holds."""
    def value(c: str) -> Column:
        x = F.col(c).cast("double")
        return x if seen is None else F.when(seen, x)
    return F.struct(*[F.avg(value(c)).alias(f"{c}_mean") for c in cols],
                    *[F.stddev_pop(value(c)).alias(f"{c}_std") for c in cols])


def standardise(df: DataFrame, cols: Sequence[str], stats: str) -> DataFrame:
    """(x - mean) / std with the struct column `stats`; constant columns become 0."""
    def scaled(c: str) -> Column:
        std, centred = F.col(f"{stats}.{c}_std"), F.col(c).cast("double") - F.col(f"{stats}.{c}_mean")
        return F.when(std == 0, F.lit(0.0)).otherwise(F.try_divide(centred, std))
    return df.withColumns({c: scaled(c) for c in cols})


def scale(df: DataFrame, cols: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    """Scale all rows with statistics of `fit_on` (the training rows), or of all rows."""
    stats = (df if fit_on is None else fit_on).agg(moments(df, cols).alias("_s")).scalar()
    return standardise(df.withColumn("_s", stats), cols, "_s").drop("_s")


def scale_test_folds(df: DataFrame, cols: Sequence[str], k: int, fold: str = "fold") -> DataFrame:
    """Scale the test rows of each fold with statistics of the rows before it.

    One pass gathers the statistics of all k expanding training parts.
    """
    block = F.coalesce(fold, F.lit(0))
    row = df.agg(*[moments(df, cols, block < f).alias(f"f{f}") for f in range(1, k + 1)])
    stats = row.select(F.array(*[F.col(f"f{f}") for f in range(1, k + 1)])).scalar()
    tests = df.where(F.col(fold) >= 1).withColumn("_all", stats)
    tests = tests.withColumn("_s", F.get("_all", F.col(fold) - 1))
    return standardise(tests, cols, "_s").drop("_s", "_all")
