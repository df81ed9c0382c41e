"""Class balancing and stratified hold-outs with exact class sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from tickerloom.functions.numbers import hash_order
from tickerloom.operators.ordering import take_by_hash


def stratified_split(df: DataFrame, share: float, label: str, id_col: str, seed: int = 0) -> DataFrame:
    """Add `part`: ceil(share * n) test rows, spread over the classes by largest remainder."""
    def quotas(sizes: DataFrame) -> DataFrame:
        # One row per class.
        all_classes = Window.partitionBy()
        test_rows = F.ceil(F.lit(float(share)) * F.sum("n").over(all_classes))
        wish = F.col("n") * test_rows / F.sum("n").over(all_classes)
        planned = sizes.withColumns({"_wish": wish, "_rows": test_rows}).withColumn("quota", F.floor("_wish"))
        by_rest = all_classes.orderBy(F.desc(F.round(F.col("_wish") - F.col("quota"), 9)), label)
        missing = F.col("_rows") - F.sum("quota").over(all_classes)
        return planned.withColumn("quota", F.col("quota") + (F.row_number().over(by_rest) <= missing).cast("int"))

    marked = take_by_hash(df, [label], quotas, id_col, seed)
    return marked.withColumn("part", F.when(F.col("picked"), "test").otherwise("train")).drop("picked")


def undersample(df: DataFrame, label: str, id_col: str, by: Sequence[str] = (), seed: int = 0) -> DataFrame:
    """Keep as many rows of every class as the smallest class has (per group of `by`)."""
    by = list(by)

    def quotas(sizes: DataFrame) -> DataFrame:
        return sizes.withColumn("quota", F.min("n").over(Window.partitionBy(*by)))
    return take_by_hash(df, by + [label], quotas, id_col, seed).where("picked").drop("picked")


def balance_report(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def shuffle_rows(df: DataFrame, id_col: str, seed: int = 0) -> DataFrame:
    """All rows in a repeatable pseudo-random order (a range-partitioned sort)."""
    return df.orderBy(hash_order(id_col, seed), id_col)
