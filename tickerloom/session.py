"""Session settings, reliable checkpoints and shipping of the package to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession, functions as F

# Adaptive execution chooses broadcast joins from measured sizes and splits
# skewed join partitions, so operators do not hint joins themselves.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# A side is broadcast if it has at most so many rows, and rows times columns' widths stay in so many bytes.
SMALL_ROWS, SMALL_BYTES = 100_000, 32 << 20
_shipped: set[str] = set()


def make_session(app: str = "tickerloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_ready(spark: SparkSession) -> None:
    """Point the context at the shared checkpoint folder named by the session.

    Only a local master may fall back to a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="tickerloom-checkpoint-")
    context.setCheckpointDir(folder)


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and cuts the lineage."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Prepare one side of a join: broadcast it if it has at most max_rows rows and SMALL_BYTES bytes.

    Rows and bytes are measured first (bytes by the length of the rows' JSON form, which is never
    less than a binary row's values by more than a small factor). A larger side is joined without a hint, i.e. by a sort-merge
    join whose skewed partitions adaptive execution splits. Without this check Spark would
    shuffle the large side (whole articles) before it learns that the other one is small.
    """
    kept = durable(df)
    few = kept.limit(max_rows + 1)
    rows, size = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return F.broadcast(kept) if rows <= max_rows and size <= SMALL_BYTES else kept


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other, so that groups with a NULL key are kept."""
    other = right.select(*[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns])
    same = [left[k].eqNullSafe(other[f"__{k}"]) for k in keys]
    return left.join(other, reduce(and_, same), how).drop(*[f"__{k}" for k in keys])


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for heavy text work when the input has fewer splits than cores.

    A large input has more splits than that and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="tickerloom-package-"), "tickerloom.zip")
    with zipfile.ZipFile(archive, "w") as bundle:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    bundle.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
