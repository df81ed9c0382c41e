"""Classifiers on feature tables: per-fold training, tuning, probabilities per test row.

Input needs `fold` (see folds.py), a 0/1 label and numeric features, or one vector column.
Logistic regressions of all folds and penalties share their scans (logistic_grid.py); other fits are Spark ML jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from tickerloom.functions.vectors import as_doubles
from tickerloom.operators import balance, folds, logistic_grid, neighbours, scaling
from tickerloom.operators.logistic_grid import EVERYTHING, Fit
from tickerloom.operators.rollup import union_tables
from tickerloom.session import durable, small_side

# Strength of the penalty, tolerance of the l1 solver, tuning grid, network sizes, seed.
PENALTY_C, LASSO_TOLERANCE = 1.0, 1e-4
GRID = [(kind, c) for kind, c in product(("l1", "l2"), (0.001, 0.01, 0.1, 1.0))]
HIDDEN, DEEP_HIDDEN = [100], [128, 64]
SEED = 42
PARALLEL_FITS = 8


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def assembled_vector(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(as_doubles(vector)))


def logistic(rows: int, c: float = PENALTY_C, penalty: str = "l2", label: str = "movement") -> LogisticRegression:
    """Penalised logistic regression. C weighs the summed loss, so regParam is 1 / (C n)."""
    lasso = penalty == "l1"
    return LogisticRegression(labelCol=label, regParam=1.0 / (c * rows), elasticNetParam=1.0 if lasso else 0.0,
                              standardization=False, maxIter=100, tol=LASSO_TOLERANCE if lasso else 1e-6)


def boosted_trees(label: str = "movement", rounds: int = 100) -> GBTClassifier:
    return GBTClassifier(labelCol=label, seed=SEED, maxIter=rounds)


def network(inputs: int, hidden: Sequence[int] = tuple(HIDDEN), rounds: int = 200,
            label: str = "movement") -> MultilayerPerceptronClassifier:
    return MultilayerPerceptronClassifier(labelCol=label, layers=[inputs, *hidden, 2], maxIter=rounds, seed=SEED)


def side_by_side(task: Callable, items: Iterable) -> list:
    """Independent fits as concurrent Spark jobs; their short stages fill idle cores."""
    with ThreadPool(PARALLEL_FITS) as pool:
        return pool.map(task, list(items))


def scored(model, test: DataFrame, label: str, keep: Sequence[str]) -> DataFrame:
    """Prediction table: kept columns, y_true, y_prob, y_pred."""
    out = model.transform(test)
    return out.select(*keep, F.col(label).alias("y_true"), F.get(vector_to_array("probability"), F.lit(1)).alias("y_prob"),
                      F.col("prediction").cast("int").alias("y_pred"))


def folds_scored(df: DataFrame, features: Sequence[str], label: str, k: int, keep: Sequence[str],
                 estimator: Callable[[int], object] | None = None, resample: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Train on all rows before each fold, score the rows of the fold.

    The feature table is checkpointed once, since every fold reads it, and so are the
    scored rows, since reports read them several times. Scaling is fitted on the
    (resampled) training rows. Without an estimator it is a logistic regression, and all folds are fitted in the same
    scans (see logistic_grid.py) unless they are resampled.
    """
    table = durable(df)
    if estimator is None and resample is None:
        fits = logistic_grid.fit_grid(table, features, label, [Fit(f, "l2", PENALTY_C) for f in range(1, k + 1)])
        return durable(logistic_grid.scored(table, fits, features, label, keep))
    make = estimator or (lambda n: logistic(n, label=label))

    def one(f: int) -> DataFrame:
        train, test = folds.train_rows(table, f), folds.test_rows(table, f)
        if resample is not None:
            train = durable(resample(train))
        ready = assembled(scaling.scale(train, features), features).select("features", label).cache()
        model = make(ready.count()).fit(ready)
        ready.unpersist()
        return scored(model, assembled(scaling.scale(test, features, train), features), label, keep)

    return durable(union_tables(side_by_side(one, range(1, k + 1))))


def vector_folds_scored(df: DataFrame, kinds: DataFrame, vector: str, label: str, k: int, keep: Sequence[str],
                        key: str = "vector_id") -> DataFrame:
    """The same for ready vectors (market vectors), without scaling.

    kinds has one vector for each `key`. Rows of one vector, label and fold enter the fits as one row that weighs as
    many, and each vector is scored once, so rows never carry their vectors.
    """
    table = durable(df.select(*{*keep, key, label, "fold"}))
    vectors = small_side(kinds.select(key, vector))
    counts = table.groupBy(key, label, "fold").agg(F.count(F.lit(1)).alias("_n"))
    weighted = durable(assembled_vector(counts.join(vectors, key), vector).select("features", label, "fold", "_n"))

    def one(f: int) -> DataFrame:
        train = folds.train_rows(weighted, f)
        rows = train.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        model = logistic(rows, label=label).setWeightCol("_n").fit(train)
        known = scored(model, assembled_vector(vectors, vector).withColumn(label, F.lit(None).cast("int")), label, [key])
        rows = folds.test_rows(table, f).withColumnRenamed(label, "y_true").join(small_side(known.drop("y_true")), key)
        return rows.select(*keep, "y_true", "y_prob", "y_pred")

    return durable(union_tables(side_by_side(one, range(1, k + 1))))


def grid_search(train: DataFrame, features: Sequence[str], label: str, date_order: str, extra: DataFrame | None = None,
                k: int = folds.TUNING_FOLDS, grid: Sequence[tuple[str, float]] = tuple(GRID)) -> tuple[Fit, DataFrame]:
    """The best penalty by mean F1 over expanding inner folds, fitted on all rows, and the table of all scores.

    train: real rows with scaled features, in order of the integer column `date_order`. extra:
    synthetic rows, which join every inner training part but are never validated on. All fits of the grid
    and all folds share every scan of the rows; one more scan validates all of them.
    """
    inner = folds.with_size(train, []).withColumn("fold", folds.fold_of(F.col(date_order), F.col("_size"), k))
    rows = inner.select(*features, label, "fold", F.lit(True).alias("real"))
    if extra is not None:
        rows = rows.unionByName(extra.select(*features, label, F.lit(None).cast("int").alias("fold"), F.lit(False).alias("real")))
    rows = durable(rows)
    wanted = [Fit(f, penalty, c) for f in range(1, k + 1) for penalty, c in grid]
    fits = logistic_grid.fit_grid(rows, features, label, wanted, scale=False)
    f1 = logistic_grid.validated(rows, fits, features, label, real="real")
    tried = [(f.penalty, f.c, f.fold, v) for f, v in zip(fits, f1, strict=True)]
    scores = train.sparkSession.createDataFrame(tried, "penalty string, c double, fold int, f1 double")
    mean = {g: sum(t[3] for t in tried if t[:2] == g) / k for g in grid}
    penalty, c = max(grid, key=lambda g: mean[g])
    (best,) = logistic_grid.fit_grid(rows, features, label, [Fit(EVERYTHING, penalty, c)], scale=False)
    return best, scores


def tuned_folds_scored(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str], id_col: str,
                       k: int = folds.TUNING_FOLDS) -> tuple[DataFrame, DataFrame]:
    """Per outer fold: scale, oversample the smaller classes, tune, score the fold."""
    table = durable(df)

    def one(f: int) -> tuple[DataFrame, DataFrame]:
        train, test = folds.train_rows(table, f), folds.test_rows(table, f)
        real = durable(scaling.scale(train, features).select(*features, label, id_col))
        extra = neighbours.smote(real, features, label, id_col).select(*features, label)
        model, grid = grid_search(real, features, label, id_col, extra)
        out = logistic_grid.scored(scaling.scale(test, features, train), [model], features, label, keep)
        return out, grid.withColumn("outer_fold", F.lit(f))

    parts, grids = zip(*side_by_side(one, range(1, k + 1)))
    return durable(union_tables(parts)), union_tables(grids)


def undersampled(label: str, id_col: str) -> Callable[[DataFrame], DataFrame]:
    return lambda train: balance.undersample(train, label, id_col)


