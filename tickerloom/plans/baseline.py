"""Numbers and sentiment: from bars and scored articles to a fold report."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from tickerloom.operators import folds, joins, metrics, models, windows
from tickerloom.operators.rollup import union_tables
from tickerloom.session import durable

LABEL = "movement"
KEEP = ["dt", "fold", "ret"]


def feature_table(bars: DataFrame, news: DataFrame | None = None, k: int = folds.FOLDS) -> DataFrame:
    """One row per date with features, label, return, row number and fold."""
    df = bars if news is None else joins.join_pre_aggregated(bars, news)
    df = windows.baseline_features(df, [], ["dt"], sentiment=news is not None)
    return folds.time_series_folds(df, k, "dt").withColumn("ret", F.col("daily_return"))


def features_of(news: DataFrame | None) -> Sequence[str]:
    return windows.BASE_FEATURES if news is None else windows.SENTIMENT_FEATURES


def evaluate(bars: DataFrame, news: DataFrame | None = None, balanced: bool = False, k: int = folds.FOLDS,
             estimator: Callable[[int], object] | None = None) -> DataFrame:
    """A classifier (logistic regression by default) over expanding folds; classification metrics averaged over folds."""
    table = feature_table(bars, news, k)
    resample = models.undersampled(LABEL, "row_id") if balanced else None
    scored = models.folds_scored(table, features_of(news), LABEL, k, KEEP, estimator, resample)
    return metrics.fold_report(scored, overall="fold_mean", auc="score")


def each_scored(bars: DataFrame, values: Sequence[str], by: str = "ticker", news: DataFrame | None = None, k: int = folds.FOLDS,
                estimator: Callable[[int], object] | None = None) -> DataFrame:
    """Scored rows of expanding folds of each named series by itself; `by` keeps the series.

    Each series has models of its own. Features are made for all series at once.
    """
    df = bars if news is None else joins.join_pre_aggregated(bars, news, [by, "dt"])
    df = windows.baseline_features(df, [by], ["dt"], sentiment=news is not None)
    table = durable(folds.time_series_folds(df, k, "dt", by=[by]).withColumn("ret", F.col("daily_return")))
    parts = [models.folds_scored(table.where(F.col(by) == v), features_of(news), LABEL, k, [by, *KEEP], estimator) for v in values]
    return union_tables(parts)


def evaluate_each(bars: DataFrame, values: Sequence[str], by: str = "ticker", news: DataFrame | None = None) -> DataFrame:
    """Fold report of each named series."""
    scored = durable(each_scored(bars, values, by, news))
    return union_tables([metrics.fold_report(scored.where(F.col(by) == v), overall="fold_mean", auc="score").withColumn(by, F.lit(v))
                         for v in values])


def evaluate_tuned(bars: DataFrame, news: DataFrame | None = None) -> DataFrame:
    table = feature_table(bars, news, folds.TUNING_FOLDS)
    scored, _ = models.tuned_folds_scored(table, features_of(news), LABEL, KEEP, "row_id")
    return metrics.fold_report(scored, overall="fold_mean", auc="score")
