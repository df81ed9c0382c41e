"""Classification and trading metrics, per fold and overall."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.functions.numbers import ratio
from tickerloom.operators.ordering import cut_by_value, sum_before

# Trading days in a year, threshold below which losses or deviation count as zero.
TRADING_DAYS = 252
NEARLY_ZERO = 1e-10
CLASS_COLUMNS = ["accuracy", "precision", "recall", "f1", "roc_auc", "mcc"]
TRADE_COLUMNS = ["win_rate", "profit_factor", "sharpe"]


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def confusion_counts(y_true: str = "y_true", y_pred: str = "y_pred") -> dict[str, Column]:
    def hits(t: int, p: int) -> Column:
        return F.count(F.when((F.col(y_true) == t) & (F.col(y_pred) == p), 1))
    return {"tp": hits(1, 1), "fp": hits(0, 1), "tn": hits(0, 0), "fn": hits(1, 0)}


def confusion(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in confusion_counts(y_true, y_pred).items()])


def class_metric_columns() -> dict[str, Column]:
    """Metrics from tp, fp, tn, fn; undefined ratios are 0. roc_auc is that of hard labels."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    precision, recall = or_zero(ratio(tp, tp + fp)), or_zero(ratio(tp, tp + fn))
    product = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return {
        "accuracy": ratio(tp + tn, tp + fp + tn + fn), "precision": precision, "recall": recall,
        "f1": or_zero(ratio(2 * tp, 2 * tp + fp + fn)),
        "roc_auc": (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2,
        "mcc": or_zero(ratio(tp * tn - fp * fn, product)),
    }


def class_metrics(counts: DataFrame) -> DataFrame:
    return counts.withColumns(class_metric_columns())


def roc_auc(df: DataFrame, by: Sequence[str] = (), y_true: str = "y_true", score: str = "y_prob") -> DataFrame:
    """Tie-aware area under the ROC curve; NULL when one class is missing.

    Rows are counted per distinct score, scores are ranked inside buckets of neighbouring
    scores, and buckets are ranked among themselves, so one large fold uses many tasks.
    """
    by = list(by)
    cut = cut_by_value(df.select(*by, y_true, score), score)
    per_score = cut.groupBy(*by, "_bucket", score).agg(
        F.count(F.when(F.col(y_true) == 1, 1)).alias("pos"), F.count(F.when(F.col(y_true) == 0, 1)).alias("neg"))
    inside = F.col("pos").cast("double") * (sum_before("neg", by + ["_bucket"], [score]) + F.col("neg") / 2.0)
    buckets = per_score.withColumn("_wins", inside).groupBy(*by, "_bucket").agg(
        F.sum("_wins").alias("_wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    before = F.col("pos").cast("double") * sum_before("neg", by, ["_bucket"])
    ranked = buckets.withColumn("_wins", F.col("_wins") + before)
    area = ratio(F.sum("_wins"), F.sum("pos") * F.sum("neg").cast("double"))
    return ranked.groupBy(*by).agg(area.alias("roc_auc"))


def strategy_returns(df: DataFrame, position: str = "y_pred", ret: str = "ret") -> DataFrame:
    """Long-only: the day's return when the prediction is up, else 0."""
    return df.withColumn("strategy_return", F.col(position) * F.col(ret))


def trade_metric_columns(r: str = "strategy_return") -> dict[str, Column]:
    x = F.col(r)
    gains, losses = F.sum(F.when(x > 0, x).otherwise(0.0)), F.abs(F.sum(F.when(x < 0, x).otherwise(0.0)))
    deviation = F.stddev_pop(x)
    return {
        "win_rate": F.avg(F.when(x > 0, 1.0).otherwise(0.0)),
        "profit_factor": F.when(losses > NEARLY_ZERO, ratio(gains, losses)),
        "sharpe": F.when(deviation > NEARLY_ZERO, ratio(F.avg(x), deviation) * F.sqrt(F.lit(float(TRADING_DAYS))))
        .otherwise(0.0),
    }


def trading_metrics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in trade_metric_columns().items()])


def fold_report(df: DataFrame, overall: str = "pooled", auc: str = "label", fold: str = "fold") -> DataFrame:
    """All metrics per fold and one overall row (fold NULL).

    overall="pooled" scores all test rows together; "fold_mean" averages the
    classification metrics of the folds. Trading metrics are pooled in both. Counts are
    taken per (fold, overall) grouping set in one pass.
    """
    rows = strategy_returns(df.where(F.col(fold).isNotNull()))
    # Grouping sets cost one shuffle: each row is counted for its fold and for the total.
    sums = rows.rollup(fold).agg(
        *[c.alias(n) for n, c in confusion_counts().items()], *[c.alias(n) for n, c in trade_metric_columns().items()])
    report = class_metrics(sums).select(fold, *CLASS_COLUMNS, *TRADE_COLUMNS)
    if auc == "score":
        # Each row counts for its fold and for the total; counts per score combine map-side.
        both = rows.withColumn(fold, F.explode(F.array(F.col(fold), F.lit(None))))
        areas = roc_auc(both, [fold]).withColumnRenamed(fold, "_f")
        report = report.drop("roc_auc").join(areas, F.col(fold).eqNullSafe(F.col("_f")), "left")
        report = report.select(fold, *CLASS_COLUMNS, *TRADE_COLUMNS)
    if overall == "pooled":
        return report
    folds = report.where(F.col(fold).isNotNull())
    means = folds.agg(F.struct(*[F.avg(c).alias(c) for c in CLASS_COLUMNS])).scalar()
    total = report.where(F.col(fold).isNull()).withColumn("_m", means)
    total = total.select(fold, *[F.col(f"_m.{c}").alias(c) for c in CLASS_COLUMNS], *TRADE_COLUMNS)
    return folds.unionByName(total)


def fold_metric_mean(report: DataFrame, cols: Sequence[str] = CLASS_COLUMNS, fold: str = "fold") -> DataFrame:
    """Mean and population deviation over the folds of a report."""
    folds = report.where(F.col(fold).isNotNull()).unpivot([fold], list(cols), "metric", "value")
    return folds.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def weighted_prf(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 over any number of classes."""
    cells = df.groupBy(y_true, y_pred).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(y_true) == F.col(y_pred), F.col("n")).otherwise(0)
    by_true = cells.groupBy(F.col(y_true).alias("c")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = cells.groupBy(F.col(y_pred).alias("c")).agg(F.sum("n").alias("predicted"))
    both = by_true.join(by_pred, "c", "left")
    precision = or_zero(ratio(F.col("tp"), F.col("predicted")))
    recall = ratio(F.col("tp"), F.col("support"))
    f1 = or_zero(ratio(2.0 * F.col("tp"), F.coalesce("predicted", F.lit(0)) + F.col("support")))

    def weighted(c: Column) -> Column:
        return ratio(F.sum(c * F.col("support")), F.sum("support"))
    return both.agg(ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), weighted(precision).alias("precision"),
                    weighted(recall).alias("recall"), weighted(f1).alias("f1"))


def run_comparison(reports: dict[str, DataFrame], fold: str = "fold") -> DataFrame:
    """Overall rows of several runs side by side."""
    rows = [r.where(F.col(fold).isNull()).withColumn("run", F.lit(name)).drop(fold) for name, r in reports.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


def fold_volatility_by_year(df: DataFrame) -> DataFrame:
    """Mean rolling volatility and number of distinct folds per year."""
    year = F.trunc("dt", "year").cast("date").alias("year")
    return df.groupBy(year).agg(F.avg("rolling_volatility").alias("avg_volatility"),
                                F.count_distinct("fold").alias("folds"))


def fold_volatility_series(df: DataFrame) -> DataFrame:
    return df.groupBy("dt", "fold").agg(F.avg("rolling_volatility").alias("avg_volatility"))


def fold_measures(df: DataFrame) -> DataFrame:
    """Per year: count, distinct count, minimum and sum of folds, sum of volatility."""
    year = F.trunc("dt", "year").cast("date").alias("year")
    return df.groupBy(year).agg(
        F.count("fold").alias("fold_count"), F.count_distinct("fold").alias("fold_distinct"),
        F.min("fold").alias("fold_min"), F.sum("fold").alias("fold_sum"),
        F.sum("rolling_volatility").alias("volatility_sum"))


