import math

import pytest
from pyspark.sql import functions as F

from tickerloom.operators import metrics

SCHEMA = "fold int, y_true int, y_pred int, y_prob double, ret double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_one_class_fold(spark):
    df = frame(spark, [(1, 0, 0, 0.2, 1.0), (1, 0, 0, 0.3, -1.0)])
    row = metrics.fold_report(df).where("fold = 1").first()
    assert (row["precision"], row["recall"], row["f1"], row["mcc"], row["roc_auc"]) == (0, 0, 0, 0, None)
    assert metrics.roc_auc(df).first()["roc_auc"] is None


def test_no_losses_and_constant_returns(spark):
    df = frame(spark, [(1, 1, 1, 0.9, 2.0), (1, 1, 1, 0.8, 2.0)])
    row = metrics.fold_report(df).where("fold is null").first()
    assert row["profit_factor"] is None and row["sharpe"] == 0 and row["win_rate"] == 1


def test_ties_count_half(spark):
    df = frame(spark, [(1, 1, 1, 0.5, 0.0), (1, 0, 1, 0.5, 0.0), (1, 1, 1, 0.9, 0.0), (1, 0, 0, 0.1, 0.0)])
    assert metrics.roc_auc(df).first()["roc_auc"] == pytest.approx((0.5 + 1 + 1 + 1) / 4)
    flipped = df.withColumn("y_prob", 1 - F.col("y_prob"))
    assert metrics.roc_auc(flipped).first()["roc_auc"] == pytest.approx(1 - 3.5 / 4)


def test_report_against_plain_python(spark):
    import random
    rnd = random.Random(4)
    rows = [(rnd.choice([1, 2, None]), rnd.randint(0, 1), rnd.randint(0, 1), rnd.random(), rnd.gauss(0, 1)) for _ in range(200)]
    report = {r["fold"]: r for r in metrics.fold_report(frame(spark, rows)).collect()}
    for fold in (1, 2, None):
        part = [r for r in rows if (r[0] == fold if fold else r[0] is not None)]
        tp, fp = sum(r[1] & r[2] for r in part), sum((1 - r[1]) & r[2] for r in part)
        fn, tn = sum(r[1] & (1 - r[2]) for r in part), sum((1 - r[1]) & (1 - r[2]) for r in part)
        assert tp + fp + fn + tn == len(part)
        got = report[fold]
        assert got["accuracy"] == pytest.approx((tp + tn) / len(part))
        assert got["mcc"] == pytest.approx((tp * tn - fp * fn) / math.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
        assert got["roc_auc"] == pytest.approx((tp / (tp + fn) + tn / (tn + fp)) / 2)
        s = [r[2] * r[4] for r in part]
        mean = sum(s) / len(s)
        dev = math.sqrt(sum((x - mean) ** 2 for x in s) / len(s))
        assert got["sharpe"] == pytest.approx(mean / dev * math.sqrt(252))
        assert got["profit_factor"] == pytest.approx(sum(x for x in s if x > 0) / -sum(x for x in s if x < 0))
    pooled = {r["fold"]: r["roc_auc"] for r in metrics.fold_report(frame(spark, rows), auc="score").collect()}
    part = [r for r in rows if r[0] is not None]
    pairs = [(p[3], n[3]) for p in part for n in part if p[1] == 1 and n[1] == 0]
    assert pooled[None] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    mean_row = {r["fold"]: r for r in metrics.fold_report(frame(spark, rows), overall="fold_mean").collect()}[None]
    assert mean_row["f1"] == pytest.approx((report[1]["f1"] + report[2]["f1"]) / 2)
    assert mean_row["win_rate"] == pytest.approx(report[None]["win_rate"])


def test_published_rates_satisfy_the_formulas(spark):
    """Recall 0.90, precision 0.57 give F1 0.70; all-up predictions give AUC 0.5."""
    df = spark.createDataFrame([(90, 68, 10, 12)], "tp long, fp long, fn long, tn long")
    row = metrics.class_metrics(df).first()
    assert round(row["recall"], 2) == 0.90 and round(row["precision"], 2) == 0.57 and round(row["f1"], 2) == 0.70
