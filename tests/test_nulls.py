"""Rows with NULL keys, dates or values are kept or dropped on purpose; results that promise an order have it."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tests.compare import connect, plain
from tickerloom import catalog
from tickerloom.operators import balance, folds, garch, metrics, ordering, profile, stats, windows

SF = "/root/testdata/sf0.001"


def days(n):
    return [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(n)]


def test_row_index_keeps_rows_without_date_or_id(spark):
    d = days(2)
    df = spark.createDataFrame([(d[0], 1), (None, 2), (d[1], None), (d[1], 3)], "dt date, id int")
    got = {(r["dt"], r["id"]): r["row_id"] for r in ordering.row_index(df, "dt", "id").collect()}
    assert got == {(None, 2): 0, (d[0], 1): 1, (d[1], None): 2, (d[1], 3): 3}


def test_groups_with_a_null_key_are_kept(spark):
    rows = [(k, d, float(i)) for k in ("a", None) for i, d in enumerate(days(12))]
    df = spark.createDataFrame(rows, "k string, dt date, x double")
    for unit in ("row", "date"):
        found = folds.time_series_folds(df, 5, "dt", by=["k"], unit=unit)
        assert sorted((r["k"] or "", r["fold"] or 0, r["count"]) for r in found.groupBy("k", "fold").count().collect()) == [
            (k, f, 2) for k in ("", "a") for f in range(6)]
    for table in (profile.describe(df, ["x"], ["k"]), profile.box_stats(df, "x", ["k"]), ordering.exact_quantiles(df, ["x"], [0.5], ["k"])):
        values = [tuple(r)[1:] for r in table.collect()]
        assert len(values) == 2 and values[0] == values[1]
    parts = folds.chrono_split(df, 0.8, "dt", by=["k"]).groupBy("k", "part").count().collect()
    assert sorted(r["count"] for r in parts) == [3, 3, 9, 9]


def test_null_labels_form_a_class_of_their_own(spark):
    df = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(10)], "id int, y int")
    test = balance.stratified_split(df, 0.2, "y", "id").where("part = 'test'").collect()
    assert sorted(r["y"] or 0 for r in test) == [0, 1]
    assert balance.undersample(df.where("id > 2"), "y", "id").groupBy("y").count().select("count").distinct().collect()[0][0] == 3


def test_a_gap_inside_a_series_leaves_no_null(spark):
    close = [100.0 + (i * 7) % 11 for i in range(40)]
    close[20] = None
    rows = [("A", d, 100.0 + i % 3, c, 120.0, 5 + i) for i, (d, c) in enumerate(zip(days(40), close))]
    df = spark.createDataFrame(rows, "ticker string, dt date, open double, close double, high double, volume int")
    got = windows.baseline_features(df, ["ticker"], ["dt"]).toPandas()
    frame = pd.DataFrame(rows, columns=df.columns)
    frame["gap"] = frame["open"] / frame["close"].shift(1) - 1
    frame = frame.dropna(subset=["gap"])
    frame["r"] = 100 * (frame["close"] / frame["close"].shift(1) - 1)
    frame = frame.dropna(subset=["r"])
    frame["v"] = frame["r"].rolling(5).std()
    frame = frame.dropna(subset=["v"])
    frame["v_lag"] = frame["v"].shift(1)
    frame = frame.dropna(subset=["v_lag"])
    assert not got.isna().any().any() and sorted(got["dt"]) == sorted(frame["dt"])
    assert np.allclose(got.sort_values("dt")["volatility_lag1"], frame["v_lag"])


def test_series_without_a_model_keep_their_rows(spark):
    rng = np.random.default_rng(1)
    rows = [("long", d, float(x)) for d, x in zip(days(150), rng.normal(0, 0.01, 150))]
    rows += [("short", d, 0.01 * i) for i, d in enumerate(days(3))] + [("flat", d, 0.02) for d in days(40)]
    df = spark.createDataFrame(rows, "ticker string, dt date, r double")
    fitted = garch.garch_fit(df, "r", "dt", ["ticker"]).toPandas()
    assert dict(fitted.groupby("ticker").size()) == {"flat": 40, "long": 150, "short": 3}
    kinds = fitted.groupby("ticker")["garch_status"].first()
    assert kinds["flat"] == "constant" and kinds["short"] == "short" and kinds["long"] in ("ok", "not converged")
    assert fitted[fitted["ticker"] != "long"]["cond_variance"].isna().all() and fitted[fitted["ticker"] == "long"]["cond_variance"].notna().all()
    models = garch.garch_models(df, "r", "dt", ["ticker"])
    assert {r["ticker"]: r["status"] for r in models.collect()}["flat"] == "constant"
    assert [r["ticker"] for r in garch.garch_select(models, ["ticker"]).collect()] == ["long"]
    tests = {r["ticker"]: r for r in stats.adf(df, "r", ["ticker"], ["dt"]).collect()}
    assert tests["long"]["status"] == "ok" and tests["short"]["statistic"] is None and tests["flat"]["status"] == "short or constant"


def test_a_search_that_was_cut_off_says_so():
    values, together = garch.minimise(lambda p: float(((p - 3) ** 2).sum()), np.zeros(3), 2)[1:]
    assert not together and values > 0
    best, value, together = garch.minimise(lambda p: float(((p - 3) ** 2).sum()), np.zeros(3), 1000)
    assert together and np.allclose(best, 3, atol=1e-2)


def test_area_of_very_many_rows_does_not_overflow(spark):
    df = spark.range(20).select((F.col("id") % 2).cast("int").alias("y_true"), (F.col("id") / 20).alias("y_prob"))
    plan = metrics.roc_auc(df).collect()
    assert 0.5 < plan[0]["roc_auc"] < 1
    big = spark.range(1).select(F.lit(4_000_000_000).alias("pos")).select(F.col("pos").cast("double") * F.col("pos"))
    assert big.first()[0] == 1.6e19


def test_promised_orders(spark):
    queries, checks = catalog.load()
    con = connect(SF)
    for name in ("sorted_bars", "latest_bars"):
        found = queries[name](spark, SF)
        want = con.execute(checks[name])
        order = [found.columns.index(c[0]) for c in want.description]
        assert [tuple(plain(r[i]) for i in order) for r in found.collect()] == [tuple(map(plain, r)) for r in want.fetchall()]
    df = spark.range(200).withColumnRenamed("id", "k")
    once, again = ([r["k"] for r in balance.shuffle_rows(part, "k").collect()] for part in (df, df.repartition(5)))
    assert once == again and sorted(once) == list(range(200)) and once != sorted(once)
