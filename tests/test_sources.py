import datetime as dt

from pyspark.sql import functions as F

from tickerloom.operators import columns, models, profile
from tickerloom.sources import readers, writers


def test_prices(spark, tmp_path):
    (tmp_path / "p.csv").write_text(",Date,Open,Close,High,Volume\n0,2020-01-02,1.5,bad,2.5,100\n1,2020-01-01,1,2,3,7\n")
    rows = readers.read_prices(spark, str(tmp_path / "p.csv")).orderBy("dt").collect()
    assert rows[0].asDict() == {"dt": dt.date(2020, 1, 1), "open": 1.0, "close": 2.0, "high": 3.0, "volume": 7}
    assert rows[1]["close"] is None


def test_news_over_several_lines(spark, tmp_path):
    (tmp_path / "n.csv").write_text('Time,Title,Tag,Content,sentiment_score\n31/12/2020,"A, b",t,"line 1\nsaid ""x""",-0.25\n')
    row = readers.read_news(spark, str(tmp_path / "n.csv"), day_first=True, scored=True).first()
    assert row["dt"] == dt.date(2020, 12, 31) and row["content"] == 'line 1\nsaid "x"' and row["sentiment_score"] == -0.25


def test_ticker_news(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Unnamed: 0,title,date,stock\n0.0,Up,2020-06-05 10:30:54-04:00,MU\n")
    row = readers.read_ticker_news(spark, str(tmp_path / "t.csv")).first()
    assert (row["title"], row["ticker"], row["dt"]) == ("Up", "MU", dt.date(2020, 6, 5))


def test_phrases_and_fold_volatility(spark, tmp_path):
    (tmp_path / "s.csv").write_text("Sentence,Sentiment\nGood,positive\n")
    assert readers.read_phrases(spark, str(tmp_path / "s.csv")).first()["sentiment"] == "positive"
    (tmp_path / "f.csv").write_text("Fold,Date,RollingVolatility\n2,2020-01-01,0.5\n")
    assert tuple(readers.read_fold_volatility(spark, str(tmp_path / "f.csv")).first()) == (2, dt.date(2020, 1, 1), 0.5)


def test_prediction_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(dt.date(2020, 1, d), d % 2 + 1, 0.5 * d, None, d % 2, 1) for d in (1, 2, 3)],
                               "dt date, fold int, ret double, daily_return_lag1 double, y_true int, y_pred int")
    path = str(tmp_path / "log")
    writers.write_predictions(df, path)
    back = readers.read_predictions(spark, path)
    assert sorted(map(tuple, back.select(*df.columns).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    (tmp_path / "odd.jsonl").write_text('{"Date":"2020-01-01T00:00:00","Fold":1,"Ground_Truth":"x","Model_Prediction":1}\n')
    assert readers.read_predictions(spark, str(tmp_path / "odd.jsonl")).first()["y_true"] is None


def test_tables_and_correlations(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 2.0, 'a\n"b"'), (2.0, 4.5, "c"), (3.0, 5.0, "d")], "x double, y double, t string")
    writers.write_table(df, str(tmp_path / "csv"), "csv")
    back = readers.read_csv(spark, str(tmp_path / "csv"), "x double, y double, t string", multi_line=True)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    writers.write_table(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3
    writers.write_correlations(profile.correlation_matrix(df, ["x", "y"]), str(tmp_path / "corr"))
    assert spark.read.option("header", True).csv(str(tmp_path / "corr")).count() == 4


def test_columns(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "`Unnamed: 0` int, t string")
    assert columns.drop_index_col(df).columns == ["t"]
    assert {r["column_name"]: r["nulls"] for r in columns.null_profile(df).collect()} == {"Unnamed: 0": 0, "t": 1}
    assert columns.drop_missing(df).count() == 1


def test_logistic_reaches_the_penalised_optimum(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    y = (x @ [1.0, -0.5] + rng.normal(size=300) > 0.2).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, movement int")
    ready = models.assembled(df, ["a", "b"]).select("features", F.col("movement"))
    fit = models.logistic(300, c=0.1).fit(ready)
    w, b = fit.coefficients.toArray(), fit.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.allclose(w + 0.1 * x.T @ (p - y), 0, atol=1e-2) and abs((p - y).sum()) < 1e-2
