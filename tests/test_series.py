"""Features, folds and tests on small hand-made series."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.functions import tails
from tickerloom.operators import folds, garch, stats, windows

BY, ORDER = ["ticker"], ["dt"]


@pytest.fixture(scope="module")
def tiny():
    rng = np.random.default_rng(5)
    rows = []
    for ticker, n in (("A", 20), ("B", 16)):
        day = dt.date(2021, 3, 1)
        for i in range(n):
            day += dt.timedelta(days=3 if i == 5 else 1)
            o, c = rng.uniform(10, 20, 2).round(2)
            rows.append((ticker, day, float(o), float(c), float(max(o, c) + 1), int(rng.integers(100, 999))))
    return pd.DataFrame(rows, columns=["ticker", "dt", "open", "close", "high", "volume"]).sample(frac=1, random_state=1)


def by_pandas(frame, sentiment=False):
    """The staged form: shift, roll and drop rows step by step."""
    out = []
    for _, g in frame.sort_values("dt").groupby("ticker"):
        g = g.copy()
        g["gap"] = g["open"] / g["close"].shift(1) - 1
        g = g.dropna(subset=["gap"])
        g["movement"] = (g["gap"] > 0).astype(int)
        g["daily_return"] = g["close"].pct_change() * 100
        g["volatility"] = g["daily_return"].rolling(5).std()
        g = g.dropna(subset=["volatility"])
        lagged = ["close", "high", "volume", "daily_return", "volatility"]
        if sentiment:
            g["sentiment_volatility"] = g["aggregate_sentiment_score"].rolling(5).std()
            for c in ("sentiment_volatility", "aggregate_sentiment_score"):
                g[f"{c}_lag1"] = g[c].shift(1)
            g = g.dropna(subset=["sentiment_volatility_lag1", "aggregate_sentiment_score_lag1"])
        for c in lagged:
            g[f"{c}_lag1"] = g[c].shift(1)
        out.append(g.dropna(subset=[f"{c}_lag1" for c in lagged]))
    return pd.concat(out)


@pytest.mark.parametrize("sentiment", [False, True])
def test_feature_table_equals_staged_drops(spark, tiny, sentiment):
    frame = tiny.assign(aggregate_sentiment_score=tiny["volume"] / 7.0)
    got = windows.baseline_features(spark.createDataFrame(frame), BY, ORDER, sentiment=sentiment).toPandas()
    want = by_pandas(frame, sentiment)
    cols = windows.SENTIMENT_FEATURES if sentiment else windows.BASE_FEATURES
    assert len(got) == len(want) == 36 - 2 * (12 if sentiment else 7)
    got, want = got.sort_values(["ticker", "dt"]), want.sort_values(["ticker", "dt"])
    assert (got["movement"].to_numpy() == want["movement"].to_numpy()).all()
    assert np.allclose(got[cols].astype(float), want[cols].astype(float))


def test_zero_price_gives_null(spark):
    df = spark.createDataFrame([("A", 1, 5.0, 0.0), ("A", 2, 6.0, 3.0)], "ticker string, dt int, open double, close double")
    out = df.withColumn("r", windows.pct_change("close", BY, ORDER)).orderBy("dt").collect()
    assert out[1]["r"] is None


def test_rolling_of_one_is_the_value(spark, tiny):
    df = spark.createDataFrame(tiny)
    out = df.select("close", windows.rolling_mean("close", 1, BY, ORDER).alias("m")).toPandas()
    assert np.allclose(out["close"], out["m"])


@pytest.mark.parametrize("n", [6, 7, 11, 17])
@pytest.mark.parametrize("k", [3, 5])
def test_fold_sizes(spark, n, k):
    df = spark.range(n).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("dt"))
    out = folds.time_series_folds(df, k, "dt").toPandas().sort_values("row_id")
    size = n // (k + 1)
    first = n - k * size
    want = [None if i < first else (i - first) // size + 1 for i in range(n)]
    assert [None if pd.isna(f) else int(f) for f in out["fold"]] == want


def regression_f(y, x, p):
    n = len(y)
    target = y[p:]
    own = np.column_stack([np.ones(n - p)] + [y[p - i:n - i] for i in range(1, p + 1)])
    full = np.column_stack([own] + [x[p - i:n - i] for i in range(1, p + 1)])

    def ssr(m):
        r = target - m @ np.linalg.lstsq(m, target, rcond=None)[0]
        return r @ r
    a, b, free = ssr(own), ssr(full), n - p - 2 * p - 1
    return (a - b) / b / p * free, (n - p) * (a - b) / b, (n - p) * np.log(a / b)


def test_granger_against_regressions(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(1e6, 1e4, 120)
    y = np.roll(x, 1) * 1e-3 + rng.normal(0, 20, 120)
    df = spark.createDataFrame(pd.DataFrame({"dt": range(120), "x": x, "y": y}))
    out = stats.granger(df, [("y", "x"), ("x", "y")], 3, [], ["dt"]).toPandas()
    for effect, cause, a, b in (("y", "x", y, x), ("x", "y", x, y)):
        for p in (1, 2, 3):
            rows = out[(out.effect == effect) & (out.cause == cause) & (out.lag == p)].set_index("test")["statistic"]
            f, chi2, lr = regression_f(a, b, p)
            assert np.allclose(rows[["ssr_ftest", "ssr_chi2test", "lrtest", "params_ftest"]], [f, chi2, lr, f], rtol=1e-6)
    decision = stats.granger_decision(spark.createDataFrame(out)).toPandas().set_index(["effect", "cause"])
    assert decision.loc[("y", "x"), "first_lag"] == 1


def test_pacf_solves_yule_walker(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(s, i, float(v)) for s in "ab" for i, v in enumerate(np.cumsum(rng.normal(size=60)))], "s string, i int, x double")
    r = stats.acf(df, "x", 6, ["s"], ["i"]).toPandas().sort_values("lag").groupby("s")["acf"].apply(list)
    got = stats.pacf(df, "x", 6, ["s"], ["i"]).toPandas().sort_values("lag").groupby("s")["pacf"].apply(list)
    for s in "ab":
        assert len(got[s]) == 7 and got[s][0] == 1
        for k in range(1, 7):
            m = np.array([[r[s][abs(i - j)] for j in range(k)] for i in range(k)])
            assert np.isclose(got[s][k], np.linalg.solve(m, r[s][1:k + 1])[-1])


def test_products_of_any_rows_follow_from_lagged_sums(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "i int, a double, b double")
    sums = stats.lagged_sums(df, ["a", "b"], 3, [], ["i"])
    design = [(0, 0), (1, 2), (0, 1), (1, 0), (0, 3)]
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.lit(k).alias("lag")) for c, k in design])
    for first in (3, 5):
        z = np.column_stack([x[first - k:12 - k, c] for c, k in design])
        got = stats.lagged_sums(df, ["a", "b"], 5, [], ["i"]).select(stats.gram(cells, F.lit(first), 2, 5).alias("g")).first()["g"]
        assert np.allclose(np.array(got), z.T @ z)
    m = sums.select(stats.eliminated(stats.gram(cells, F.lit(3), 2, 3), F.array(F.lit(1), F.lit(4))).alias("g")).first()["g"]
    z = np.column_stack([x[3 - k:12 - k, c] for c, k in design])
    rest = z - z[:, [1, 4]] @ np.linalg.lstsq(z[:, [1, 4]], z, rcond=None)[0]
    assert np.allclose(np.array(m), rest.T @ rest)


def unit_root_by_hand(x, maxlag):
    """(statistic, lags, rows) of the regression with constant; maxlag None searches by AIC on a common sample."""
    dx = np.diff(x)

    def regression(lag, skip):
        y = dx[skip:]
        m = np.column_stack([np.ones(len(y)), x[skip:-1]] + [dx[skip - i:len(dx) - i] for i in range(1, lag + 1)])
        coef = np.linalg.lstsq(m, y, rcond=None)[0]
        return m, coef, float(((y - m @ coef) ** 2).sum()), len(y)

    lag = maxlag
    if maxlag is None:
        top = min(int(np.ceil(12 * (len(x) / 100) ** 0.25)), len(x) // 2 - 2)
        lag = min(range(top + 1), key=lambda k: regression(k, top)[3] * np.log(regression(k, top)[2] / regression(k, top)[3]) + 2 * (k + 2))
    m, coef, ssr, n = regression(lag, lag)
    return coef[1] / np.sqrt(ssr / (n - m.shape[1]) * np.linalg.inv(m.T @ m)[1, 1]), lag, n


@pytest.mark.parametrize("maxlag", [0, 1, 4, None])
def test_unit_root_equals_regressions(spark, maxlag):
    rng = np.random.default_rng(12)
    e = rng.normal(size=300)
    cycle = np.zeros(300)
    for t in range(4, 300):
        cycle[t] = 0.5 * cycle[t - 1] - 0.3 * cycle[t - 4] + e[t]
    kinds = {"walk": 1e6 + 1e3 * np.cumsum(e), "cycle": cycle, "few": e[:30]}
    df = spark.createDataFrame([(s, i, float(v)) for s, x in kinds.items() for i, v in enumerate(x)], "s string, i int, x double")
    got = {r["s"]: r for r in stats.adf(df, "x", ["s"], ["i"], maxlag).collect()}
    for s, x in kinds.items():
        tau, lag, n = unit_root_by_hand(x, maxlag)
        assert (got[s]["used_lag"], got[s]["n"], got[s]["status"]) == (lag, n, "ok") and np.isclose(got[s]["statistic"], tau, rtol=1e-6)
    (one,) = stats.adf(df.where("s = 'cycle'"), "x", [], ["i"], maxlag).collect()
    assert np.isclose(one["statistic"], got["cycle"]["statistic"])


def test_unit_root(spark):
    rng = np.random.default_rng(2)
    noise = rng.normal(size=400)
    rows = [("walk", i, float(v)) for i, v in enumerate(np.cumsum(noise))] + [("noise", i, float(v)) for i, v in enumerate(noise)]
    out = stats.adf(spark.createDataFrame(rows, "s string, i int, x double"), "x", ["s"], ["i"]).toPandas().set_index("s")
    assert out.loc["noise", "p_value"] < 0.01 < 0.05 < out.loc["walk", "p_value"]
    assert out.loc["noise", "critical_5"] == pytest.approx(-2.8687, abs=2e-3)


def test_tails():
    assert tails.t_sf2(2.0, 10) == pytest.approx(0.0733880, abs=1e-7)
    assert tails.f_sf(4.0, 2, 10) == pytest.approx(1.8 ** -5, abs=1e-12)
    assert tails.chi2_sf(5.0, 3) == pytest.approx(0.1717971, abs=1e-7)
    assert tails.chi2_sf(7.0, 4) == pytest.approx(0.1358882, abs=1e-7)
    assert tails.adf_p_value(-2.86) == pytest.approx(0.0502, abs=1e-3)


def test_garch_recovers_parameters(spark):
    rng = np.random.default_rng(1)
    h, e = 1.0, []
    for _ in range(3000):
        h = 0.1 + 0.1 * (e[-1] ** 2 if e else 1.0) + 0.8 * h
        e.append(np.sqrt(h) * rng.standard_normal())
    pdf = pd.DataFrame({"dt": pd.date_range("2010-01-01", periods=3000).date, "r": np.array(e) / 100, "ticker": "A"})
    short = pd.DataFrame({"dt": pd.date_range("2010-01-01", periods=3).date, "r": [0.1, 0.2, 0.1], "ticker": "B"})
    df = spark.createDataFrame(pd.concat([pdf, short]))
    models = garch.garch_models(df, "r", "dt", ["ticker"], [(1, 1), (2, 1)], mean="zero")
    one = models.where("p = 1 and ticker = 'A'").first()
    assert one["alpha"][0] == pytest.approx(0.1, abs=0.04) and one["beta"][0] == pytest.approx(0.8, abs=0.07)
    assert one["aic"] == pytest.approx(-2 * one["loglik"] + 6)
    best = garch.garch_select(models, ["ticker"]).collect()
    assert [r["ticker"] for r in best] == ["A"]
    fitted = garch.garch_fit(df, "r", "dt", ["ticker"]).orderBy("dt").toPandas()
    # The series that is too short for a model keeps its rows, without values.
    assert len(fitted) == 3003 and fitted[fitted["ticker"] == "B"]["cond_variance"].isna().all()
    fitted = fitted[fitted["ticker"] == "A"].reset_index(drop=True)
    assert np.allclose(fitted["garch_cond_variance"][:-1], fitted["cond_variance"][1:])
    assert one["forecast"][0] == pytest.approx(fitted["garch_cond_variance"].iloc[-1], rel=1e-3)
    ahead = garch.garch_forecast(df, models.where("p = 1 and ticker = 'A'"), ["ticker"]).where("forecasted_volatility is not null")
    days = [r["dt"] for r in ahead.orderBy("dt").collect()]
    assert len(days) == 5 and all(d.weekday() < 5 for d in days)
