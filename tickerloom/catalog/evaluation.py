"""Queries on splits, balance, scaling, metrics, profiles and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.bars import BY, FEATURE_STEPS, LEVEL_STEPS, ORDER, W, rounded
from tickerloom.catalog.news import SCORED, scored_news
from tickerloom.catalog.registry import query
from tickerloom.functions.numbers import hash_order
from tickerloom.operators import balance, folds, joins, metrics, ordering, profile, scaling, windows
from tickerloom.plans import views
from tickerloom.plans.views import sql

PRICES = ["open", "close", "high", "volume"]
HASH = "((id + 1) % 2147483647) * 48271 * 69621 % 2147483647"


# ---- profiles ----

def describe_sql(cols, source, by=""):
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    return " UNION ALL ".join(
        f"""SELECT {key}'{c}' AS metric, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  round(CAST(min({c}) AS DOUBLE), 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
  round(quantile_cont({c}, 0.75), 4) AS p75, round(CAST(max({c}) AS DOUBLE), 4) AS max FROM {source}{group}""" for c in cols)


@query("describe_bars", sql("bars", ("d", "SELECT ticker, open, close, high, CAST(volume AS DOUBLE) AS volume FROM bars"),
       describe_sql(PRICES, "d")))
def describe_bars(spark, sf):
    df = profile.describe(views.bars(spark, sf), PRICES)
    return rounded(df, "mean", "std", "min", "p25", "p50", "p75", "max", digits=4)


@query("describe_orders_by_priority", describe_sql(["o_totalprice"], "orders", "o_orderpriority"))
def describe_orders_by_priority(spark, sf):
    df = profile.describe(views.table(spark, sf, "orders"), ["o_totalprice"], ["o_orderpriority"])
    return rounded(df, "mean", "std", "min", "p25", "p50", "p75", "max", digits=4)


@query("quantiles", """SELECT event_type, round(quantile_cont(value, 0.1), 6) AS q0, round(quantile_cont(value, 0.5), 6) AS q1,
  round(quantile_cont(value, 0.99), 6) AS q2 FROM events GROUP BY event_type""")
def quantiles(spark, sf):
    df = ordering.exact_quantiles(views.table(spark, sf, "events"), ["value"], [0.1, 0.5, 0.99], ["event_type"])
    return rounded(df.drop("metric"), "q0", "q1", "q2")


def matrix_sql(cols, source):
    return " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM {source}"
                              for a in cols for b in cols)


@query("correlation_matrix", sql("bars", matrix_sql(PRICES, "bars")))
def correlation_matrix(spark, sf):
    return rounded(profile.correlation_matrix(views.bars(spark, sf), PRICES), "r")


@query("movement_correlations", sql("bars", *FEATURE_STEPS, ("g", """SELECT *, CASE WHEN gap > 0 THEN 1 ELSE 0 END AS movement
  FROM f WHERE pos > 7"""), " UNION ALL ".join(
    f"SELECT ticker, '{c}' AS feature, round(corr({c}, movement), 6) AS r FROM g GROUP BY ticker" for c in windows.BASE_FEATURES)))
def movement_correlations(spark, sf):
    df = windows.baseline_features(views.bars(spark, sf), BY, ORDER)
    return rounded(profile.correlation_with(df, windows.BASE_FEATURES, "movement", BY), "r")


@query("sorted_correlations", sql("bars", ("c", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, close) AS r FROM bars" for c in PRICES)),
    "SELECT feature, round(r, 6) AS r FROM c ORDER BY c.r DESC"))
def sorted_correlations(spark, sf):
    df = profile.correlation_with(views.bars(spark, sf), PRICES, "close")
    return rounded(df.orderBy(F.desc("r")), "r")


PAIRS = [("sentiment_lag_1", "movement_open_close_lag"), ("sentiment_lag_1", "movement_close_close_lag")]
MOVES_STEPS = (SCORED, ("a", "SELECT dt, sum(sentiment_score) AS s FROM scored GROUP BY dt"),
               ("m", """SELECT dt, lag(s) OVER w AS sentiment_lag_1, open - lag(close) OVER w AS movement_open_close_lag,
  close - lag(close) OVER w AS movement_close_close_lag, s FROM index_bars JOIN a USING (dt) WINDOW w AS (ORDER BY dt)"""))


def sentiment_moves(spark, sf):
    df = joins.join_pre_aggregated(views.index_bars(spark, sf), scored_news(spark, sf))
    df = windows.gap_moves(df, [], ORDER)
    return df.withColumn("sentiment_lag_1", F.lag("aggregate_sentiment_score", 1).over(windows.series([], ORDER)))


@query("pearson_lagged_sentiment", sql("index_bars news_scores", *MOVES_STEPS, " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n,
  round(corr({a}, {b}) * sqrt((count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) - 2) / (1 - corr({a}, {b}) ** 2)), 6) AS t
  FROM m""" for a, b in PAIRS)))
def pearson_lagged_sentiment(spark, sf):
    return rounded(profile.pearson_test(sentiment_moves(spark, sf), PAIRS).drop("p_value"), "r", "t")


ROLLED = [(f"sentiment_mean{n}", f"{m}_mean{n}") for n in (7, 14)
          for m in ("movement_open_close_lag", "movement_close_close_lag")]


@query("pearson_rolling_p_values")
def pearson_rolling_p_values(spark, sf):
    df = sentiment_moves(spark, sf).withColumnRenamed("aggregate_sentiment_score", "sentiment")
    cols = ["sentiment", "movement_open_close_lag", "movement_close_close_lag"]
    return profile.pearson_test(windows.rolling_table(df, cols, [7, 14], [], [], ORDER), ROLLED)


@query("histogram", """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
  h AS (SELECT least(CAST(floor((value - lo) * 30 / (hi - lo)) AS BIGINT), 29) AS bin, count(*) AS n FROM events, e GROUP BY 1)
  SELECT k AS bin, round(lo + k * ((hi - lo) / 30), 6) AS left_edge, coalesce(n, 0) AS n
  FROM range(30) t(k) CROSS JOIN e LEFT JOIN h ON h.bin = k""")
def histogram(spark, sf):
    return rounded(profile.histogram(views.table(spark, sf, "events"), "value", 30), "left_edge")


BOX_SQL = """SELECT {by}, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(x) FILTER (WHERE x <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)) AS outliers
  FROM x JOIN q USING ({by}) GROUP BY {by}, q1, med, q3"""
BOX_Q = "SELECT {by}, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3 FROM x GROUP BY 1"


@query("event_box_stats", "WITH x AS (SELECT event_type, value AS x FROM events), q AS (" + BOX_Q.format(by="event_type") + ") "
       + BOX_SQL.format(by="event_type"))
def event_box_stats(spark, sf):
    df = profile.box_stats(views.table(spark, sf, "events"), "value", ["event_type"])
    return rounded(df, "q1", "median", "q3", "whisker_low", "whisker_high")


@query("close_by_volatility_level", sql("bars", *LEVEL_STEPS, ("x", """SELECT volatility_level, close AS x FROM l"""),
       ("q2", BOX_Q.format(by="volatility_level")), BOX_SQL.format(by="volatility_level").replace("JOIN q ", "JOIN q2 ")))
def close_by_volatility_level(spark, sf):
    df = windows.rolling_volatility(views.bars(spark, sf), BY, ORDER)
    df = profile.box_stats(df, "close", ["volatility_level"])
    return rounded(df, "q1", "median", "q3", "whisker_low", "whisker_high")


# ---- splits and balance ----

NEWS_FOLDS = (("i", "SELECT news_id, dt, row_number() OVER (ORDER BY dt, news_id) - 1 AS row_id, count(*) OVER () AS n FROM news"),
              ("g", """SELECT news_id, dt, row_id, CASE WHEN row_id >= n - 5 * (n // 6) THEN
  CAST((row_id - (n - 5 * (n // 6))) // (n // 6) AS INT) + 1 END AS fold FROM i"""))


@query("row_index", sql("news", "SELECT news_id, dt, row_number() OVER (ORDER BY dt, news_id) - 1 AS row_id FROM news"))
def row_index(spark, sf):
    return ordering.row_index(views.news(spark, sf).select("news_id", "dt"), "dt", "news_id")


@query("ts_folds", sql("news", *NEWS_FOLDS, "SELECT * FROM g"))
def ts_folds(spark, sf):
    return folds.time_series_folds(views.news(spark, sf).select("news_id", "dt"), 5, "dt", "news_id")


@query("ts_folds_by_date", sql("news", ("d", """SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS row_id, count(*) OVER () AS n
  FROM (SELECT DISTINCT dt FROM news)"""), """SELECT news_id, dt, row_id, CASE WHEN row_id >= n - 3 * (n // 4) THEN
  CAST((row_id - (n - 3 * (n // 4))) // (n // 4) AS INT) + 1 END AS fold FROM d JOIN news USING (dt)"""))
def ts_folds_by_date(spark, sf):
    df = folds.time_series_folds(views.news(spark, sf).select("news_id", "dt"), 3, "dt", "news_id", unit="date")
    return df.select("news_id", "dt", "row_id", "fold")


@query("ticker_folds", sql("bars", ("i", f"""SELECT ticker, dt, row_number() {W} - 1 AS row_id,
  count(*) OVER (PARTITION BY ticker) AS n FROM bars"""), """SELECT ticker, dt, row_id, CASE WHEN row_id >= n - 5 * (n // 6) THEN
  CAST((row_id - (n - 5 * (n // 6))) // (n // 6) AS INT) + 1 END AS fold FROM i"""))
def ticker_folds(spark, sf):
    return folds.time_series_folds(views.bars(spark, sf).select("ticker", "dt"), 5, "dt", by=BY).select(
        "ticker", "dt", "row_id", "fold")


@query("fold_bounds", sql("news", *NEWS_FOLDS, """SELECT f AS fold, min(dt) FILTER (WHERE coalesce(fold, 0) < f) AS train_start,
  max(dt) FILTER (WHERE coalesce(fold, 0) < f) AS train_end, count(*) FILTER (WHERE coalesce(fold, 0) < f) AS train_rows,
  min(dt) FILTER (WHERE fold = f) AS test_start, max(dt) FILTER (WHERE fold = f) AS test_end,
  count(*) FILTER (WHERE fold = f) AS test_rows FROM g, (SELECT CAST(k AS INT) AS f FROM range(1, 6) t(k)) GROUP BY f"""))
def fold_bounds(spark, sf):
    return folds.fold_bounds(ts_folds(spark, sf), 5, "dt")


@query("chrono_split", sql("news", ("i", """SELECT news_id, dt, row_number() OVER (ORDER BY dt, news_id) - 1 AS row_id,
  count(*) OVER () AS n FROM news"""), """SELECT news_id, dt, row_id, CASE WHEN row_id < floor(CAST(0.8 AS DOUBLE) * n)
  THEN 'train' ELSE 'test' END AS part FROM i"""))
def chrono_split(spark, sf):
    return folds.chrono_split(views.news(spark, sf).select("news_id", "dt"), 0.8, "dt", "news_id")


@query("stratified_split", sql("phrases", ("c", "SELECT sentiment, count(*) AS n FROM phrases GROUP BY 1"),
       ("p", "SELECT *, (SELECT sum(n) FROM c)::DOUBLE AS t FROM c"),
       ("w", "SELECT *, n * ceil(CAST(0.2 AS DOUBLE) * t) / t AS wish FROM p"),
       ("k", """SELECT sentiment, floor(wish) + CASE WHEN row_number() OVER (ORDER BY round(wish - floor(wish), 9) DESC, sentiment)
  <= ceil(CAST(0.2 AS DOUBLE) * t) - sum(floor(wish)) OVER () THEN 1 ELSE 0 END AS quota FROM w"""),
       ("r", f"SELECT id, sentiment, row_number() OVER (PARTITION BY sentiment ORDER BY {HASH}, id) AS r FROM phrases"),
       "SELECT id, sentiment, CASE WHEN r <= quota THEN 'test' ELSE 'train' END AS part FROM r JOIN k USING (sentiment)"))
def stratified_split(spark, sf):
    return balance.stratified_split(views.phrases(spark, sf).select("id", "sentiment"), 0.2, "sentiment", "id")


@query("undersample", sql("phrases", ("r", f"""SELECT id, sentiment, row_number() OVER (PARTITION BY sentiment ORDER BY {HASH}, id) AS r
  FROM phrases"""), """SELECT id, sentiment FROM r WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM phrases GROUP BY sentiment))"""))
def undersample(spark, sf):
    return balance.undersample(views.phrases(spark, sf).select("id", "sentiment"), "sentiment", "id")


TRAIN_PARTS = ("t", """SELECT f AS fold, row_id, y_true FROM predictions, (SELECT CAST(k AS INT) AS f FROM range(1, 6) t(k))
  WHERE coalesce(fold, 0) < f""")


@query("balance_report", sql("predictions", TRAIN_PARTS, ("c", "SELECT fold, y_true, count(*) AS n FROM t GROUP BY 1, 2"),
       "SELECT fold, y_true, min(n) OVER (PARTITION BY fold) AS n FROM c"))
def balance_report(spark, sf):
    p = views.predictions(spark, sf).select("row_id", "y_true", "fold")
    parts = [balance.undersample(folds.train_rows(p, f), "y_true", "row_id").withColumn("fold", F.lit(f)) for f in range(1, 6)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return balance.balance_report(out, "y_true", ["fold"])


@query("shuffle_rows", sql("news", f"SELECT news_id, title FROM news ORDER BY {HASH.replace('id', 'news_id')}, news_id"))
def shuffle_rows(spark, sf):
    return balance.shuffle_rows(views.news(spark, sf).select("news_id", "title"), "news_id")


def scaled_sql(c, source):
    return f"round(CASE WHEN {source}.{c}_std = 0 THEN 0 ELSE ({c} - {source}.{c}_mean) / {source}.{c}_std END, 6) AS {c}"


@query("scale_all", sql("bars", ("s", "SELECT " + ", ".join(
    f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in PRICES) + " FROM bars"),
    "SELECT ticker, dt, " + ", ".join(scaled_sql(c, "s") for c in PRICES) + " FROM bars, s"))
def scale_all(spark, sf):
    return rounded(scaling.scale(views.bars(spark, sf), PRICES), *PRICES)


@query("scale_on_train", sql("bars", ("i", f"""SELECT *, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars"""),
       ("s", "SELECT " + ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in PRICES)
        + " FROM i WHERE i.i < floor(CAST(0.8 AS DOUBLE) * n)"),
       "SELECT ticker, dt, " + ", ".join(scaled_sql(c, "s") for c in PRICES) + " FROM bars, s"))
def scale_on_train(spark, sf):
    parts = folds.chrono_split(views.bars(spark, sf), 0.8, "dt", by=BY)
    out = scaling.scale(parts, PRICES, parts.where(F.col("part") == "train"))
    return rounded(out.select("ticker", "dt", *PRICES), *PRICES)


@query("scale_test_folds", sql("predictions", ("s", """SELECT f AS fold, avg(ret) AS ret_mean, stddev_pop(ret) AS ret_std FROM predictions,
  (SELECT CAST(k AS INT) AS f FROM range(1, 6) t(k)) WHERE coalesce(fold, 0) < f GROUP BY f"""),
       "SELECT row_id, fold, round((ret - ret_mean) / ret_std, 6) AS ret FROM predictions JOIN s USING (fold)"))
def scale_test_folds(spark, sf):
    out = scaling.scale_test_folds(views.predictions(spark, sf), ["ret"], 5)
    return rounded(out.select("row_id", "fold", "ret"), "ret")


# ---- metrics ----

CONF = """count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
  count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn"""
CLASS = """round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS roc_auc,
  round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc"""
TRADE = """round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
  round(CASE WHEN abs(sum(CASE WHEN r < 0 THEN r ELSE 0 END)) > 1e-10 THEN
    sum(CASE WHEN r > 0 THEN r ELSE 0 END) / abs(sum(CASE WHEN r < 0 THEN r ELSE 0 END)) END, 6) AS profit_factor,
  round(CASE WHEN stddev_pop(r) > 1e-10 THEN avg(r) / stddev_pop(r) * sqrt(252) ELSE 0 END, 6) AS sharpe"""
TESTS = ("t", "SELECT *, y_pred * ret AS r FROM predictions WHERE fold IS NOT NULL")
BOTH = ("b", "SELECT fold, y_true, y_pred, y_prob, r FROM t UNION ALL SELECT NULL, y_true, y_pred, y_prob, r FROM t")
AUC_STEPS = (("sc", """SELECT fold, y_prob, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg
  FROM b GROUP BY 1, 2"""), ("au", """SELECT fold, sum(pos * (below + neg / 2.0)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM
  (SELECT *, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY y_prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
   FROM sc) GROUP BY fold"""))
ROUND = metrics.CLASS_COLUMNS + metrics.TRADE_COLUMNS


def tests_of(spark, sf):
    return views.predictions(spark, sf).where(F.col("fold").isNotNull())


@query("confusion", sql("predictions", TESTS, f"SELECT fold, {CONF} FROM t GROUP BY fold"))
def confusion(spark, sf):
    return metrics.confusion(tests_of(spark, sf), ["fold"])


@query("class_metrics", sql("predictions", TESTS, ("c", f"SELECT fold, {CONF} FROM t GROUP BY fold"), f"SELECT fold, {CLASS} FROM c"))
def class_metrics(spark, sf):
    df = metrics.class_metrics(metrics.confusion(tests_of(spark, sf), ["fold"]))
    return rounded(df.select("fold", *metrics.CLASS_COLUMNS), *metrics.CLASS_COLUMNS)


@query("mcc", sql("predictions", TESTS, ("c", f"SELECT {CONF} FROM t"), """SELECT round((tp * tn - fp * fn) /
  sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM c"""))
def mcc(spark, sf):
    return rounded(metrics.class_metrics(metrics.confusion(tests_of(spark, sf))).select("mcc"), "mcc")


@query("roc_auc", sql("predictions", TESTS, BOTH, *AUC_STEPS, "SELECT fold, round(auc, 6) AS roc_auc FROM au WHERE fold IS NOT NULL"))
def roc_auc(spark, sf):
    return rounded(metrics.roc_auc(tests_of(spark, sf), ["fold"]), "roc_auc")


@query("event_auc", """WITH b AS (SELECT NULL AS fold, value AS y_prob, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y_true
  FROM events), """ + ", ".join(f"{n} AS ({s})" for n, s in AUC_STEPS) + " SELECT round(auc, 6) AS roc_auc FROM au")
def event_auc(spark, sf):
    e = views.table(spark, sf, "events").select(
        F.col("value").alias("y_prob"), (F.col("event_type") == "purchase").cast("int").alias("y_true"))
    return rounded(metrics.roc_auc(e), "roc_auc")


@query("strategy_returns", sql("predictions", TESTS, "SELECT row_id, fold, round(r, 4) AS strategy_return FROM t"))
def strategy_returns(spark, sf):
    df = metrics.strategy_returns(tests_of(spark, sf))
    return rounded(df.select("row_id", "fold", "strategy_return"), "strategy_return", digits=4)


@query("trading_metrics", sql("predictions", TESTS, f"SELECT fold, {TRADE} FROM t GROUP BY fold"))
def trading_metrics(spark, sf):
    df = metrics.trading_metrics(metrics.strategy_returns(tests_of(spark, sf)), ["fold"])
    return rounded(df, *metrics.TRADE_COLUMNS)


REPORT = (TESTS, BOTH, ("c", f"SELECT fold, {CONF}, {TRADE} FROM b GROUP BY fold"),
          ("rep", f"SELECT fold, {CLASS}, win_rate, profit_factor, sharpe FROM c"))


@query("fold_report", sql("predictions", *REPORT, "SELECT * FROM rep"))
def fold_report(spark, sf):
    return rounded(metrics.fold_report(views.predictions(spark, sf)), *ROUND)


@query("fold_report_mean", sql("predictions", *REPORT, *AUC_STEPS, ("u", """SELECT rep.fold, accuracy, precision, recall, f1,
  round(au.auc, 6) AS roc_auc, mcc, win_rate, profit_factor, sharpe FROM rep JOIN au ON rep.fold IS NOT DISTINCT FROM au.fold"""),
       """SELECT * FROM u WHERE fold IS NOT NULL UNION ALL SELECT NULL, round(avg(accuracy), 4), round(avg(precision), 4),
  round(avg(recall), 4), round(avg(f1), 4), round(avg(roc_auc), 4), round(avg(mcc), 4), max(win_rate) FILTER (WHERE fold IS NULL),
  max(profit_factor) FILTER (WHERE fold IS NULL), max(sharpe) FILTER (WHERE fold IS NULL)
  FROM (SELECT CASE WHEN fold IS NULL THEN NULL ELSE accuracy END AS accuracy, CASE WHEN fold IS NULL THEN NULL ELSE precision END AS precision,
  CASE WHEN fold IS NULL THEN NULL ELSE recall END AS recall, CASE WHEN fold IS NULL THEN NULL ELSE f1 END AS f1,
  CASE WHEN fold IS NULL THEN NULL ELSE roc_auc END AS roc_auc, CASE WHEN fold IS NULL THEN NULL ELSE mcc END AS mcc,
  fold, win_rate, profit_factor, sharpe FROM u)"""))
def fold_report_mean(spark, sf):
    df = metrics.fold_report(views.predictions(spark, sf), overall="fold_mean", auc="score")
    four = {c: F.when(F.col("fold").isNull(), F.round(c, 4)).otherwise(F.round(c, 6)) for c in metrics.CLASS_COLUMNS}
    return rounded(df.withColumns(four), *metrics.TRADE_COLUMNS)


@query("fold_metric_mean", sql("predictions", TESTS, ("c", f"SELECT fold, {CONF} FROM t GROUP BY fold"),
       ("m", f"SELECT fold, {CLASS.replace(', 6)', ', 12)')} FROM c"), " UNION ALL ".join(
    f"SELECT '{c}' AS metric, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM m" for c in metrics.CLASS_COLUMNS)))
def fold_metric_mean(spark, sf):
    return rounded(metrics.fold_metric_mean(metrics.fold_report(views.predictions(spark, sf))), "mean", "std")


@query("weighted_prf", sql("phrases", ("p", f"""SELECT sentiment AS y_true, CASE WHEN ({HASH}) % 3 = 0 THEN 'neutral'
  ELSE sentiment END AS y_pred FROM phrases"""), ("m", """SELECT c, (SELECT count(*) FROM p WHERE y_true = c) AS s,
  (SELECT count(*) FROM p WHERE y_pred = c) AS q, (SELECT count(*) FROM p WHERE y_true = c AND y_pred = c) AS tp
  FROM (SELECT DISTINCT y_true AS c FROM p)"""), """SELECT round(sum(tp) / sum(s), 6) AS accuracy,
  round(sum(s * coalesce(tp / nullif(q, 0), 0)) / sum(s), 6) AS precision, round(sum(s * (tp / s)) / sum(s), 6) AS recall,
  round(sum(s * (2 * tp / (q + s))) / sum(s), 6) AS f1 FROM m"""))
def weighted_prf(spark, sf):
    p = views.phrases(spark, sf).select(F.col("sentiment").alias("y_true"), F.when(
        hash_order("id") % 3 == 0, "neutral").otherwise(F.col("sentiment")).alias("y_pred"))
    return rounded(metrics.weighted_prf(p, "y_true", "y_pred"), "accuracy", "precision", "recall", "f1")


@query("run_comparison", sql("predictions", TESTS, ("x", """SELECT 'model' AS run, y_true, y_pred, r FROM t UNION ALL
  SELECT 'always_up', y_true, 1, ret FROM t"""), ("c", f"SELECT run, {CONF}, {TRADE} FROM x GROUP BY run"),
       f"SELECT run, {CLASS}, win_rate, profit_factor, sharpe FROM c"))
def run_comparison(spark, sf):
    p = views.predictions(spark, sf)
    runs = {"model": metrics.fold_report(p), "always_up": metrics.fold_report(p.withColumn("y_pred", F.lit(1)))}
    return rounded(metrics.run_comparison(runs), *ROUND)


# ---- dashboard aggregates ----

@query("fold_volatility_by_year", sql("fold_volatility", """SELECT CAST(date_trunc('year', dt) AS DATE) AS year,
  round(avg(rolling_volatility), 6) AS avg_volatility, count(DISTINCT fold) AS folds FROM fold_volatility GROUP BY 1"""))
def fold_volatility_by_year(spark, sf):
    return rounded(metrics.fold_volatility_by_year(views.fold_volatility(spark, sf)), "avg_volatility")


@query("fold_volatility_series", sql("fold_volatility", """SELECT dt, fold, round(avg(rolling_volatility), 6) AS avg_volatility
  FROM fold_volatility GROUP BY 1, 2"""))
def fold_volatility_series(spark, sf):
    return rounded(metrics.fold_volatility_series(views.fold_volatility(spark, sf)), "avg_volatility")


@query("fold_measures", sql("fold_volatility", """SELECT CAST(date_trunc('year', dt) AS DATE) AS year, count(fold) AS fold_count,
  count(DISTINCT fold) AS fold_distinct, min(fold) AS fold_min, CAST(sum(fold) AS BIGINT) AS fold_sum,
  round(sum(rolling_volatility), 4) AS volatility_sum FROM fold_volatility GROUP BY 1"""))
def fold_measures(spark, sf):
    return rounded(metrics.fold_measures(views.fold_volatility(spark, sf)), "volatility_sum", digits=4)


@query("returns_for_rows", sql("predictions", """SELECT row_id, fold, y_pred, round(ret, 4) AS ret FROM predictions WHERE fold IS NOT NULL"""))
def returns_for_rows(spark, sf):
    p = views.predictions(spark, sf)
    tests = p.where(F.col("fold").isNotNull()).select("row_id", "fold", "y_pred")
    return rounded(joins.returns_for_rows(tests, p.select("row_id", "ret")), "ret", digits=4)
