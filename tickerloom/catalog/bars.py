"""Queries over daily bars: features, filters, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.registry import query
from tickerloom.functions.numbers import truncate_cents, to_number, up_flag
from tickerloom.operators import columns, windows
from tickerloom.plans import views
from tickerloom.plans.views import sql

BY, ORDER = ["ticker"], ["dt"]
W = "OVER (PARTITION BY ticker ORDER BY dt)"


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def frame(n):
    return f"OVER (PARTITION BY ticker ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll_sql(fn, c, n):
    return f"CASE WHEN count({c}) {frame(n)} = {n} THEN {fn}({c}) {frame(n)} END"


@query("daily_bars", sql("bars", "SELECT ticker, dt, open, close, high, CAST(volume AS BIGINT) AS volume FROM bars"))
def daily_bars(spark, sf):
    return views.bars(spark, sf)


FEATURES_SQL = f"""SELECT *, row_number() {W} AS pos, lag(close) {W} AS close_lag1, lag(high) {W} AS high_lag1,
  lag(volume) {W} AS volume_lag1, lag(daily_return) {W} AS daily_return_lag1, lag(volatility) {W} AS volatility_lag1
  FROM v"""
FEATURE_STEPS = (
    ("r", f"""SELECT *, open / lag(close) {W} - 1 AS gap, (close / lag(close) {W} - 1) * 100 AS daily_return FROM bars"""),
    ("v", f"SELECT *, {roll_sql('stddev_samp', 'daily_return', 5)} AS volatility FROM r"),
    ("f", FEATURES_SQL),
)


@query("ticker_feature_summary", sql("bars", *FEATURE_STEPS, """SELECT ticker, count(*) AS n_rows,
  round(avg(volatility), 6) AS mean_volatility, round(avg(CASE WHEN gap > 0 THEN 1.0 ELSE 0.0 END), 6) AS up_share,
  round(corr(volatility_lag1, CASE WHEN gap > 0 THEN 1 ELSE 0 END), 6) AS corr_volatility_movement
  FROM f WHERE pos > 7 GROUP BY ticker"""))
def ticker_feature_summary(spark, sf):
    df = windows.baseline_features(views.bars(spark, sf), BY, ORDER)
    return df.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("volatility"), 6).alias("mean_volatility"),
        F.round(F.avg("movement"), 6).alias("up_share"),
        F.round(F.corr("volatility_lag1", F.col("movement").cast("double")), 6).alias("corr_volatility_movement"))


@query("baseline_features", sql("bars", *FEATURE_STEPS, """SELECT ticker, dt, open, close, high, volume,
  round(daily_return, 4) AS daily_return, round(volatility, 4) AS volatility, CASE WHEN gap > 0 THEN 1 ELSE 0 END AS movement,
  close_lag1, high_lag1, volume_lag1, round(daily_return_lag1, 4) AS daily_return_lag1, round(volatility_lag1, 4) AS volatility_lag1
  FROM f WHERE pos > 7"""))
def baseline_features(spark, sf):
    df = windows.baseline_features(views.bars(spark, sf), BY, ORDER)
    return rounded(df, "daily_return", "volatility", "daily_return_lag1", "volatility_lag1", digits=4)


@query("movement_label", sql("bars", f"""SELECT ticker, dt, movement FROM (SELECT ticker, dt,
  CASE WHEN open / lag(close) {W} - 1 > 0 THEN 1 ELSE 0 END AS movement, lag(close) {W} AS before FROM bars)
  WHERE before IS NOT NULL"""))
def movement_label(spark, sf):
    return windows.movement_label(views.bars(spark, sf), BY, ORDER).select("ticker", "dt", "movement")


@query("movement_return", sql("bars", f"""SELECT * FROM (SELECT ticker, dt, round(lead(open) {W} / close - 1, 6) AS movement
  FROM bars) WHERE movement IS NOT NULL"""))
def movement_return(spark, sf):
    return rounded(windows.movement_return(views.bars(spark, sf), BY, ORDER).select("ticker", "dt", "movement"), "movement")


LAG_COLS = ["open", "close", "high", "volume"]
LAGS_SQL = ", ".join(f"lag({c}, {k}) {W} AS {c}_lag{k}" for c in LAG_COLS for k in (1, 2, 3))


@query("lag_features", sql("bars", f"SELECT ticker, dt, {LAGS_SQL} FROM bars"))
def lag_features(spark, sf):
    df = windows.add_lags(views.bars(spark, sf), LAG_COLS, [1, 2, 3], BY, ORDER)
    return df.drop(*LAG_COLS)


@query("lead_open", sql("bars", f"SELECT ticker, dt, lead(open) {W} AS next_open FROM bars"))
def lead_open(spark, sf):
    return views.bars(spark, sf).select("ticker", "dt", windows.lead_of("open", BY, ORDER).alias("next_open"))


@query("pct_change", sql("bars", f"SELECT ticker, dt, round(100 * (close / lag(close) {W} - 1), 4) AS daily_return FROM bars"))
def pct_change(spark, sf):
    return views.bars(spark, sf).select(
        "ticker", "dt", F.round(100 * windows.pct_change("close", BY, ORDER), 4).alias("daily_return"))


ROLL_COLS = ["open", "close", "high", "volume"]
ROLL_SQL = ", ".join([f"round({roll_sql('avg', c, n)}, 4) AS {c}_mean{n}" for c in ROLL_COLS for n in (3, 5, 7, 14)]
                     + [f"round({roll_sql('stddev_samp', c, n)}, 4) AS {c}_std{n}" for c in ROLL_COLS for n in (7, 10, 21)])


@query("rolling_features", sql("bars", f"SELECT ticker, dt, {ROLL_SQL} FROM bars"))
def rolling_features(spark, sf):
    df = windows.rolling_table(views.bars(spark, sf), ROLL_COLS, [3, 5, 7, 14], [7, 10, 21], BY, ORDER).drop(*ROLL_COLS)
    return rounded(df, *[c for c in df.columns if c not in ("ticker", "dt")], digits=4)


@query("drop_burn_in", sql("bars", f"""SELECT ticker, dt, close FROM (SELECT *, row_number() {W} AS pos FROM bars)
  WHERE pos > 12"""))
def drop_burn_in(spark, sf):
    return windows.drop_burn_in(views.bars(spark, sf), 12, BY, ORDER).select("ticker", "dt", "close")


@query("daily_returns", sql("bars", f"""SELECT ticker, dt, round(ln(close / open), 6) AS log_return_daily,
  round(ln(lead(open) {W} / close), 6) AS log_return_overnight, round((close - open) / open, 6) AS intraday_return,
  round((lead(open) {W} - close) / close, 6) AS overnight_return, round((high - open) / open, 6) AS daily_volatility,
  round(ln(close / lag(close) {W}), 6) AS log_return FROM bars"""))
def daily_returns(spark, sf):
    df = windows.daily_returns(views.bars(spark, sf), BY, ORDER).drop("open", "close", "high", "volume")
    return rounded(df, *df.columns[2:])


@query("gap_moves", sql("bars", f"""SELECT ticker, dt, round(open - lag(close) {W}, 4) AS movement_open_close_lag,
  round(close - lag(close) {W}, 4) AS movement_close_close_lag FROM bars"""))
def gap_moves(spark, sf):
    df = windows.gap_moves(views.bars(spark, sf), BY, ORDER).drop("open", "close", "high", "volume")
    return rounded(df, *df.columns[2:], digits=4)


@query("rolling_moves", sql("bars", ("g", f"""SELECT ticker, dt, open - lag(close) {W} AS oc,
  close - lag(close) {W} AS cc FROM bars"""), f"""SELECT ticker, dt, round({roll_sql('avg', 'oc', 7)}, 4) AS oc_mean7,
  round({roll_sql('avg', 'oc', 14)}, 4) AS oc_mean14, round({roll_sql('avg', 'cc', 7)}, 4) AS cc_mean7,
  round({roll_sql('avg', 'cc', 14)}, 4) AS cc_mean14 FROM g"""))
def rolling_moves(spark, sf):
    df = windows.gap_moves(views.bars(spark, sf), BY, ORDER).select(
        "ticker", "dt", F.col("movement_open_close_lag").alias("oc"), F.col("movement_close_close_lag").alias("cc"))
    df = windows.rolling_table(df, ["oc", "cc"], [7, 14], [], BY, ORDER).drop("oc", "cc")
    return rounded(df, *df.columns[2:], digits=4)


@query("range_interaction", sql("bars", """SELECT ticker, dt,
  round(((close - open) / open) * ((high - open) / open), 6) AS return_range FROM bars"""))
def range_interaction(spark, sf):
    df = windows.daily_returns(views.bars(spark, sf), BY, ORDER)
    df = windows.interaction(df, "intraday_return", "daily_volatility", "return_range")
    return rounded(df.select("ticker", "dt", "return_range"), "return_range")


@query("prev_distinct_date", sql("news", """SELECT dt, lag(dt) OVER (ORDER BY dt) AS prev_dt
  FROM (SELECT DISTINCT dt FROM news)"""))
def prev_distinct_date(spark, sf):
    return windows.prev_distinct_date(views.news(spark, sf), [], "dt")


LEVEL_STEPS = (
    ("r", f"SELECT ticker, dt, close, close / lag(close) {W} - 1 AS returns FROM bars"),
    ("v", f"SELECT * FROM (SELECT *, {roll_sql('stddev_samp', 'returns', 21)} AS volatility FROM r) WHERE volatility IS NOT NULL"),
    ("q", "SELECT quantile_cont(volatility, 0.25) AS lo, quantile_cont(volatility, 0.75) AS hi FROM v"),
    ("l", """SELECT v.*, CASE WHEN volatility >= hi THEN 'High' WHEN volatility <= lo THEN 'Low' ELSE 'Medium' END
       AS volatility_level FROM v, q"""),
)


@query("volatility_levels", sql("bars", *LEVEL_STEPS,
       "SELECT ticker, dt, round(volatility, 6) AS volatility, volatility_level FROM l"))
def volatility_levels(spark, sf):
    df = windows.rolling_volatility(views.bars(spark, sf), BY, ORDER)
    return rounded(df.select("ticker", "dt", "volatility", "volatility_level"), "volatility")


@query("volatility_level_counts", sql("bars", *LEVEL_STEPS,
       "SELECT volatility_level, count(*) AS n FROM l GROUP BY 1"))
def volatility_level_counts(spark, sf):
    df = windows.rolling_volatility(views.bars(spark, sf), BY, ORDER)
    return df.groupBy("volatility_level").agg(F.count(F.lit(1)).alias("n"))


@query("top_volatile_days", sql("bars", *LEVEL_STEPS, """SELECT * FROM (
  (SELECT volatility_level, ticker, dt, close, round(volatility, 6) AS volatility FROM l WHERE volatility_level = 'High'
   ORDER BY l.volatility DESC, dt, ticker LIMIT 10) UNION ALL
  (SELECT volatility_level, ticker, dt, close, round(volatility, 6) AS volatility FROM l WHERE volatility_level = 'Low'
   ORDER BY l.volatility, dt, ticker LIMIT 10))"""))
def top_volatile_days(spark, sf):
    df = windows.rolling_volatility(views.bars(spark, sf), BY, ORDER).select(
        "volatility_level", "ticker", "dt", "close", "volatility")
    high = columns.regime(df, "High").orderBy(F.desc("volatility"), "dt", "ticker").limit(10)
    low = columns.regime(df, "Low").orderBy("volatility", "dt", "ticker").limit(10)
    return rounded(high.unionByName(low), "volatility")


@query("select_bars", sql("bars", """SELECT ticker AS stock, dt AS date, open, close FROM bars
  WHERE ticker = '2-HIGH' AND dt >= DATE '1996-01-01' AND dt < DATE '1999-01-01'"""))
def select_bars(spark, sf):
    df = columns.filter_ticker(views.bars(spark, sf), "2-HIGH")
    df = columns.clip_dates(df, "1996-01-01", "1999-01-01")
    return columns.rename(columns.drop_present(df, ["high", "volume", "not_there"]), {"ticker": "stock", "dt": "date"})


@query("truncate_cents", sql("bars", """SELECT ticker, dt, CAST(CAST(trunc(open * 100) AS BIGINT) AS DOUBLE) / 100 AS open,
  CAST(CAST(trunc((close - open) * 100) AS BIGINT) AS DOUBLE) / 100 AS move FROM bars"""))
def truncate_cents_query(spark, sf):
    return views.bars(spark, sf).select(
        "ticker", "dt", truncate_cents("open").alias("open"),
        truncate_cents(F.col("close") - F.col("open")).alias("move"))


@query("null_profile", sql("bars", ("g", f"SELECT dt, lag(close) {W} AS close_lag1, lag(close, 3) {W} AS close_lag3 FROM bars"),
       """SELECT 'dt' AS column_name, count(*) FILTER (WHERE dt IS NULL) AS nulls FROM g UNION ALL
  SELECT 'close_lag1', count(*) FILTER (WHERE close_lag1 IS NULL) FROM g UNION ALL
  SELECT 'close_lag3', count(*) FILTER (WHERE close_lag3 IS NULL) FROM g"""))
def null_profile(spark, sf):
    df = windows.add_lags(views.bars(spark, sf), ["close"], [1, 3], BY, ORDER)
    return columns.null_profile(df.select("dt", "close_lag1", "close_lag3"))


@query("drop_missing", sql("bars", f"""SELECT * FROM (SELECT ticker, dt, lag(close, 2) {W} AS close_lag2,
  lead(open) {W} AS next_open FROM bars) WHERE close_lag2 IS NOT NULL AND next_open IS NOT NULL"""))
def drop_missing(spark, sf):
    df = windows.add_lags(views.bars(spark, sf), ["close"], [2], BY, ORDER)
    df = df.select("ticker", "dt", "close_lag2", windows.lead_of("open", BY, ORDER).alias("next_open"))
    return columns.drop_missing(df, ["close_lag2", "next_open"])


@query("latest_bars", sql("bars", "SELECT dt, ticker, close FROM bars ORDER BY dt DESC, ticker DESC LIMIT 20"))
def latest_bars(spark, sf):
    df = views.bars(spark, sf).select("dt", "ticker", "close")
    return columns.first_rows(df, ["dt", "ticker"], 20, ascending=False)


@query("sorted_bars", sql("bars", "SELECT dt, ticker, close FROM bars ORDER BY dt DESC, ticker DESC"))
def sorted_bars(spark, sf):
    return columns.sort_by(views.bars(spark, sf).select("dt", "ticker", "close"), ["dt", "ticker"], ascending=False)


@query("coerce_numbers", """SELECT event_id, TRY_CAST(trim(regexp_extract(props, ':\\s*(.*)\\}', 1)) AS DOUBLE) AS k,
  TRY_CAST(trim(event_type) AS DOUBLE) AS bad, CASE WHEN value > 50 THEN 1 ELSE 0 END AS above FROM events""")
def coerce_numbers(spark, sf):
    events = views.table(spark, sf, "events")
    return events.select("event_id", to_number(F.regexp_extract("props", r":\s*(.*)\}", 1)).alias("k"),
                         to_number("event_type").alias("bad"), up_flag(F.col("value") - 50).alias("above"))
