"""Time-series features: lags, rolling statistics, returns and labels.

Input is one row per (series, date), so a window partition is bounded by the calendar
(about 250 rows a year), however many raw rows a day or a ticker had before the roll-up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tickerloom.functions.numbers import col, ratio, up_flag
from tickerloom.operators.ordering import exact_quantiles
from tickerloom.session import durable

# Window sizes, lags and names of the standard feature tables.
RETURN_WINDOW = 5
LEVEL_WINDOW = 21
BASE_FEATURES = ["open", "close_lag1", "high_lag1", "volume_lag1", "daily_return_lag1", "volatility_lag1"]
SENTIMENT_FEATURES = BASE_FEATURES + ["aggregate_sentiment_score_lag1", "sentiment_volatility_lag1"]
GARCH_LAGS = (1, 2, 3, 5, 7)
GARCH_WINDOWS = (3, 5, 7)


def series(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def last_rows(by: Sequence[str], order: Sequence[str], n: int) -> WindowSpec:
    return series(by, order).rowsBetween(-(n - 1), 0)


def add_lags(df: DataFrame, cols: Sequence[str], lags: Sequence[int], by: Sequence[str],
             order: Sequence[str]) -> DataFrame:
    w = series(by, order)
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in cols for k in lags})


def lead_of(c: str, by: Sequence[str], order: Sequence[str]) -> Column:
    return F.lead(c, 1).over(series(by, order))


def pct_change(c: str, by: Sequence[str], order: Sequence[str]) -> Column:
    return ratio(col(c), F.lag(c, 1).over(series(by, order))) - 1


def gap_return(by: Sequence[str], order: Sequence[str]) -> Column:
    """Open against the close of the row before."""
    return ratio(col("open"), F.lag("close", 1).over(series(by, order))) - 1


def movement_label(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """movement = 1 when the row opens above the previous close; first rows drop out."""
    gap = df.withColumn("_gap", gap_return(by, order)).where(F.col("_gap").isNotNull())
    return gap.withColumn("movement", up_flag("_gap")).drop("_gap")


def movement_return(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """movement = next open against this close, as a number; last rows drop out."""
    out = df.withColumn("movement", ratio(lead_of("open", by, order), col("close")) - 1)
    return out.where(F.col("movement").isNotNull())


def full_window(value: Column, c: Column | str, w: WindowSpec, n: int) -> Column:
    """A rolling value, NULL until n values are present."""
    return F.when(F.count(col(c)).over(w) == n, value)


def rolling_mean(c: str, n: int, by: Sequence[str], order: Sequence[str]) -> Column:
    w = last_rows(by, order, n)
    return full_window(F.avg(c).over(w), c, w, n)


def rolling_std(c: str, n: int, by: Sequence[str], order: Sequence[str]) -> Column:
    w = last_rows(by, order, n)
    return full_window(F.stddev_samp(c).over(w), c, w, n)


def rolling_table(df: DataFrame, cols: Sequence[str], means: Sequence[int], stds: Sequence[int],
                  by: Sequence[str], order: Sequence[str]) -> DataFrame:
    new = {f"{c}_mean{n}": rolling_mean(c, n, by, order) for c in cols for n in means}
    new |= {f"{c}_std{n}": rolling_std(c, n, by, order) for c in cols for n in stds}
    return df.withColumns(new)


def drop_burn_in(df: DataFrame, rows: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop the first rows of each series, where lags and rolling values are incomplete."""
    position = F.row_number().over(series(by, order))
    return df.withColumn("_pos", position).where(F.col("_pos") > rows).drop("_pos")


def daily_returns(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    next_open = lead_of("open", by, order)
    close_before = F.lag("close", 1).over(series(by, order))

    def log_ratio(a: Column, b: Column) -> Column:
        r = ratio(a, b)
        return F.when(r > 0, F.ln(r))

    return df.withColumns({
        "log_return_daily": log_ratio(col("close"), col("open")),
        "log_return_overnight": log_ratio(next_open, col("close")),
        "intraday_return": ratio(col("close") - col("open"), col("open")),
        "overnight_return": ratio(next_open - col("close"), col("close")),
        "daily_volatility": ratio(col("high") - col("open"), col("open")),
        "log_return": log_ratio(col("close"), close_before),
    })


def gap_moves(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    before = F.lag("close", 1).over(series(by, order))
    return df.withColumns({"movement_open_close_lag": col("open") - before,
                           "movement_close_close_lag": col("close") - before})


def interaction(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.withColumn(name, col(a) * col(b))


def prev_distinct_date(df: DataFrame, by: Sequence[str], date_col: str) -> DataFrame:
    """One row per distinct date with the date before it."""
    days = df.select(*by, date_col).distinct()
    return days.withColumn("prev_dt", F.lag(date_col, 1).over(series(by, [date_col])))


def baseline_features(bars: DataFrame, by: Sequence[str], order: Sequence[str], sentiment: bool = False) -> DataFrame:
    """Label, returns, volatility and lag-1 features.

    Rows with a missing value drop out at each stage, and the next stage looks at the rows that are
    left, so a gap inside a series costs rows but leaves no NULL. At the head 7 rows drop out, or
    12 with sentiment. All stages share one partitioning and order.
    """
    df = bars.withColumn("_gap", gap_return(by, order)).where(F.col("_gap").isNotNull())
    df = df.withColumn("movement", up_flag("_gap")).drop("_gap")
    df = df.withColumn("daily_return", pct_change("close", by, order) * 100).where(F.col("daily_return").isNotNull())
    df = df.withColumn("volatility", rolling_std("daily_return", RETURN_WINDOW, by, order)).where(F.col("volatility").isNotNull())
    df = with_complete_lags(df, ["close", "high", "volume", "daily_return", "volatility"], by, order)
    if not sentiment:
        return df
    df = df.where(F.col("aggregate_sentiment_score").isNotNull())
    df = df.withColumn("sentiment_volatility", rolling_std("aggregate_sentiment_score", RETURN_WINDOW, by, order))
    df = df.where(F.col("sentiment_volatility").isNotNull())
    return with_complete_lags(df, ["aggregate_sentiment_score", "sentiment_volatility"], by, order)


def with_complete_lags(df: DataFrame, cols: Sequence[str], by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return add_lags(df, cols, [1], by, order).dropna(subset=[f"{c}_lag1" for c in cols])


def volatility_features(df: DataFrame, vol: str, resid: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Lags 1 to 3 of conditional volatility, and squared residual minus variance."""
    w = series(by, order)
    new = {f"lagged_volatility_{k}": F.lag(vol, k).over(w) for k in (1, 2, 3)}
    new["volatility_shocks"] = F.pow(col(resid), 2) - F.pow(col(vol), 2)
    return df.withColumns(new)


def garch_feature_table(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Lags and rolling means of conditional variance, volatility and residuals."""
    cols = ["garch_cond_variance", "garch_cond_volatility", "garch_residuals"]
    out = add_lags(df, cols, GARCH_LAGS, by, order)
    for n in GARCH_WINDOWS:
        out = out.withColumns({
            f"rolling_cond_variance_{n}": rolling_mean("garch_cond_variance", n, by, order),
            f"rolling_cond_volatility_{n}": rolling_mean("garch_cond_volatility", n, by, order),
            f"rolling_residuals_{n}": rolling_mean("garch_residuals", n, by, order)})
    names = ["rolling_cond_variance_3", "rolling_cond_volatility_3", "rolling_cond_variance_5",
             "rolling_cond_volatility_5"]
    return add_lags(out, names, [1], by, order)


def volatility_level(c: Column | str, low: Column, high: Column) -> Column:
    return F.when(col(c) >= high, "High").when(col(c) <= low, "Low").otherwise("Medium")


def rolling_volatility(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int = LEVEL_WINDOW) -> DataFrame:
    """Rolling standard deviation of returns and its High / Medium / Low level.

    Levels compare each row with the 25 % and 75 % quantiles of the whole table, which
    enter the plan as a scalar subquery. The table of volatilities is checkpointed, since
    the quantiles scan it several times.
    """
    out = df.withColumn("returns", pct_change("close", by, order))
    out = out.withColumn("volatility", rolling_std("returns", n, by, order)).where(F.col("volatility").isNotNull())
    return add_level(durable(out), "volatility")


def add_level(df: DataFrame, c: str) -> DataFrame:
    marks = exact_quantiles(df, [c], [0.25, 0.75])
    both = marks.select(F.struct("q0", "q1")).scalar()
    return df.withColumn("_marks", both).withColumn(
        "volatility_level", volatility_level(c, F.col("_marks.q0"), F.col("_marks.q1"))).drop("_marks")
