"""Joins of bars with articles: same date, shifted date, and strictly earlier date.

Tables with one row per date are small, and articles are not: small_side counts the rows of
the dated side, broadcasts it when it is small, so that articles are not shuffled, and
otherwise leaves a sort-merge join whose skewed dates adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions.prompts import NO_NEWS
from tickerloom.functions.vectors import zero_vector
from tickerloom.operators.rollup import daily_sentiment, mean_vector, ordered_texts
from tickerloom.operators.windows import prev_distinct_date
from tickerloom.session import durable, small_side


def join_on_date(bars: DataFrame, news: DataFrame, on: Sequence[str] = ("dt",)) -> DataFrame:
    """Inner join; a bar appears once per article of its date."""
    return news.join(small_side(bars), list(on), "inner")


def attach_aggregate(rows: DataFrame, aggregate: DataFrame, on: Sequence[str] = ("dt",)) -> DataFrame:
    """Bring a per-date aggregate back to the rows; rows without a match keep NULL."""
    return rows.join(small_side(aggregate), list(on), "left")


def join_pre_aggregated(bars: DataFrame, news: DataFrame, on: Sequence[str] = ("dt",)) -> DataFrame:
    """Sum the scores per date first, then join one row to one row."""
    return bars.join(daily_sentiment(news, by=on), list(on), "inner")


def attach_return(rows: DataFrame, bars: DataFrame, on: Sequence[str] = ("dt",),
                  cols: Sequence[str] = ("daily_return",)) -> DataFrame:
    return rows.join(small_side(bars.select(*on, *cols)), list(on), "inner")


def offset_join(news: DataFrame, bars: DataFrame, days: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """News of a day joined to the bar `days` calendar days later; other news drops out."""
    return news.withColumn("dt", F.date_add("dt", days)).join(small_side(bars), list(by) + ["dt"], "inner")


def asof_prev_rows(dates: DataFrame, news: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows of the latest strictly earlier date that has rows, in long form.

    Each date is paired with the date before it (one window over distinct dates), then
    joined on equality, so the work is linear in rows and no texts are gathered.
    """
    by = list(by)
    pairs = prev_distinct_date(dates, by, "dt").where(F.col("prev_dt").isNotNull())
    return news.withColumnRenamed("dt", "prev_dt").join(small_side(pairs), by + ["prev_dt"], "inner")


def has_text(text: str) -> Column:
    return F.col(text).isNotNull() & (F.col(text) != "")


def asof_prev_text(news: DataFrame, text: str, seq: str, by: Sequence[str] = (), marks: DataFrame | None = None) -> DataFrame:
    """Per date with news: all texts of the latest earlier date, joined by a blank.

    marks: the rows without their texts, but with `has_text`, for texts that are costly to make.
    """
    by = list(by)
    kept = news.where(has_text(text))
    pairs = latest_with_text(news.select(*by, "dt", has_text(text).alias("has_text")) if marks is None else marks, by)
    earlier = ordered_texts(kept, by + ["dt"], [text], seq, " ")
    joined = pairs.join(earlier.select(*by, F.col("dt").alias("prev_dt"), F.col(text).alias("prev_day_news")),
                        by + ["prev_dt"], "left")
    return joined.select(*by, "dt", "prev_dt", F.coalesce("prev_day_news", F.lit(NO_NEWS)).alias("prev_day_news"))


def latest_with_text(marks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each date with the latest strictly earlier date that has any text; groups with a NULL key have none."""
    by = list(by)
    known = reduce(and_, [F.col(c).isNotNull() for c in by], F.col("has_text"))
    days = marks.groupBy(*by, "dt").agg(F.max(F.when(known, F.col("dt"))).alias("_has"))
    before = Window.partitionBy(*by).orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    return days.select(*by, "dt", F.max("_has").over(before).alias("prev_dt"))


def asof_prev_vector(news: DataFrame, vector: str, size: int, by: Sequence[str] = ()) -> DataFrame:
    """Per date: mean vector of the latest earlier date; zeros for the first date."""
    by = list(by)
    means = durable(mean_vector(news, by + ["dt"], vector))  # has all dates, so the rows are read once
    pairs = prev_distinct_date(means, by, "dt")
    joined = pairs.join(means.withColumnRenamed("dt", "prev_dt"), by + ["prev_dt"], "left")
    return joined.select(*by, "dt", F.coalesce(vector, zero_vector(size)).alias("prev_day_embedding"))


def returns_for_rows(rows: DataFrame, returns: DataFrame, row_id: str = "row_id") -> DataFrame:
    return rows.join(returns, row_id, "inner")
