"""Prompts per test date, answers of a text model, prediction log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from tickerloom.functions import prompts
from tickerloom.operators import folds, joins, rollup, vectors, windows
from tickerloom.session import durable

# Columns of the rows behind the named fields of a prompt.
FIELD_COLUMNS = dict(zip(prompts.PROMPT_FIELDS, [
    "open", "sentiment_volatility_lag1", "aggregate_sentiment_score_lag1", "close_lag1", "high_lag1", "volume_lag1",
    "daily_return_lag1", "volatility_lag1"]))


def test_dates(articles: DataFrame, k: int = folds.FOLDS, unit: str = "row") -> DataFrame:
    """First non-NULL value per column and date within each test fold.

    Long texts stay out of it: previous-day news is joined afterwards, once per date.
    """
    numbered = folds.time_series_folds(articles, k, "dt", "news_id", unit=unit).where(F.col("fold").isNotNull())
    cols = ["movement", "daily_return", *windows.SENTIMENT_FEATURES]
    return rollup.first_per_date(numbered, ["fold", "dt"], cols, "news_id")


def prompt_table(articles: DataFrame, k: int = folds.FOLDS, shots: int = 2, unit: str = "row") -> DataFrame:
    """One prompt per test date. The rows are read several times, so they are checkpointed without their texts."""
    rows = durable(articles.withColumn("has_text", joins.has_text("cleaned_content")).drop("cleaned_content", "title"))
    texts = articles.select("dt", "news_id", "cleaned_content")
    earlier = joins.asof_prev_text(texts, "cleaned_content", "news_id", marks=rows)
    rows = test_dates(rows, k, unit).join(earlier.drop("prev_dt"), "dt")
    return rows.withColumn("prompt", prompts.build_prompt(FIELD_COLUMNS, "prev_day_news", shots)).drop("prev_day_news")


def predict(table: DataFrame, client: Callable[[], Callable[[list[str]], list[str]]], shots: int = 2) -> DataFrame:
    """Prediction log with the status of each answer; unreadable answers count as up."""
    asked = vectors.score_prompts(table, "prompt", client)
    word = asked.withColumn("_word", prompts.parse_answer(prompts.strip_echo("output", "prompt"), shots))
    return word.select("dt", "fold", F.col("daily_return").alias("ret"), "daily_return_lag1",
                       F.col("movement").alias("y_true"), prompts.answer_label("_word").alias("y_pred"),
                       prompts.answer_status("_word").alias("status"))
