"""Numbers and text: market vectors from features and the previous day's articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tickerloom.functions.text import clean_text, dedupe_sentences
from tickerloom.operators import balance, columns, folds, garch, joins, metrics, models, rollup, scaling, vectors, windows
from tickerloom.session import durable, join_on, small_side

LABEL = "movement"
# The volatility features that may join the numbers.
GARCH_FEATURES = ["garch_cond_variance_lag1", "garch_cond_volatility_lag1", "garch_residuals_lag1",
                  "rolling_cond_volatility_3_lag1", "rolling_cond_volatility_5_lag1"]
NUMBERS_WITH_GARCH = windows.SENTIMENT_FEATURES + GARCH_FEATURES


def clean_articles(news: DataFrame, text: str = "content") -> DataFrame:
    return news.withColumn("cleaned_content", dedupe_sentences(clean_text(text)))


def garch_bars(bars: DataFrame) -> DataFrame:
    """Bars with conditional variance, volatility, residuals, their lags and rolling means."""
    returns = windows.daily_returns(bars, [], ["dt"]).select("dt", "log_return")
    fitted = garch.garch_fit(returns, "log_return", "dt").drop("series", "r")
    return joins.join_on_date(bars, windows.garch_feature_table(fitted, [], ["dt"]))


def article_table(bars: DataFrame, news: DataFrame, scores: DataFrame, garch_too: bool = False) -> DataFrame:
    """One row per (date, article): lagged features of the date, title and cleaned text."""
    daily = joins.join_pre_aggregated(bars, scores)
    daily = windows.baseline_features(daily, [], ["dt"], sentiment=True)
    keep = ["dt", LABEL, "daily_return", *windows.SENTIMENT_FEATURES]
    if garch_too:
        volatility = garch_bars(bars).select("dt", *GARCH_FEATURES)
        daily = columns.drop_missing(daily.join(volatility, "dt"), GARCH_FEATURES)
        keep += GARCH_FEATURES
    cleaned = clean_articles(news).select("dt", "news_id", "title", "cleaned_content")
    rows = joins.join_on_date(daily.select(*keep), cleaned)
    return columns.non_empty_text(rows, "cleaned_content")


def market_rows(articles: DataFrame, emb: DataFrame, size: int, fusion: bool = False, seed: int = 42,
                numbers: Sequence[str] = tuple(windows.SENTIMENT_FEATURES)) -> tuple[DataFrame, DataFrame]:
    """(article rows with a `vector_id` for their texts and numbers, market vector of each id, concatenated or fused).

    Vectors are averaged per date and moved to the next date before they meet the rows; numbers are scaled over all rows.
    Articles of a date have the same numbers as a rule, so a vector is made once for each date and set of numbers. The rows
    are checkpointed without their texts, which are cleaned only once.
    """
    numbers = list(numbers)
    articles = durable(articles.drop("title", "cleaned_content"))
    dated = articles.select("dt", "news_id").join(emb, ["dt", "news_id"])
    earlier = durable(joins.asof_prev_vector(dated, "emb", size))
    rows = joins.join_on_date(earlier.select("dt"), articles)
    kinds = durable(rows.select("dt", *numbers).distinct().withColumn("vector_id", F.monotonically_increasing_id()))
    ready = scaling.scale(kinds, numbers, rows).join(earlier, "dt")
    if not fusion:
        ready = vectors.market_vector(ready, numbers, "prev_day_embedding")
    else:
        packed = ready.withColumn("_numbers", F.array(*numbers))
        ready = vectors.fuse_vectors(packed, "_numbers", "prev_day_embedding", len(numbers), size, seed=seed)
    return join_on(rows, small_side(kinds), ["dt", *numbers]).drop(*numbers), ready.select("vector_id", "market_vector")


def evaluate(rows: DataFrame, market_vectors: DataFrame, split: str = "folds", k: int = folds.FOLDS,
             share: float = folds.TRAIN_SHARE) -> DataFrame:
    """Logistic regression on the result of `market_rows`: expanding folds, or one time or random hold-out."""
    rows = rows.withColumn("ret", F.col("daily_return"))
    if split == "folds":
        table = folds.time_series_folds(rows, k, "dt", "news_id")
    elif split == "time":
        table = folds.chrono_split(rows, share, "dt", "news_id")
    else:
        table = balance.stratified_split(rows, 1 - share, LABEL, "news_id")
    if split != "folds":
        table, k = table.withColumn("fold", F.when(F.col("part") == "test", 1)), 1
    scored = models.vector_folds_scored(table, market_vectors, "market_vector", LABEL, k, ["dt", "news_id", "fold", "ret"])
    return metrics.fold_report(scored, overall="fold_mean", auc="score")


def training_texts(tables: dict[str, tuple[DataFrame, DataFrame]], seed: int = 0) -> DataFrame:
    """(title, movement) of several tickers: news joined to the next day's bar, shuffled."""
    joined = [joins.offset_join(news, bars).select("news_id", "title", LABEL) for news, bars in tables.values()]
    return balance.shuffle_rows(rollup.union_tables(joined), "news_id", seed).select("title", LABEL)


