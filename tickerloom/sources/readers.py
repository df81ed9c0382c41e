"""Readers with explicit schemas; nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tickerloom.functions.dates import to_date
from tickerloom.functions.numbers import to_number
from tickerloom.operators.columns import drop_index_col

PRICES = "`Date` string, `Open` string, `Close` string, `High` string, `Volume` string"
INDEX_NEWS = "`Time` string, `Title` string, `Tag` string, `Content` string"
TICKER_NEWS = "`title` string, `date` string, `stock` string"
PHRASES = "`Sentence` string, `Sentiment` string"
PREDICTIONS = "Date string, Fold int, Daily_Return double, Daily_Return_lag1 double, Ground_Truth string, Model_Prediction string"
FOLD_VOLATILITY = "Fold int, Date date, RollingVolatility double"


def read_csv(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Text with a header line. The columns of the file are matched to the schema by name,
    so an unnamed index column or a different column order does no harm."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", multi_line)
    found = drop_index_col(reader.csv(path).withColumnsRenamed({"_c0": "Unnamed: 0"}))
    wanted = spark.createDataFrame([], schema).dtypes
    present = {c.lower(): c for c in found.columns}
    cols = [(F.col(f"`{present[n.lower()]}`") if n.lower() in present else F.lit(None)).try_cast(t).alias(n) for n, t in wanted]
    return found.select(*cols)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars: dt, open, close, high, volume; unreadable numbers become NULL."""
    raw = read_csv(spark, path, PRICES)
    return raw.select(to_date(F.substring_index("Date", " ", 1)).alias("dt"),
                      *[to_number(c).alias(c.lower()) for c in ("Open", "Close", "High")],
                      to_number("Volume").cast("bigint").alias("volume"))


def read_news(spark: SparkSession, path: str, day_first: bool = False, scored: bool = False) -> DataFrame:
    """Index articles with texts over several lines; `scored` adds the stored sentiment score."""
    schema = INDEX_NEWS + (", sentiment_score string" if scored else "")
    raw = read_csv(spark, path, schema, multi_line=True)
    out = raw.select(to_date("Time", day_first).alias("dt"), F.col("Title").alias("title"), F.col("Tag").alias("tag"),
                     F.col("Content").alias("content"), *(["sentiment_score"] if scored else []))
    return out.withColumn("sentiment_score", to_number("sentiment_score")) if scored else out


def read_ticker_news(spark: SparkSession, path: str) -> DataFrame:
    """Ticker articles: title, stock, and the day in front of the time stamp."""
    raw = read_csv(spark, path, TICKER_NEWS, multi_line=True)
    return raw.select("title", F.col("stock").alias("ticker"), to_date(F.substring_index("date", " ", 1)).alias("dt"))


def read_phrases(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, PHRASES, multi_line=True).select(
        F.col("Sentence").alias("sentence"), F.lower(F.trim("Sentiment")).alias("sentiment"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; labels that are no numbers become NULL."""
    raw = spark.read.schema(PREDICTIONS).json(path)
    return raw.select(F.to_date(F.substring("Date", 1, 10)).alias("dt"), F.col("Fold").alias("fold"),
                      F.col("Daily_Return").alias("ret"), F.col("Daily_Return_lag1").alias("daily_return_lag1"),
                      to_number("Ground_Truth").cast("int").alias("y_true"),
                      to_number("Model_Prediction").cast("int").alias("y_pred"))


def read_fold_volatility(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path, FOLD_VOLATILITY)
    return raw.select(F.col("Fold").alias("fold"), F.col("Date").alias("dt"), F.col("RollingVolatility").alias("rolling_volatility"))
