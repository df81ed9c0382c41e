"""Per-date aggregates of articles, duplicates and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.functions.numbers import col

CHUNK_IDS = 10_000


def daily_sentiment(news: DataFrame, score: str = "sentiment_score", by: Sequence[str] = ("dt",),
                    digits: int | None = None) -> DataFrame:
    """Sum of the scores per date; partial sums are formed before the shuffle."""
    total = F.coalesce(F.sum(score), F.lit(0.0))
    if digits is not None:
        total = F.round(total, digits)
    return news.groupBy(*by).agg(total.alias("aggregate_sentiment_score"))


def ordered_texts(df: DataFrame, by: Sequence[str], texts: Sequence[str], seq: str, sep: str) -> DataFrame:
    """Join the texts of each group with `sep`, in order of an integer sequence number.

    Two levels: articles are joined within ranges of CHUNK_IDS sequence numbers, which
    bounds a group whatever the size of a date, then the ranges are joined in order. The
    last step handles one string per range, i.e. only the resulting cell itself.
    """
    def join(ordered_by: str, c: str) -> Column:
        pairs = F.array_sort(F.collect_list(F.struct(F.col(ordered_by).alias("k"), F.col(c).alias("v"))))
        return F.array_join(F.transform(pairs, lambda p: p["v"]), sep)

    by = list(by)
    ranged = df.withColumn("_range", F.floor(F.try_divide(F.col(seq), F.lit(CHUNK_IDS))).cast("bigint"))
    pieces = ranged.groupBy(*by, "_range").agg(*[join(seq, c).alias(c) for c in texts])
    return pieces.groupBy(*by).agg(*[join("_range", c).alias(c) for c in texts])


def daily_rollup(df: DataFrame, seq: str, by: Sequence[str] = ("dt",), firsts: Sequence[str] = ("open", "close", "high"),
                 texts: Sequence[str] = ("title", "tag", "content"), volume: str = "sum") -> DataFrame:
    """One row per date: first prices, summed (or first) volume, texts joined by ', '."""
    by = list(by)
    volumes = F.sum("volume") if volume == "sum" else F.min_by("volume", seq)
    numbers = df.groupBy(*by).agg(*[F.min_by(c, seq).alias(c) for c in firsts], volumes.alias("volume"))
    return numbers.join(ordered_texts(df, by, texts, seq, ", "), by)


def panel_mean(df: DataFrame, c: str, by: Sequence[str] = ("dt",), scale: float = 100.0) -> DataFrame:
    """Mean over the panel per date, in percent."""
    return df.groupBy(*by).agg((F.avg(c) * scale).alias(c))


def mean_vector(df: DataFrame, by: Sequence[str], vector: str) -> DataFrame:
    """Element-wise mean per group; vectors are summed before the shuffle."""
    mean = Summarizer.mean(array_to_vector(col(vector).cast("array<double>")))
    return df.groupBy(*by).agg(vector_to_array(mean).alias(vector))


def first_per_date(df: DataFrame, by: Sequence[str], cols: Sequence[str], seq: str) -> DataFrame:
    """First non-NULL value of each column per group."""
    return df.groupBy(*by).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in cols])


def dedupe_articles(df: DataFrame, subset: Sequence[str], seq: str) -> DataFrame:
    """First row per distinct text.

    An aggregation, not a ranking window: copies collapse on the map side, so a text
    copied into a third of all rows reaches the reducer as one row per map task. The hash
    in front of the texts makes sorting cheap: texts are compared only when it is equal.
    """
    rest = [c for c in df.columns if c not in subset]
    packed = F.min(F.struct(F.col(seq).alias("_seq"), *[F.col(c) for c in rest]))
    return df.groupBy(F.xxhash64(*subset).alias("_hash"), *subset).agg(packed.alias("_row")).select(
        *[F.col(c) if c in subset else F.col(f"_row.{c}").alias(c) for c in df.columns])


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def distinct_dates(df: DataFrame, c: str = "dt") -> DataFrame:
    return df.select(c).distinct()


def union_tables(tables: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), tables)
