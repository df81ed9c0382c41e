"""Sentiment scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickerloom.functions.numbers import col

# Label codes of the labelled phrases.
LABEL_CODES = {"negative": 0, "neutral": 1, "positive": 2}


def sentiment_score(neg: Column | str, neu: Column | str, pos: Column | str) -> Column:
    """(pos - neg) * (1 - neu) to two decimals, with tiny scores set to 0.00."""
    raw = (col(pos) - col(neg)) * (1 - col(neu))
    return F.when(F.abs(raw) < 0.005, F.lit(0.0)).otherwise(F.round(raw, 2))


def score_text(score: Column | str) -> Column:
    """The two-decimal string form in which scores are stored."""
    return F.format_string("%.2f", col(score))


def label_code(c: Column | str) -> Column:
    """negative, neutral, positive to 0, 1, 2; other labels become NULL."""
    return F.coalesce(*[F.when(col(c) == label, F.lit(value)) for label, value in LABEL_CODES.items()])
