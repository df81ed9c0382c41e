"""Prompt text for next-day predictions, and reading of the answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickerloom.functions.numbers import col
from tickerloom.functions.text import strip_blanks

# ---- fixed values: wording of the prompts and markers of the answer ----
PROMPT_FIELDS = ["Open", "sentiment_volatility_lag1", "aggregate_sentiment_score_lag1", "Close_lag1",
                 "High_lag1", "Volume_lag1", "Daily_Return_lag1", "Volatility_lag1"]
NO_NEWS = "No previous news available"
ANSWER_MARKER = "<<<ANSWER_START>>>"
ANSWER_TAG = "</Answer/>:"
UP_EXAMPLE = (
    '<Numerical Data>: "Open: 4500; sentiment_volatility_lag1: 0; aggregate_sentiment_score_lag1: 2; '
    'Close_lag1: 4480; High_lag1: 4510; Volume_lag1: 345000000; Daily_Return_lag1: 0; Volatility_lag1: 0"\n'
    "<News Article>: Federal Reserve announces interest rate cut to boost economic growth.\n"
    "</Answer/>: up\n\n")
DOWN_EXAMPLE = (
    '<Numerical Data>: "Open: 3200; sentiment_volatility_lag1: 1; aggregate_sentiment_score_lag1: -1; '
    'Close_lag1: 3190; High_lag1: 3210; Volume_lag1: 280000000; Daily_Return_lag1: -5; Volatility_lag1: 0"\n'
    "<News Article>: Analysts warn of a market downturn amid global economic uncertainty.\n"
    "</Answer/>: down\n\n")
ZERO_SHOT_ORDER = (
    "Based on the numerical data and the news article from yesterday, determine if today’s stock will move 'up' or 'down'.\n"
    "Respond with exactly one word: either 'up' or 'down'. Do not include any additional text or echo any part of this prompt.\n\n")
SHOT_ORDER = (
    "Based on the numerical data and news article from yesterday, predict whether the stock will move 'up' or 'down' today.\n"
    "Respond with exactly one word ('up' or 'down') on a new line. Do not echo any part of this prompt or the above {examples}.\n"
    "Your answer should appear immediately after the marker below.\n\n")
HEADS = {
    0: ZERO_SHOT_ORDER,
    1: "Example:\n" + UP_EXAMPLE + SHOT_ORDER.format(examples="example"),
    2: "Example 1:\n" + UP_EXAMPLE + "Example 2:\n" + DOWN_EXAMPLE + SHOT_ORDER.format(examples="examples"),
}
TAILS = {0: ANSWER_TAG, 1: ANSWER_MARKER, 2: ANSWER_MARKER}
ANSWER_AT_END = r"(?i)(up|down)\s*$"
ANSWER_AFTER_TAG = r"(?i)</Answer/>\s*:\s*(up|down)"
# ---- end of fixed values ----


def number_list(fields: dict[str, Column | str]) -> Column:
    """'name: whole number' parts joined by '; '; NULL fields are left out."""
    parts = [F.concat(F.lit(f"{name}: "), col(c).cast("double").cast("bigint").cast("string")) for name, c in fields.items()]
    return F.concat_ws("; ", *parts)


def build_prompt(fields: dict[str, Column | str], news: Column | str, shots: int = 2) -> Column:
    """Prompt with 0, 1 or 2 worked examples; numbers are cut to whole numbers."""
    return F.concat(F.lit(HEADS[shots]), F.lit('<Numerical Data>: "'), number_list(fields), F.lit('"\n<News Article>: '),
                    F.coalesce(col(news), F.lit(NO_NEWS)), F.lit("\n\n"), F.lit(TAILS[shots]))


def strip_echo(output: Column | str, prompt: Column | str) -> Column:
    """Remove the prompt when the model repeats it in front of its answer."""
    rest = F.substring(col(output), F.length(col(prompt)) + 1, F.length(col(output)))
    return strip_blanks(F.when(F.startswith(col(output), col(prompt)), rest).otherwise(col(output)))


def last_token(text: Column) -> Column:
    return F.lower(F.element_at(F.split(strip_blanks(text), r"\s+"), -1))


def first_match(*candidates: Column) -> Column:
    return F.coalesce(*[F.when(c.isin("up", "down"), c) for c in candidates])


def parse_answer(output: Column | str, shots: int = 2) -> Column:
    """'up', 'down' or NULL.

    With examples: the word at the end of the text after the last marker. Without: the word
    after the answer tag, else the last token.
    """
    text = col(output)
    if shots == 0:
        return first_match(F.lower(F.regexp_extract(text, ANSWER_AFTER_TAG, 1)), last_token(text))
    tail = strip_blanks(F.element_at(F.split(text, ANSWER_MARKER), -1))
    return first_match(F.lower(F.regexp_extract(tail, ANSWER_AT_END, 1)), last_token(tail))


def answer_label(word: Column | str) -> Column:
    """up to 1, down to 0; an unreadable answer counts as up."""
    return F.when(col(word) == "down", 0).otherwise(1)


def answer_status(word: Column | str) -> Column:
    return F.coalesce(col(word), F.lit("error"))


