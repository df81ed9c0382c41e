import pytest
from pyspark.sql import functions as F

from tickerloom.functions import prompts, sentiment, text
from tickerloom.functions.dates import next_business_days, to_date
from tickerloom.functions.numbers import to_number, truncate_cents


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("value, want", [
    ("Stocks fell. 3 days ago", "Stocks fell."), ("Up 2021", "Up"), ("A 2021-05-06", "A"),
    ("B 2021-05-06T10:00:00.5", "B"), ("In 2021 we", "In 2021 we"), ("1999", "1999"), ("  2020", "")])
def test_strip_trailing_date(spark, value, want):
    assert one(spark, text.strip_trailing_date("x"), value) == want


def test_clean_and_dedupe(spark):
    assert one(spark, text.clean_text("x"), "<p>Héllo\t <b>world</b>\n</p> ok") == "H llo world ok"
    assert one(spark, text.clean_text("x", lower=True), "<P>ABC</P>") == "abc"
    assert one(spark, text.dedupe_sentences("x"), "A b.  A b. C? A b. c?") == "A b. C? c?"
    assert one(spark, text.normalise_text("x"), "  The Market's UP, not down!  ") == "markets"
    assert one(spark, text.normalise_text("x"), None) == ""
    assert one(spark, text.words_of("x"), "Don't café x1 Plain") == ["don", "t", "plain"]


def test_sentiment(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.7), (0.2, 0.6, 0.2), (0.9, 0.05, 0.05)], "n double, u double, p double")
    got = [r[0] for r in df.select(sentiment.sentiment_score("n", "u", "p")).collect()]
    assert got == [0.48, 0.0, -0.81]
    assert one(spark, sentiment.label_code("x"), "positive") == 2 and one(spark, sentiment.label_code("x"), "odd") is None


@pytest.mark.parametrize("value, shots, want", [
    ("updown", 2, "down"), ("Up.", 2, None), ("", 2, None), ("", 0, None), ("UP  ", 2, "up"),
    ("<<<ANSWER_START>>> up <<<ANSWER_START>>> Down", 2, "down"), ("</Answer/>: Up today", 0, "up"),
    ("</Answer/> :down</Answer/>: up", 0, "down"), ("go down", 0, "down"), ("no idea", 0, None)])
def test_parse_answer(spark, value, shots, want):
    assert one(spark, prompts.parse_answer("x", shots), value) == want


def test_prompt(spark):
    df = spark.createDataFrame([(10.9, -1.7, None, "News")], "a double, b double, c double, n string")
    got = df.select(prompts.build_prompt({"Open": "a", "B": "b", "C": "c"}, "n", 0)).first()[0]
    assert got.endswith('<Numerical Data>: "Open: 10; B: -1"\n<News Article>: News\n\n</Answer/>:')
    few = df.select(prompts.build_prompt({"Open": "a"}, F.lit(None).cast("string"), 2)).first()[0]
    assert few.startswith("Example 1:\n") and "Example 2:\n" in few and few.endswith("<<<ANSWER_START>>>")
    assert "No previous news available" in few
    assert one(spark, prompts.strip_echo(F.concat(F.lit("q "), "x"), F.lit("q")), "up ") == "up"
    assert one(spark, prompts.answer_label(F.lit(None).cast("string")), "") == 1


def test_numbers_and_dates(spark):
    assert one(spark, truncate_cents("x"), -1.239, "double") == -1.23
    assert one(spark, to_number("x"), "abc") is None and one(spark, to_number("x"), " 2.5 ") == 2.5
    assert str(one(spark, to_date("x", day_first=True), "31/12/2020")) == "2020-12-31"
    days = one(spark, next_business_days(to_date("x"), 5), "2021-01-01")
    assert [str(d) for d in days] == ["2021-01-04", "2021-01-05", "2021-01-06", "2021-01-07", "2021-01-08"]
