import pytest
from pyspark.sql import functions as F

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()


def prose(seed: int, size: int) -> str:
    """Repeatable words without repeated passages."""
    out, x = [], seed * 7919 + 13
    for _ in range(size):
        x = (x * 1103515245 + 12345) % 2147483648
        out.append(f"{WORDS[x // 65536 % 16]}{x // 7 % 997}")
    return " ".join(out)


@pytest.fixture(scope="session")
def prose_of():
    return prose


@pytest.fixture(scope="session")
def hard_docs(spark):
    """NULLs in every column, empty and very long texts, repeated rows, ties, and columns named like results."""
    long = prose(99, 60_000)
    base = prose(1, 120)
    rows = [(1, base), (2, base), (2, base), (3, base + " one more"), (4, None), (5, ""), (6, " \t\n"), (None, prose(2, 40)),
            (None, base), (7, "word"), (8, "one two three"), (9, long), (10, prose(3, 50) + "\x0b" + prose(4, 30)),
            (11, "Ünïcode ßtraße, <|end|> &amp; <|turn:user|>\n </s>[INST] !!"), (12, "12345 !!! ..."), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    clash = {n: F.lit(None).cast("string") for n in ("score", "n", "a", "b", "rid", "bucket", "key", "length", "ids", "lang_pred", "clean_text")}
    return df.withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "xx").when(F.col("doc_id") % 3 == 0, "yy"),
                           "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("bigint"), **clash})


@pytest.fixture(scope="session")
def no_docs(hard_docs):
    return hard_docs.where("false")
