"""Line-first cleaning: rules per line, then a verdict on what is left of a document."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tickerloom.llm.arrow import kept_columns

WHITE = "\t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Windows of this many words are looked for twice in a text.
WINDOW = 5


@dataclass(frozen=True)
class LineRules:
    """What makes a line fail, and how much text a document may lose."""

    # Signs that end a sentence, perhaps followed by closing quotes or brackets.
    ending: str = r"[.!?…:;][\"'’”»)\]]*[ \t-\r]*\z"
    # A menu: at least so many separators, with at most so many characters for each.
    separators: str = "|»›•"
    min_separators: int = 2
    max_entry_chars: int = 40
    # Fixed phrases of notices and page furniture, in lower case.
    boilerplate: tuple[str, ...] = (
        "licensed under", "all rights reserved", "copyright (c)", "©", "terms of use", "terms of service",
        "privacy policy", "cookie", "javascript", "sign up", "subscribe", "click here", "read more", "lorem ipsum",
        "powered by")
    max_symbol_share: float = 0.1
    max_lost_share: float = 0.5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def drop_all(text: Column, signs: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), signs, text)


def words_of(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D."""
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), WHITE, text)
    return F.array_remove(F.split(plain, " "), "")


def lines_of(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda s: F.rlike(s, F.lit(r"[^ \t-\r]")))


def repeated_words(words: Column, width: int = WINDOW) -> Column:
    """How many words lie in a run of `width` words found twice or more, the first included.

    Windows are compared by 64-bit hashes. Texts without a repetition stop after a distinct
    count; the others sort (hash, position) pairs, so the work is n log n in the words.
    """
    last = F.size(words) - width

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(width)]))

    def covered(found: Column) -> Column:
        pairs = F.sort_array(F.arrays_zip(found.alias("h"), F.sequence(F.lit(0), last).alias("i")))
        return let(pairs, lambda p: let(positions(p), lambda at: F.aggregate(
            F.transform(at, lambda i, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - i, F.lit(width)))),
            F.lit(0), lambda a, b: a + b)))

    def positions(pairs: Column) -> Column:
        """Starts of the windows that have an equal one, in order."""
        def twice(x: Column, k: Column) -> Column:
            same = [F.get(pairs, F.when(k + d >= 0, k + d))["h"] == x["h"] for d in (-1, 1)]
            return F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False))
        return F.sort_array(F.transform(F.filter(pairs, twice), lambda x: x["i"]))

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(covered(found))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(last < 1, 0).otherwise(let(let(hashes, windows), count)).cast("bigint")


def line_fails(line: Column, rules: LineRules) -> Column:
    size = F.length(line)
    symbols = size - F.length(drop_all(line, SYMBOLS))
    marks = size - F.length(drop_all(line, rules.separators))
    menu = (marks >= rules.min_separators) & (size <= rules.max_entry_chars * (marks + 1))
    shouted = (F.upper(line) == line) & (F.lower(line) != line)
    notice = let(F.lower(line), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in rules.boilerplate]))
    return menu | (symbols > rules.max_symbol_share * size) | ~F.rlike(line, F.lit(rules.ending)) | shouted | notice


def clean_lines(docs: DataFrame, rules: LineRules | None = None, text_col: str = "text",
                keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns with clean_text, lost_chars, n_line_chars and enough per row.

    Lines end at \\n. Lines without a word are dropped and count for nothing. A line fails if it
    does not end like a sentence, looks like a menu, holds a phrase of a notice, has many symbols
    or has capitals only. clean_text holds the lines that pass. enough is false if the failed lines
    hold more than max_lost_share of the characters of all lines with words, or if no line is left.

    A NULL or empty text has an empty clean_text and is not enough. Rows with equal ids are judged each
    by itself. Input columns named like result columns are replaced. One row per input row.
    """
    rules = rules or LineRules()
    results = ["clean_text", "lost_chars", "n_line_chars", "enough"]
    keep = kept_columns(docs, keep, results)
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = lines_of(text)
    chars = F.aggregate("__lines", F.lit(0).cast("bigint"), lambda n, s: n + F.length(s))
    good = F.filter("__lines", lambda s: ~line_fails(s, rules))
    left = F.aggregate("__good", F.lit(0).cast("bigint"), lambda n, s: n + F.length(s))
    rows = docs.select(*keep, lines.alias("__lines")).select(*keep, "__lines", good.alias("__good"))
    rows = rows.select(*keep, "__good", chars.alias("n_line_chars"), left.alias("__left"))
    lost = F.col("n_line_chars") - F.col("__left")
    return rows.select(*keep, F.array_join("__good", "\n").alias("clean_text"), lost.alias("lost_chars"), "n_line_chars",
                       ((F.col("__left") > 0) & (lost <= rules.max_lost_share * F.col("n_line_chars"))).alias("enough"))


def base_counts(text: Column) -> dict[str, Column]:
    """Counts of words, their characters, symbols, repeated lines and repeated words of a text."""
    text = F.coalesce(text, F.lit(""))
    lines = lines_of(text)
    return {"word_chars": F.length(drop_all(text, " " + WHITE)).cast("bigint"),
            "n_symbols": (F.length(text) - F.length(drop_all(text, SYMBOLS))).cast("bigint"),
            "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("bigint")}
