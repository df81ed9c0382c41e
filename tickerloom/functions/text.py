"""Text cleaning as column expressions; all of them act on the whole text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tickerloom.functions.numbers import col

# ---- fixed values: patterns and words that decide the result ----
TRAILING_DATE = r"(\d+\s+days\s+ago|20\d{2}(?:-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d+)?)?)?)$"
TAG = r"<[^>\n]*>"
NON_ASCII = r"[^\x00-\x7F]+"
BLANKS = r"[ \t\n\r\x0B\f\x1C-\x1F]+"
SENTENCE_END = r"(?<=[.!?])[ \t\n\r\x0B\f\x1C-\x1F]+"
NOT_WORD = r"[^\p{L}\p{N}_]+"
PUNCTUATION = r"[^\p{L}\p{N}_\s]"
ENGLISH_STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
he him his himself she she's her hers herself it it's its itself they them their theirs themselves
what which who whom this that that'll these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about
against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other
some such no nor not only own same so than too very s t can will just don don't should should've
now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn
hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn
shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
# ---- end of fixed values ----


def strip_blanks(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def strip_trailing_date(c: Column | str) -> Column:
    """Drop a date remark ('3 days ago', a year, an ISO stamp) from the end of a text."""
    return strip_blanks(F.regexp_replace(col(c), TRAILING_DATE, ""))


def collapse_blanks(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), BLANKS, " "))


def clean_text(c: Column | str, lower: bool = False) -> Column:
    """Remove tags, replace non-ASCII runs by a blank, collapse white space."""
    text = F.regexp_replace(F.regexp_replace(col(c), TAG, ""), NON_ASCII, " ")
    return collapse_blanks(F.lower(text) if lower else text)


def dedupe_sentences(c: Column | str) -> Column:
    """Keep the first of each exactly repeated sentence."""
    parts = F.transform(F.split(col(c), SENTENCE_END), lambda s: F.trim(s))
    return F.array_join(F.array_distinct(parts), " ")


def normalise_text(c: Column | str, stop_words: list[str] | None = None) -> Column:
    """Lower case, no punctuation, single blanks, no stop words."""
    stops = ENGLISH_STOP_WORDS if stop_words is None else stop_words
    bare = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), PUNCTUATION, "")
    words = F.split(strip_blanks(bare), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(stops)), " ")


def words_of(c: Column | str) -> Column:
    """Array of the lower-case words made of the letters a to z only."""
    return F.filter(F.split(F.lower(col(c)), NOT_WORD), lambda w: w.rlike("^[a-z]+$"))


def blank_tokens(c: Column | str) -> Column:
    """Tokens between white space."""
    return F.filter(F.split(col(c), r"\s+"), lambda w: w != "")
