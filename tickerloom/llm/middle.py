"""Fill-in-middle transformation: a repeated capture gives all unit ends of a text, and so its two cuts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tickerloom.llm.arrow import blocks_of, kept_columns, map_batches, text_bytes

#: A unit: a run of ASCII letters, or any other single code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those with a draw from this on stay plain; of the others, those with a draw below this put the suffix first.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
#: Code points of one match. The regex library keeps about 64 bytes for a repetition and gives up at some millions of them.
PIECE = 1 << 20
RESULTS = ["n", "form", "prefix_chars", "middle_chars", "output"]


@cache
def pattern() -> regex.Pattern:
    return regex.compile(f"({UNIT})*")


def unit_ends(text: str, piece: int = PIECE) -> Sequence[int]:
    """End of each unit of a text, in order.

    One fullmatch of (unit)* keeps all repetitions of its group. A text beyond `piece` code points is matched in
    pieces that end between two units.
    """
    match = pattern().fullmatch
    if len(text) <= piece:
        return match(text).ends(1)
    edge, found, start = regex.compile("(?<![A-Za-z])|(?![A-Za-z])"), [], 0
    while start < len(text):
        end = edge.search(text, min(start + piece, len(text))).start()
        found.append(np.array(match(text, start, end).ends(1), np.int64))
        start = end
    return np.concatenate(found)


def draws(key: str, salt: str = "1") -> tuple[int, int, int, int]:
    """Four numbers below 2**32 of a document: the first hex digits of sha256 of salt, a colon and the key."""
    digest = sha256(f"{salt}:{key}".encode()).hexdigest()
    return tuple(int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))


def transform(key: str, text: str, piece: int = PIECE) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output) of one text."""
    ends, (h1, h2, h3, h4) = unit_ends(text, piece), draws(key)
    n = len(ends)
    if not text or h3 % 100 >= PLAIN_FROM or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns with n, form, prefix_chars, middle_chars and output per row.

    A text is cut between units (UNIT, matched left to right over code points) in a prefix, a middle and a
    suffix. Cuts and form come from sha256 of "1:" and the decimal id, so they do not depend on the order of rows.
    output has a mark before each part; `restore` gives the text back. A text that is empty or
    holds a mark, and one of ten others, stays plain: output is the text, and the lengths are NULL.

    A NULL text counts as empty. A NULL id is drawn as if written as no digits. Rows with equal ids are cut each by
    itself with the same draws. Texts of any length are cut as a whole. An empty table gives no rows. Kept columns named
    like result columns are left out.
    """
    keep = kept_columns(docs, keep, RESULTS)
    rows = docs.select(*keep, F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("__key"), F.col(text_col).alias("__text"))

    def work(batch: pa.RecordBatch):
        keys, texts = batch.column(len(keep)), batch.column(len(keep) + 1)
        for first, last in blocks_of(text_bytes(texts)[1]):
            part = [transform(k, t or "") for k, t in zip(
                keys.slice(first, last - first).to_pylist(), texts.slice(first, last - first).to_pylist(), strict=True)]
            n, form, before, middle, output = zip(*part, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(first, last - first) for c in range(len(keep))), pa.array(n, pa.int64()),
                 pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())],
                names=[*keep, *RESULTS])

    kinds = [LongType(), StringType(), LongType(), LongType(), StringType()]
    return map_batches(rows, work, StructType([*rows.select(*keep).schema.fields,
                                               *(StructField(n, k) for n, k in zip(RESULTS, kinds, strict=True))]))


def restore(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output of a form was made from.

    Texts with a mark stay plain, and no end of a part makes up a mark together with the next mark's beginning, so
    the first mark of each kind, after the leading one, is the one that was put there.
    """
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    size = len(PREFIX)
    body = F.substr(output, F.lit(size + 1))
    inner = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    at, last = F.position(inner, body), F.position(F.lit(MIDDLE), body)
    head = F.substr(body, F.lit(1), at - 1)
    second = F.substr(body, at + size, last - at - size)
    middle = F.substr(body, last + size)
    return F.when(form == "plain", output).when(form == "spm", F.concat(second, middle, head)).otherwise(
        F.concat(head, middle, second))
