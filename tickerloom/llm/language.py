"""Language identification by rank-order profiles of frequent letter n-grams."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tickerloom.llm.arrow import BLOCK_BYTES, blocks_of, kept_columns, map_batches, text_bytes

#: Length of a profile, longest n-gram, and about how many training documents of a language are read.
PROFILE, ORDER, SAMPLE = 400, 3, 2000
#: More languages than this are refused, so that the profiles stay small enough to send around.
MAX_LANGUAGES = 1000
BITS = 21
UNKNOWN = "und"


@cache
def letters() -> np.ndarray:
    """Lower-case code point of each letter, a space for all other code points."""
    table = np.full(0x110000, 0x20, np.int64)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def letter_codes(data: np.ndarray) -> np.ndarray:
    """Letters of a text with one space around each run of letters."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    codes = np.concatenate([[0x20], letters()[points], [0x20]])
    blank = codes == 0x20
    return codes[~(blank & np.concatenate([[False], blank[:-1]]))]


def gram_counts(data: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams of 1 to `order` letters; long texts are counted in blocks."""
    seen: list[tuple[np.ndarray, np.ndarray]] = []
    lo = 0
    while lo < len(data):
        hi = min(lo + BLOCK_BYTES, len(data))
        while hi < len(data) and data[hi] & 0xC0 == 0x80:  # not inside a code point
            hi += 1
        codes = letter_codes(data[lo:hi])
        grams, packed = [codes[codes != 0x20]], codes
        for n in range(2, order + 1):
            packed = (packed[:-1] << BITS) | codes[n - 1:]
            grams.append(packed[packed != (0x20 << BITS | 0x20)])
        seen.append(np.unique(np.concatenate(grams), return_counts=True))
        lo = hi
    if not seen:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(seen) == 1:
        return seen[0]
    codes, where = np.unique(np.concatenate([s[0] for s in seen]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([s[1] for s in seen])).astype(np.int64)


def top_grams(data: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by code."""
    codes, counts = gram_counts(data)
    return codes[np.argsort(-counts, kind="stable")[:length]]


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                   length: int = PROFILE, sample: int = SAMPLE) -> dict[str, list[int]]:
    """Profile of each language: its most frequent n-grams, most frequent first.

    About `sample` documents of each language are read, chosen by a hash of the id; fewer if the
    language has fewer. Rows without a language are left out.
    """
    rows = labelled.where(F.col(lang_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("__lang")).agg(F.count(F.lit(1)).alias("__n"))
    langs = sizes.limit(MAX_LANGUAGES + 1).collect()
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return {}
    share = F.create_map(*[x for r in langs for x in (F.lit(r["__lang"]), F.lit(min(1.0, sample / r["__n"])))])
    draw = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(draw < F.element_at(share, F.col(lang_col))).select(
        F.col(lang_col).alias("__lang"), F.col(text_col).alias("__text"))

    def count(batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column(1))
        names = np.array(batch.column(0).to_pylist(), dtype=object)
        for lang in sorted(set(names)):
            found = [gram_counts(data[offsets[i]:offsets[i + 1]]) for i in np.flatnonzero(names == lang)]
            codes, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([f[1] for f in found]), len(codes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])

    totals = map_batches(chosen, count, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    best = totals.withColumn("rank", rank).where(F.col("rank") <= length).orderBy("lang", "rank").collect()
    profiles: dict[str, list[int]] = {r["__lang"]: [] for r in langs}
    for r in best:
        profiles[r["lang"]].append(r["code"])
    return dict(sorted(profiles.items()))


def identify(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text", keep: Sequence[str] = ("doc_id",),
             length: int = PROFILE) -> DataFrame:
    """The kept columns with lang_pred, score and is_text per row.

    The n-grams of the whole text are ranked by frequency. A profile's distance is the sum of the
    differences between its ranks and the document's, `length` for an n-gram that it lacks. The
    least distance wins, ties go to the name that sorts first, and score is one minus the
    distance's share of the largest possible one.

    A NULL text, a text without letters, or no profiles at all give `und` and score 0. Rows with
    equal ids are judged each by itself. Input columns named like result columns are replaced.
    """
    results = ["lang_pred", "score", "is_text"]
    keep = kept_columns(docs, keep, results)
    names = list(profiles)
    grams = np.unique(np.array([c for p in profiles.values() for c in p[:length]], np.int64))
    ranks = np.full((len(names), len(grams) + 1), length, np.int64)
    for k, name in enumerate(names):
        own = np.array(profiles[name][:length], np.int64)
        ranks[k, np.searchsorted(grams, own)] = np.arange(len(own))

    def best(data: np.ndarray) -> tuple[str, float, bool]:
        top = top_grams(data, length)
        if not len(top):
            return UNKNOWN, 0.0, False
        if not len(grams):
            return UNKNOWN, 0.0, True
        at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
        found = ranks[:, np.where(grams[at] == top, at, len(grams))]
        away = np.where(found < length, np.abs(found - np.arange(len(top))), length).sum(axis=1)
        k = int(np.argmin(away))
        return names[k], 1.0 - float(away[k]) / (length * len(top)), True

    def work(batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column(text_at))
        for first, last in blocks_of(offsets):
            found = [best(data[offsets[i]:offsets[i + 1]]) for i in range(first, last)]
            lang, score, text = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(first, last - first) for c in range(len(keep))),
                 pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(text, pa.bool_())], names=[*keep, *results])

    # A kept text is sent once.
    rows = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias("__text"))
    text_at = keep.index(text_col) if text_col in keep else len(keep)
    fields = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("is_text", BooleanType())]
    return map_batches(rows, work, StructType([*rows.select(*keep).schema.fields, *fields]))
