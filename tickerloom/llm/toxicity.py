"""Toxicity scores from two conditional Kneser-Ney models of letters, one for each class, with shared lower orders."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickerloom.llm.arrow import blocks_of, give_back, kept_columns, map_batches, stored, text_bytes
from tickerloom.llm.words import LOWER, mix
from tickerloom.session import checkpoint_ready, ship_package

#: Length of an n-gram in bytes (a byte and the bytes before it); six bytes fit into a bigint.
ORDER = 6
#: What is taken from every shared count and given to the lower order, and from every count of a class and given to
#: the shared model; a class hears of an n-gram only from its third occurrence on, since most rare ones are chance.
DISCOUNT, CLASS_DISCOUNT = 0.75, 2.0
#: The log ratio from which a word speaks for the toxic class.
MARGIN = 3.0
#: Different n-grams that a task holds before it writes them out, and histories and n-grams of a table that is sent at once, about.
FLUSH, TABLE_ROWS = 2_000_000, 6_000_000
#: Labelled rows that weigh the features against each other, at most about.
CALIBRATION = 20_000
#: Different bytes that a text can be made of, for the lowest order.
BYTES = 256
PLAIN = LOWER.copy()
PLAIN[[c for c in range(0x80) if not chr(c).isalnum()]] = 0x20
FEATURES = ["one", "both", "share", "clear"]


def gram_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each byte with the ORDER - 1 bytes before it as one number, row of each); signs count as spaces, letters as lower case.

    A text is read as if spaces stood before it and one after it, so a text of n bytes has n + 1 n-grams. What stands
    before the last space of a history counts as spaces: a word is judged by itself.
    """
    rows, sizes = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(rows), sizes)
    padded = np.full(len(data) + rows * ORDER, 0x20, np.uint8)
    padded[np.arange(len(data)) + row * ORDER + ORDER - 1] = PLAIN[data]
    row = np.repeat(np.arange(rows), sizes + 1)
    last = np.arange(len(row)) + row * (ORDER - 1) + ORDER - 1
    code, outside = padded[last].astype(np.uint64), np.zeros(len(row), bool)
    for back in range(1, ORDER):
        byte = padded[last - back]
        outside |= byte == 0x20
        code |= np.where(outside, np.uint8(0x20), byte).astype(np.uint64) << np.uint64(8 * back)
    return code, row


def gram_counts(labelled: DataFrame, text_col: str, group_col: str, groups: int) -> DataFrame:
    """Columns g and n0, n1, ...: how often each n-gram stands in the texts of each group (an int below `groups`)."""
    ship_package(labelled.sparkSession)

    def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        kinds, which = np.unique(np.concatenate(codes), return_inverse=True)
        sums = np.zeros((len(kinds), groups), np.int64)
        np.add.at(sums, which, np.concatenate(counts))
        return kinds, sums

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        held = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(codes[0].astype(np.int64)), *(pa.array(c) for c in counts[0].T.copy())],
                                              names=["g", *(f"n{k}" for k in range(groups))])

        try:
            for batch in batches:
                data, offsets = text_bytes(batch.column(0))
                group = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint64)
                for first, last in blocks_of(offsets):
                    code, row = gram_codes(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
                    kinds, n = np.unique(code * np.uint64(groups) + group[first + row], return_counts=True)
                    one = np.zeros((len(kinds), groups), np.int64)
                    one[np.arange(len(kinds)), (kinds % np.uint64(groups)).astype(np.int64)] = n
                    codes.append(kinds // np.uint64(groups))
                    counts.append(one)
                    held += len(kinds)
                    if held > FLUSH:
                        kinds, sums = merged(codes, counts)
                        codes, counts, held = [kinds], [sums], len(kinds)
                        if held > FLUSH // 2:
                            yield out()
                            codes, counts, held = [], [], 0
            if codes:
                kinds, sums = merged(codes, counts)
                codes, counts = [kinds], [sums]
                yield out()
        finally:
            give_back()

    names = [f"n{k}" for k in range(groups)]
    parts = labelled.select(text_col, group_col).mapInArrow(count, "g bigint, " + ", ".join(f"{n} bigint" for n in names))
    return parts.groupBy("g").agg(*[F.sum(n).alias(n) for n in names])


def low(g: Column | str, size: int) -> Column:
    """The last `size` bytes of an n-gram."""
    g = F.col(g) if isinstance(g, str) else g
    return g.bitwiseAND(F.lit((1 << 8 * size) - 1))


def shared_backoff(grams: DataFrame) -> DataFrame:
    """Columns g and p: interpolated Kneser-Ney probability of the last byte after the others, from (g, n) of both classes together.

    Counts of the lower orders are continuation counts, i.e. in how many different n-grams of the next
    higher order a byte sequence stands at the end.
    """
    levels = {ORDER: grams.select("g", "n")}
    for size in range(ORDER - 1, 0, -1):
        level = levels[size + 1].groupBy(low("g", size).alias("g")).agg(F.count(F.lit(1)).alias("n"))
        levels[size] = stored(level) if size == ORDER - 1 else level
    below = None
    for size in range(1, ORDER + 1):
        same = Window.partitionBy(F.shiftright("g", 8))
        level = levels[size].withColumns({"total": F.sum("n").over(same), "kinds": F.count(F.lit(1)).over(same)})
        if below is None:
            lower = F.lit(1.0 / BYTES)
        else:
            level = level.withColumn("lower_g", low("g", size - 1)).join(below.select(F.col("g").alias("lower_g"), F.col("p").alias("lower_p")), "lower_g")
            lower = F.col("lower_p")
        below = level.select("g", ((F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * lower) / F.col("total")).alias("p"))
    return below


def log_ratios(grams: DataFrame) -> DataFrame:
    """Rows g, history, ratio, rest: toxic minus ordinary log probability of an n-gram's last byte after its history.

    P(byte | history) of a class is (count - CLASS_DISCOUNT) / count of the history, plus the discounted mass times the
    shared model's probability. `rest` is the difference for bytes that neither class has seen after
    the history: there the shared probability cancels out. A history that no class has seen
    gives 0 for the same reason.
    """
    same = Window.partitionBy("history")
    grams = grams.where("toxic + plain > 0")
    rows = grams.select("g", F.shiftright("g", 8).alias("history"), F.col("toxic").alias("t"), F.col("plain").alias("o"))
    rows = rows.withColumns({f"{c}_{name}": F.sum(value).over(same) for c in "to" for name, value in
                             (("all", F.col(c)), ("cut", F.least(F.col(c).cast("double"), F.lit(CLASS_DISCOUNT))))})
    rows = rows.join(shared_backoff(grams.select("g", (F.col("toxic") + F.col("plain")).alias("n"))), "g")

    def left(c: str) -> Column:
        return F.when(F.col(f"{c}_all") > 0, F.col(f"{c}_cut") / F.col(f"{c}_all")).otherwise(F.lit(1.0))

    def probability(c: str) -> Column:
        own = F.when(F.col(f"{c}_all") > 0, F.greatest(F.col(c) - CLASS_DISCOUNT, F.lit(0.0)) / F.col(f"{c}_all")).otherwise(F.lit(0.0))
        return own + left(c) * F.col("p")

    return rows.select("g", "history", F.log(probability("t") / probability("o")).alias("ratio"), F.log(left("t") / left("o")).alias("rest"))


class Lookup:
    """Numbers found by a key: slots in the order of the hash, searched onward from a key's own slot."""

    EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, self.EMPTY)
        self.values = np.zeros(1 << bits, np.float32)
        self.mask = (1 << bits) - 1
        keys = keys.astype(np.uint64)
        at, left = (mix(keys) >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(left):
            free = self.keys[at] == self.EMPTY
            slots, chosen = np.unique(at[free], return_index=True)
            taken = left[free][chosen]
            self.keys[slots], self.values[slots] = keys[taken], values[taken]
            stays = np.ones(len(left), bool)
            stays[np.flatnonzero(free)[chosen]] = False
            left, at = left[stays], (at[stays] + 1) & self.mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each key, whether it is there)."""
        at = (mix(keys) >> self.shift).astype(np.int64)
        seen = self.keys[at]
        values, found = self.values[at], seen == keys
        open_ = np.flatnonzero(~found & (seen != self.EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            values[open_[hit]], found[open_[hit]] = self.values[at[open_[hit]]], True
            open_ = open_[~hit & (seen != self.EMPTY)]
        return np.where(found, values, np.float32(0)), found


class Ratios:
    """A share of the log ratios: the n-grams and histories whose history falls to block `own` of `blocks`."""

    def __init__(self, grams: tuple[np.ndarray, np.ndarray], histories: tuple[np.ndarray, np.ndarray], own: int, blocks: int):
        self.grams, self.histories, self.own, self.blocks = Lookup(*grams), Lookup(*histories), own, blocks

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log ratio of each word, words of each row, n-grams of each row); from this block's histories alone.

        The log ratio of a word is the sum over its letters and the space after it.
        """
        values, sizes, grams = [np.zeros(0, np.float32)], [np.zeros(0, np.int64)], np.diff(offsets) + 1
        for first, last in blocks_of(offsets):
            code, row = gram_codes(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
            ends = code & np.uint64(0xFF) == 0x20
            word = np.cumsum(ends) - ends
            sizes.append(np.bincount(row[ends], minlength=last - first))
            count = int(sizes[-1].sum())
            if self.blocks > 1:
                mine = mix(code >> np.uint64(8)) % np.uint64(self.blocks) == np.uint64(self.own)
                code, word = code[mine], word[mine]
            ratio, there = self.grams.find(code)
            rest = np.flatnonzero(~there)
            ratio[rest] = self.histories.find(code[rest] >> np.uint64(8))[0]
            values.append(np.bincount(word, ratio, count).astype(np.float32))
        return np.concatenate(values), np.concatenate(sizes), grams


def word_sums(values: np.ndarray, sizes: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the sum of the words' log ratios, and of what lies above the margin."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    return np.bincount(row, values, len(sizes)), np.bincount(row, np.maximum(values - margin, 0), len(sizes))


@dataclass
class ToxicityModel:
    """Stored log ratios, the number of blocks in which they are sent, and weights of the features."""

    ratios: DataFrame
    blocks: int
    weights: np.ndarray


def block_of(blocks: int):
    """The block of a history by the same arithmetic as in Ratios."""
    @F.pandas_udf("int")
    def block(history):
        import pandas as pd

        return pd.Series((mix(history.to_numpy().astype(np.uint64)) % np.uint64(blocks)).astype(np.int32))
    return block("history")


def table_of(ratios: DataFrame) -> tuple[DataFrame, int]:
    """Stored ratios with the block of each, and the number of blocks, which grows with the table."""
    ratios = stored(ratios.withColumn("ratio", F.col("ratio").cast("float")).withColumn("rest", F.col("rest").cast("float")))
    blocks = ratios.count() // TABLE_ROWS + 1
    return ratios.withColumn("block", block_of(blocks) if blocks > 1 else F.lit(0)), blocks


def block_table(ratios: DataFrame, own: int, blocks: int) -> Ratios:
    found = ratios.where(F.col("block") == own).select("g", "ratio", "rest").toArrow()
    g, ratio, rest = (found.column(c).to_numpy() for c in ("g", "ratio", "rest"))
    histories, first = np.unique(g >> 8, return_index=True)
    return Ratios((g, ratio), (histories, rest[first]), own, blocks)


def with_sums(rows: DataFrame, keep: Sequence[str], text_col: str, ratios: DataFrame, blocks: int) -> DataFrame:
    """The kept columns with (sum of log ratios, the clear part of it, n-grams) of every row.

    One block of the table is on the driver and in a task at a time. With several blocks the rows are
    stored with a key, each block scans them, and the log ratios of a row's words are added.
    """
    sums, margin = ["__ratio", "__clear", "__grams"], MARGIN
    keep = list(keep)
    doubles = [StructField(c, DoubleType()) for c in sums]

    def whole(batch: pa.RecordBatch):
        values, sizes, grams = shared.value.words(*text_bytes(batch.column(len(keep))))
        found = [*word_sums(values, sizes, margin), grams.astype(float)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))), *(pa.array(c) for c in found)], names=[*keep, *sums])

    context = rows.sparkSession.sparkContext
    if blocks == 1:
        shared = context.broadcast(block_table(ratios, 0, 1))
        return map_batches(rows.select(*keep, text_col), whole, StructType(rows.select(*keep).schema.fields + doubles))

    def scan(own: int) -> DataFrame:
        table = context.broadcast(block_table(ratios, own, blocks))

        def part(batch: pa.RecordBatch):
            values, sizes, _ = table.value.words(*text_bytes(batch.column(1)))
            ends = np.append(0, np.cumsum(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())],
                                             names=["__row", "__words"])

        return stored(map_batches(keyed.select("__row", text_col), part, "__row bigint, __words binary"))

    def add(batch: pa.RecordBatch):
        lists = batch.column(1).to_pylist()
        found = []
        for parts in lists:
            values = np.sum([np.frombuffer(x, np.float32) for x in parts], axis=0, dtype=np.float64)
            found.append([c[0] for c in word_sums(values, np.array([len(values)]), margin)])
        ratio, clear = np.array(found).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ratio), pa.array(clear)], names=["__row", "__ratio", "__clear"])

    checkpoint_ready(rows.sparkSession)
    folder = f"{context.getCheckpointDir()}/rows-{uuid.uuid4()}"
    rows.withColumn("__row", F.monotonically_increasing_id()).write.parquet(folder)
    keyed = rows.sparkSession.read.parquet(folder)
    parts = reduce(DataFrame.unionByName, [scan(own) for own in range(blocks)])
    added = map_batches(parts.groupBy("__row").agg(F.collect_list("__words").alias("__words")), add, "__row bigint, __ratio double, __clear double")
    sized = keyed.select("__row", *keep, (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1.0).alias("__grams"))
    return sized.join(added, "__row").select(*keep, *sums)


def feature_columns() -> list[Column]:
    """A one, the log-likelihood difference per n-gram, and the part of it in words that clearly speak for the toxic class."""
    size = F.greatest(F.col("__grams"), F.lit(1.0))
    return [F.lit(1.0).alias("one"), (F.col("__ratio") / size).alias("both"), F.log1p(1000 * F.col("__clear") / size).alias("share"),
            F.log1p("__clear").alias("clear")]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights by Newton steps with a small ridge; x has a column of ones first."""
    w = np.zeros(x.shape[1])
    hold = ridge * np.eye(x.shape[1])
    hold[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + hold, x.T @ (weight * (y - p)) - hold @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(labelled: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id") -> ToxicityModel:
    """A model from rows with a text and a 0/1 label; rows with another label are left out.

    All rows are counted whole. The features are weighed on the half of the rows that a first model, of the
    other half, has not seen (halves by a hash of id and text). Equal features of equal labels count as
    one weighted row, and about CALIBRATION of these rows reach the driver. Without rows of both
    classes all scores are one half.
    """
    half = F.pmod(F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))), F.lit(2))
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.col(text_col).alias("__text"), F.col(label_col).cast("int").alias("__label"), half.cast("int").alias("__half"))
    grouped = rows.withColumn("__group", 2 * F.col("__half") + F.col("__label"))
    grams = stored(gram_counts(grouped, "__text", "__group", 4))
    halves = grams.select("g", F.col("n1").alias("toxic"), F.col("n0").alias("plain"))
    whole = grams.select("g", (F.col("n1") + F.col("n3")).alias("toxic"), (F.col("n0") + F.col("n2")).alias("plain"))

    def table(counts: DataFrame) -> tuple[DataFrame, int]:
        return table_of(log_ratios(counts))

    first = table(halves)
    unseen = with_sums(rows.where("__half = 1"), ["__label"], "__text", *first).select(*feature_columns(), "__label")
    seen = stored(unseen.groupBy(*FEATURES, "__label").agg(F.count(F.lit(1)).alias("n")))
    size = seen.count()
    if size > CALIBRATION:
        seen = seen.where(F.pmod(F.xxhash64(*FEATURES), F.lit(1_000_000)) < int(1_000_000 * CALIBRATION / size))
    found = seen.toPandas().sort_values([*FEATURES, "__label"])
    both = found["__label"].nunique() == 2
    weights = logistic(*(found[c].to_numpy(float) for c in (FEATURES, "__label", "n"))) if both else np.zeros(len(FEATURES))
    return ToxicityModel(*table(whole), weights)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The kept columns with a score per row: how likely the whole text is toxic.

    The length-normalised log-likelihoods of both classes are compared, once over all words and
    once over those that clearly speak for the toxic class. The table of log ratios goes to the tasks in
    blocks of bounded size. A NULL or empty text is the end of a text after spaces. Rows with equal
    ids are scored each by itself. Input columns named like result columns are replaced.
    """
    keep = kept_columns(docs, keep, ["score"])
    held = [F.col(c).alias(f"in_{k}") for k, c in enumerate(keep)]
    rows = docs.select(*held, F.col(text_col).alias("__text"))
    found = with_sums(rows, [f"in_{k}" for k in range(len(keep))], "__text", model.ratios, model.blocks)
    total = sum((c * float(w) for c, w in zip(feature_columns(), model.weights, strict=True)), F.lit(0.0))
    return found.select(*[F.col(f"in_{k}").alias(c) for k, c in enumerate(keep)],
                        (1 / (1 + F.exp(-F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))))).alias("score"))
