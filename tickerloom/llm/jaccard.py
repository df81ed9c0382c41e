"""Grouped prefix join on the Jaccard similarity of word shingles, and its connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.llm.arrow import blocks_of, map_batches, stored, text_bytes
from tickerloom.llm.graph import components
from tickerloom.llm.words import mix, window_hashes, word_hashes
from tickerloom.session import ship_package, small_side

#: Counters of the frequency sketch, and how many of them travel together.
SKETCH_BITS, PART_BITS = 20, 14
#: Entries of one token that meet in a task, about; more frequent tokens are salted.
TOKEN_ROWS = 100_000
#: Rows that are sent to all tasks instead of shuffling the texts, at most.
FEW_IDS = 400_000
#: Sets that are compared with one set in one task, about.
PARTNERS = 1000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each row."""
    words, rows = word_hashes(data, offsets, lower=True)
    windows = window_hashes(words, width)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(windows[a:b - width + 1])
        elif b > a:
            yield window_hashes(words[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


def row_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, offsets = text_bytes(column)
    for first, last in blocks_of(offsets):
        yield from shingle_sets(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first], width)


def double_hash(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a sequence of 64-bit numbers, as two signed 64-bit numbers."""
    with np.errstate(over="ignore"):
        place = np.arange(1, len(values) + 1, dtype=np.uint64)
        one = mix(values + place * np.uint64(0x9E3779B97F4A7C15)).sum()
        two = mix(values ^ (place * np.uint64(0xC2B2AE3D27D4EB4F))).sum()
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def frequency_classes(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """For each slot of a sketch, four times the logarithm of how many shingles of all documents fall into it.

    The sketch only orders shingles, rare ones first. It has a fixed size, so frequent shingles
    stand out as long as they exceed the average of a slot; any order gives right results.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            held: list[np.ndarray] = []
            for found in row_sets(batch.column(0), width):
                held.append((found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
                if len(held) == 2000:
                    sums += np.bincount(np.concatenate(held), minlength=len(sums)).astype(np.int32)
                    held = []
            if held:
                sums += np.bincount(np.concatenate(held), minlength=len(sums)).astype(np.int32)
        for part in range(1 << (SKETCH_BITS - PART_BITS)):
            own = sums[part << PART_BITS:(part + 1) << PART_BITS]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["part", "sums"])

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << PART_BITS, np.int64)
        for raw in rows["sums"]:
            total += np.frombuffer(raw, np.int32)
        classes = np.minimum(255, 4 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        return pd.DataFrame({"part": [key[0]], "classes": [classes.tobytes()]})

    parts = docs.select(text_col).mapInArrow(count, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, classes binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in parts.collect():
        out[r["part"] << PART_BITS:(r["part"] + 1) << PART_BITS] = np.frombuffer(r["classes"], np.uint8)
    return out


def prefix_table(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, row_col: str | None = None) -> DataFrame:
    """rid (row_col, if given), doc_id, n, two-part hashes of the set and of (n, prefix), and the prefix, per row.

    A token is a shingle with its frequency class in front, so that tokens sort rare ones first.
    Two sets at or above the threshold share one of the first n - ceil(percent n / 100) + 1 tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequency_classes(docs, text_col, width))

    def work(batch: pa.RecordBatch):
        classes = shared.value
        sizes, keys, prefixes = [], [], []
        for found in row_sets(batch.column(1), width):
            n = len(found)
            token = (classes[(found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8))
            prefix = np.sort(token)[:n - (percent * n + 99) // 100 + 1] if n else token
            sizes.append(n)
            keys.append((*double_hash(found), *double_hash(np.append(prefix, np.uint64(n)))))
            prefixes.append(prefix.astype(np.int64))
        ends = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
        flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in (0, *range(2, batch.num_columns))), pa.array(sizes, pa.int64()), *(pa.array([k[i] for k in keys], pa.int64()) for i in range(4)),
             pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", *key, "n", "s1", "s2", "p1", "p2", "prefix"])

    key = ["rid"] if row_col else []
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"),
                       *[F.col(row_col).cast("bigint").alias(c) for c in key])
    found = map_batches(rows, work, "doc_id bigint, " + "rid bigint, " * len(key) +
                        "n bigint, s1 bigint, s2 bigint, p1 bigint, p2 bigint, prefix array<bigint>")
    return stored(found if row_col else found.withColumn("rid", F.monotonically_increasing_id()))


def enough(overlap: Column, na: Column, nb: Column, percent: int) -> Column:
    return 100 * overlap >= percent * (na + nb - overlap)


def may_link(na: Column, pa_: Column, nb: Column, pb: Column, percent: int) -> Column:
    """Size and position filters for two sets whose first common token stands at pa_ and pb."""
    most = 1 + F.least(na - pa_ - 1, nb - pb - 1)
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & enough(most, na, nb, percent)


def index_entries(table: DataFrame, others: DataFrame) -> DataFrame:
    """(token, g, n, pos, hub, hub_n, hub_pos) of the group leaders, for tokens with two entries or more.

    `others` are the rows that do not lead a group.
    The hub of a token is the entry with the fewest rarer tokens. Very frequent tokens, known by
    their class, are salted: each share has a hub of its own.
    """
    about = F.pow(F.lit(2.0), F.shiftrightunsigned("token", 56) / 4.0)
    entries = (table.join(small_side(others, FEW_IDS), "rid", "left_anti")
               .select(F.col("rid").alias("g"), "n", F.posexplode("prefix").alias("pos", "token"))
               .withColumn("salt", F.when(about > TOKEN_ROWS, F.pmod(F.xxhash64("g"), F.ceil(about / TOKEN_ROWS).cast("bigint")))
                           .otherwise(F.lit(0).cast("bigint"))))
    same = Window.partitionBy("token", "salt")
    first = F.first(F.struct("g", "n", "pos")).over(same.orderBy("pos", "n", "g"))
    kept = entries.withColumns({"hub": first, "seen": F.count(F.lit(1)).over(same)}).where(
        (F.col("seen") > 1) | (about > TOKEN_ROWS))
    return stored(kept.select("token", "g", "n", "pos", F.col("hub.g").alias("hub"), F.col("hub.n").alias("hub_n"),
                               F.col("hub.pos").alias("hub_pos")))


class Verifier:
    """Counts exact overlaps of pairs of rows, reading the texts of candidate rows again.

    Each pair (a, b) is checked where b's set is: the sets of both go to b, or to one of b's shares if b
    has many partners, in a single shuffle.
    """

    def __init__(self, docs: DataFrame, table: DataFrame, id_col: str, text_col: str, width: int, percent: int, row_col: str | None = None):
        # The texts are found by their ids, or by their row keys, which also rows with a NULL id have.
        self.key = "rid" if row_col else "doc_id"
        self.docs = docs.select(F.col(row_col or id_col).cast("bigint").alias(self.key), F.col(text_col).alias("text"))
        self.table = table.select("rid", "s1", "s2") if row_col else table.select("rid", "doc_id", "s1", "s2")
        self.width, self.percent = width, percent

    def sent_sets(self, pairs: DataFrame) -> DataFrame:
        """(b, share, rid, set): the sets that each share of each b needs."""
        counts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("shares"))
        shared = pairs.join(counts, "b").withColumn("share", F.pmod("a", "shares"))
        places = F.inline(F.array(F.struct(F.col("a").alias("rid"), "b", "share"), F.struct(F.col("b").alias("rid"), "b", "share")))
        wanted = shared.select(places).distinct().groupBy("rid").agg(F.collect_list(F.struct("b", "share")).alias("to"))
        few = small_side(self.table.join(wanted, "rid"), FEW_IDS)
        width = self.width

        def work(batch: pa.RecordBatch):
            sets = list(row_sets(batch.column(4), width))
            rids, one, two = (batch.column(c).to_pylist() for c in range(3))
            rows = [(*(place.values()), rid, s) for s, rid, k1, k2, to in zip(sets, rids, one, two, batch.column(3).to_pylist(), strict=True)
                    if double_hash(s) == (k1, k2) for place in to]
            for lo in range(0, len(rows), 500):
                part = rows[lo:lo + 500]
                ends = np.cumsum([0, *(len(r[3]) for r in part)]).astype(np.int32)
                flat = np.concatenate([r[3] for r in part]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c] for r in part], pa.int64()) for c in range(3)),
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["b", "share", "rid", "set"])

        rows = self.docs.join(few, self.key).select("rid", "s1", "s2", "to", "text")
        return map_batches(rows, work, "b bigint, share bigint, rid bigint, set array<bigint>")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that reach the threshold."""
        percent = self.percent

        def overlaps(table: pa.Table) -> pa.Table:
            b = table.column("b")[0].as_py()
            sets = {r: np.asarray(s.values) for r, s in zip(table.column("rid").to_pylist(), table.column("set"), strict=True)}
            hub, found = np.sort(sets[b]), []
            for r, own in sets.items():
                at = np.minimum(np.searchsorted(hub, own), len(hub) - 1)
                both = int((hub[at] == own).sum())
                if r != b and 100 * both >= percent * (len(hub) + len(own) - both):
                    found.append(r)
            return pa.table({"a": pa.array(found, pa.int64()), "b": pa.array([b] * len(found), pa.int64())})

        return stored(self.sent_sets(pairs).groupBy("b", "share").applyInArrow(overlaps, "a bigint, b bigint"))


def near_copies(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                row_col: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id per row; component_id is the least id reachable by links.

    Two rows link if the Jaccard similarity of their sets of `width`-word shingles (ASCII letters in lower
    case) is at least `percent` per cent. Method: equal sets become one unit; units of equal size
    and prefix become one group. Group leaders are joined on prefix tokens, filtered by size and
    position. First each leader is compared with its token's hub and each unit with its leader, which
    settles most members of a group of near copies by one comparison each. Then all group pairs
    whose members are not yet in one component are expanded to unit pairs and verified, so no link is lost.

    A text with fewer words than `width` has one shingle; one without words, or NULL, has none and
    links with nothing. Rows with a NULL id are returned with a NULL component and link with nothing.
    Rows with equal ids are units by their texts; each row is returned. An empty table gives no rows.
    Ids are cast to bigint. Other columns are left out.

    With `row_col`, a stored bigint key of the rows, rows with a NULL id link as the others do, and the result is rid (the
    key), doc_id and component, which names the rows' component by one of their keys (NULL without words).
    """
    table = prefix_table(docs, id_col, text_col, width, percent, row_col)
    usable = table.where((F.lit(bool(row_col)) | F.col("doc_id").isNotNull()) & (F.col("n") > 0))
    units = usable.groupBy("s1", "s2").agg(F.min("rid").alias("r"), F.min("doc_id").alias("least_id"), F.min("n").alias("n"),
                                           F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    groups = units.groupBy("p1", "p2").agg(F.min("r").alias("g"))
    units = stored(units.join(groups, ["p1", "p2"]).select("s1", "s2", "r", "least_id", "n", "g"))
    leads = units.where(F.col("r") == F.col("g")).select(F.col("r").alias("rid"))
    others = table.select("rid").join(leads, "rid", "left_anti")
    entries = index_entries(table.select("rid", "n", "prefix"), others)

    verify = Verifier(docs, table, id_col, text_col, width, percent, row_col)
    stars = entries.where((F.col("g") != F.col("hub")) & may_link(
        F.col("n"), F.col("pos"), F.col("hub_n"), F.col("hub_pos"), percent)).select(
            F.greatest("g", "hub").alias("a"), F.least("g", "hub").alias("b"))
    inside = units.where(F.col("r") != F.col("g")).select(F.col("r").alias("a"), F.col("g").alias("b"))
    tried = stored(stars.union(inside).distinct())
    links = verify(tried)

    known = components(links)
    placed = stored(units.join(known, units["r"] == known["node"], "left").select(
        "r", "g", F.coalesce("component", "r").alias("c")))
    # NULL for a group with units of several components: its pairs are always looked at.
    group_of = placed.groupBy("g").agg(F.when(F.min("c") == F.max("c"), F.min("c")).alias("c"))
    moved = group_of.where(F.coalesce(F.col("c") != F.col("g"), F.lit(True))).select("g", "c", F.lit(True).alias("moved"))
    marked = entries.select("token", "g", "n", "pos").join(small_side(moved, FEW_IDS), "g", "left").withColumn(
        "c", F.when(F.col("moved"), F.col("c")).otherwise(F.col("g"))).drop("moved")
    open_ = marked.groupBy("token").agg(F.min(F.coalesce("c", F.lit(-1))).alias("lo"), F.max(F.coalesce("c", F.lit(-2))).alias("hi")).where(
        F.col("lo") != F.col("hi")).select("token")
    live = stored(marked.join(open_, "token"))
    x, y = (live.select("token", *[F.col(c).alias(f"{c}{k}") for c in ("g", "n", "pos", "c")]) for k in (1, 2))
    apart = F.coalesce(F.col("c1") != F.col("c2"), F.lit(True))
    near = x.join(y, "token").where((F.col("g1") < F.col("g2")) & apart & may_link(
        F.col("n1"), F.col("pos1"), F.col("n2"), F.col("pos2"), percent)).select("g1", "g2").distinct()
    mixed = group_of.where(F.col("c").isNull()).select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    one, two = (placed.select(F.col("g").alias(f"g{k}"), F.col("r").alias(f"r{k}"), F.col("c").alias(f"c{k}")) for k in (1, 2))
    pairs = near.union(mixed).join(one, "g1").join(two, "g2").where((F.col("c1") != F.col("c2")) & (F.col("r1") != F.col("r2"))).select(
        F.greatest("r1", "r2").alias("a"), F.least("r1", "r2").alias("b")).distinct()
    more = verify(stored(pairs.join(tried, ["a", "b"], "left_anti")))

    final = components(links.union(more))
    named = units.join(final, units["r"] == final["node"], "left").select(
        "s1", "s2", "least_id", F.coalesce("component", "r").alias("c"))
    if row_col:
        sets = named.select("s1", "s2", F.col("c").alias("component"))
        return table.select("rid", "doc_id", "s1", "s2", "n").join(sets, ["s1", "s2"], "left").select(
            "rid", "doc_id", F.when(F.col("n") > 0, F.col("component")).alias("component"))
    least = named.groupBy("c").agg(F.min("least_id").alias("component_id"))
    of_set = named.join(least, "c").select("s1", "s2", "component_id")
    return table.select("doc_id", "n", "s1", "s2").join(of_set, ["s1", "s2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
