"""Removal of repeated passages, located by Aho-Corasick automata of recurring phrases."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.arrow import blocks_of, give_back, text_bytes
from tickerloom.llm.words import mix, window_hashes, word_hashes
from tickerloom.session import ship_package, small_side

#: Words of an anchor.
ANCHOR = 5
#: Text of one group of documents, and anchors or windows that meet in a group, about.
GROUP_BYTES, GROUP_ENTRIES = 4 << 20, 400_000
#: Times GROUP_BYTES from which a bucket is dealt further.
HOT_BUCKET = 4
#: (anchor, document) pairs that a task holds before it writes them out.
FLUSH = 400_000
#: Letters that stand for the words of a group in its automaton, at most.
LETTERS = 0x10F000
ENTRIES = "key bigint, ids binary, codes binary"
WINDOWS = "key bigint, bucket bigint, codes binary, low binary, high binary"


def packed(keys: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """Distinct keys, and for each column the values of a key as one binary value."""
    order = np.argsort(keys, kind="stable")
    kinds, starts = np.unique(keys[order], return_index=True)
    bounds = np.append(starts, len(keys))
    out = []
    for c in columns:
        data = np.ascontiguousarray(c[order])
        ends = (bounds * data.itemsize).astype(np.int32)
        out.append(pa.BinaryArray.from_buffers(pa.binary(), len(kinds), [None, pa.py_buffer(ends), pa.py_buffer(data)]))
    return kinds, out


def unpacked(table: pa.Table, name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a packed column, number of values in each row)."""
    values, sizes = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for chunk in table.column(name).chunks:
        chunk = chunk.cast(pa.large_binary())
        _, offsets, data = chunk.buffers()
        ends = np.frombuffer(offsets, np.int64)[chunk.offset:chunk.offset + len(chunk) + 1]
        if data is not None and len(chunk):
            values.append(np.frombuffer(data.to_pybytes()[ends[0]:ends[-1]], kind))
            sizes.append(np.diff(ends) // np.dtype(kind).itemsize)
    return np.concatenate(values), np.concatenate(sizes)


def in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Position in `known` (sorted) of each value, or -1."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


class Windows:
    """Windows of `width` words of a block of texts, and the anchor of each window.

    The anchor is the least hash among the short phrases of a window, so equal windows have equal
    anchors, and neighbouring windows mostly share theirs.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        self.words, self.rows = word_hashes(data, offsets)
        self.width = width
        sizes = np.diff(self.rows)
        row = np.repeat(np.arange(len(sizes)), sizes)
        self.at = np.flatnonzero(self.rows[1:][row] - np.arange(len(row)) >= width) if len(row) else np.zeros(0, np.int64)
        self.row = row[self.at]

    def anchors(self) -> np.ndarray:
        grams = window_hashes(self.words, min(ANCHOR, self.width))
        left, have = self.width - min(ANCHOR, self.width) + 1, 1
        while have < left:
            step = min(have, left - have)
            grams = np.minimum(grams[:len(grams) - step], grams[step:])
            have += step
        return grams[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def hashes(self) -> np.ndarray:
        return window_hashes(self.words, self.width)[self.at] if len(self.at) else np.zeros(0, np.uint64)


def pair_keys(codes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return mix(codes ^ mix(ids.astype(np.uint64)))


def grouped(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, which ids are there, bytes, offsets) of a group of documents."""
    ids = table.column("doc_id").combine_chunks()
    text = table.column("text").combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text, ids = pa.concat_arrays(text.chunks), pa.concat_arrays(ids.chunks)
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ~np.asarray(ids.is_null()), *text_bytes(text)


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text",
                   keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, clean_text, n_words, n_removed per row, and the kept columns.

    A window is `width` consecutive words of a text (runs without 0x20 and 0x09-0x0D). Words covered by
    a window that also starts in a row with a smaller id are removed; windows are judged on the
    input. clean_text is the other words joined by one space.

    Steps: (1) every document sends the anchors of its windows, and anchors found in two documents
    are kept; (2) windows at such anchors are confirmed by their hashes, which gives
    the least id that has each; (3) each group of documents compiles the passages confirmed for it into an
    automaton and streams its documents through it. Anchors, windows and documents are dealt by
    hashes into groups of bounded size; what is frequent in a task or group is sent once, not once
    for each document, so a passage in a third of all documents stays small. A bucket with much
    text, because many rows share an id or equal texts have NULL ids, is dealt to several groups row by row.

    A NULL or empty text has no words. A row with a NULL id neither gives nor loses words. Rows with
    equal ids do not take words from each other, and each is returned. An empty table gives no
    rows. Ids are cast to bigint. Kept columns named like result columns are left out.
    """
    ship_package(docs.sparkSession)
    results = ["doc_id", "clean_text", "n_words", "n_removed"]
    extra = [c for c in keep if c not in results and c in docs.columns]
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = size // GROUP_BYTES | 1  # odd, so that evenly spaced ids do not meet
    shards = max(1, size // 30 // GROUP_ENTRIES)
    key = F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text_col))
    dealt = docs.select(F.pmod(key, F.lit(parts)).alias("base"), F.col(id_col).cast("bigint").alias("doc_id"),
                        F.col(text_col).alias("text"), *[F.col(c).alias(f"__{c}") for c in extra])
    # A bucket with far more text than others (rows of one id) is dealt further, row by row.
    held = dealt.groupBy("base").agg(F.sum(F.octet_length("text")).alias("bytes")).where(F.col("bytes") > HOT_BUCKET * GROUP_BYTES)
    hot = small_side(held.select("base", F.ceil(F.col("bytes") / F.lit(GROUP_BYTES)).cast("bigint").alias("salts")))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("salts", F.lit(1)))
    rows = dealt.join(hot, "base", "left").withColumn("bucket", F.col("base") + parts * salt).drop("salts")

    def to_all_salts(told: DataFrame) -> DataFrame:
        """Entries of a dealt bucket go to every part of it, so it does not matter where a row went."""
        every = told.join(hot.withColumnRenamed("base", "key"), "key", "left")
        turns = F.sequence(F.lit(0).cast("bigint"), F.coalesce("salts", F.lit(1)) - 1)
        return every.withColumn("turn", F.explode(turns)).select((F.col("key") + parts * F.col("turn")).alias("key"), "ids", "codes")

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        buckets: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            code, who, bucket = np.concatenate(codes), np.concatenate(ids), np.concatenate(buckets)
            order = np.lexsort((who, code))
            code, who, bucket = code[order], who[order], bucket[order]
            new = np.append(True, (code[1:] != code[:-1]) | (who[1:] != who[:-1]))
            code, who, bucket = code[new], who[new], bucket[new]
            first = np.append(True, code[1:] != code[:-1])
            last = np.append(first[1:], True)
            # Seen in two documents here: the documents learn it at once, the others from two entries.
            known = ~(first & last)
            for k, chosen in ((code % np.uint64(shards), first | last), (-1 - bucket, known)):
                kinds, cols = packed(k.astype(np.int64)[chosen], [who[chosen], code[chosen]])
                yield pa.RecordBatch.from_arrays([pa.array(kinds), *cols], names=["key", "ids", "codes"])

        held = 0
        for batch in batches:
            there = ~np.asarray(batch.column(1).is_null())
            who = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
            bucket = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = text_bytes(batch.column(2))
            for lo, hi in blocks_of(offsets):
                w = Windows(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], width)
                anchors, row = w.anchors(), w.row + lo
                if not len(anchors):
                    continue
                turn = np.append(True, (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1])) & there[row]
                codes.append(anchors[turn])
                ids.append(who[row[turn]])
                buckets.append(bucket[row[turn]])
                held += int(turn.sum())
                if held > FLUSH:
                    yield from flush()
                    codes, ids, buckets, held = [], [], [], 0
        if held:
            yield from flush()

    def recurring_anchors(table: pa.Table) -> pa.Table:
        ids, _ = unpacked(table, "ids", np.int64)
        codes, _ = unpacked(table, "codes", np.uint64)
        key = table.column("key")[0].as_py()
        if key < 0:  # learned by the sender
            buckets = np.full(len(ids), -1 - key)
        else:
            order = np.lexsort((ids, codes))
            ids, codes = ids[order], codes[order]
            start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            end = np.append(start[1:], len(codes)) - 1
            keep_ = np.repeat(ids[start] != ids[end], end - start + 1)
            ids, codes = ids[keep_], codes[keep_]
            buckets = ids % parts
        kinds, cols = packed(buckets, [ids, codes])
        return pa.table([pa.array(kinds), *cols], names=["key", "ids", "codes"])

    def confirm(docs_: pa.Table, told: pa.Table) -> pa.Table:
        none = pa.table({"key": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "codes": pa.array([], pa.binary()),
                         "low": pa.array([], pa.binary()), "high": pa.array([], pa.binary())})
        if not docs_.num_rows or not told.num_rows:
            return none
        bucket = docs_.column("base")[0].as_py()
        ids, there, data, offsets = grouped(docs_)
        known = np.unique(pair_keys(unpacked(told, "codes", np.uint64)[0], unpacked(told, "ids", np.int64)[0]))
        w = Windows(data, offsets, width)
        at = (in_sorted(pair_keys(w.anchors(), ids[w.row]), known) >= 0) & there[w.row]
        if not at.any():
            return none
        codes, who = w.hashes()[at], ids[w.row[at]]
        order = np.lexsort((who, codes))
        codes, who = codes[order], who[order]
        start = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
        end = np.append(start[1:], len(codes)) - 1
        codes, low, high = codes[start], who[start], who[end]
        kinds, cols = packed((codes % np.uint64(shards)).astype(np.int64), [codes, low, high])
        return pa.table([pa.array(kinds), pa.array(np.full(len(kinds), bucket)), *cols], names=["key", "bucket", "codes", "low", "high"])

    def first_places(table: pa.Table) -> pa.Table:
        codes, sizes = unpacked(table, "codes", np.uint64)
        low, high = unpacked(table, "low", np.int64)[0], unpacked(table, "high", np.int64)[0]
        bucket = np.repeat(table.column("bucket").to_numpy(), sizes)
        kinds, which = np.unique(codes, return_inverse=True)
        first = np.full(len(kinds), np.iinfo(np.int64).max)
        np.minimum.at(first, which, low)
        told = first[which] < high
        keys, cols = packed(bucket[told], [first[which][told], codes[told]])
        return pa.table([pa.array(keys), *cols], names=["key", "ids", "codes"])

    def clean(docs_: pa.Table, told: pa.Table) -> pa.Table:
        ids, there, data, offsets = grouped(docs_) if docs_.num_rows else (*(np.zeros(0, np.int64),) * 3, np.zeros(1, np.int64))
        raw = data.tobytes()
        w = Windows(data, offsets, width)
        covered = np.zeros(len(w.words) + 1, np.int64)
        if told.num_rows and len(w.at):
            locate(w, ids, there, unpacked(told, "codes", np.uint64)[0], unpacked(told, "ids", np.int64)[0], covered)
        gone = np.cumsum(covered[:-1]) > 0
        texts, removed = [], []
        for i in range(len(offsets) - 1):
            words = raw[offsets[i]:offsets[i + 1]].split()
            cut = gone[w.rows[i]:w.rows[i + 1]]
            count = int(cut.sum())
            removed.append(count)
            texts.append(b" ".join(compress(words, (~cut).tolist()) if count else words).decode())
        counts = np.diff(w.rows)
        return pa.table([*(docs_.column(c) for c in ["doc_id", *(f"__{c}" for c in extra)]), pa.array(texts, pa.string()),
                         pa.array(counts, pa.int64()), pa.array(removed, pa.int64())],
                        names=["doc_id", *extra, "clean_text", "n_words", "n_removed"])

    def lean(work):
        """The function of a group or two, with memory given back after each, since a worker handles many groups."""
        def one(group: pa.Table) -> pa.Table:
            out = work(group)
            give_back()
            return out

        def two(left: pa.Table, right: pa.Table) -> pa.Table:
            out = work(left, right)
            give_back()
            return out
        return two if work in (confirm, clean) else one

    told = (dealt.select("base", "doc_id", "text").mapInArrow(send_anchors, ENTRIES)
            .groupBy("key").applyInArrow(lean(recurring_anchors), ENTRIES))
    windows = rows.groupBy("bucket").cogroup(to_all_salts(told).groupBy("key")).applyInArrow(lean(confirm), WINDOWS)
    places = windows.groupBy("key").applyInArrow(lean(first_places), ENTRIES)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    schema = "doc_id bigint, " + (kinds + ", " if kinds else "") + "clean_text string, n_words bigint, n_removed bigint"
    return rows.groupBy("bucket").cogroup(to_all_salts(places).groupBy("key")).applyInArrow(lean(clean), schema).select(
        "doc_id", *extra, "clean_text", "n_words", "n_removed")


def passages(w: Windows, ids: np.ndarray, there: np.ndarray, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, latest first id of a window) of the longest runs of windows confirmed for their rows."""
    order = np.argsort(codes, kind="stable")
    hit = in_sorted(w.hashes(), codes[order])
    earliest = first[order][hit]
    held = (hit >= 0) & there[w.row] & (earliest < ids[w.row])
    new = np.append(True, (w.row[1:] != w.row[:-1]) | ~held[:-1])
    starts = np.flatnonzero(held & new)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none
    ends = np.flatnonzero(held & np.append(new[1:] | ~held[1:], True))
    latest = np.maximum.reduceat(np.where(held, earliest, np.iinfo(np.int64).min), starts)
    return w.at[starts], w.at[ends] + w.width, latest


def locate(w: Windows, ids: np.ndarray, there: np.ndarray, codes: np.ndarray, first: np.ndarray, covered: np.ndarray) -> None:
    """Add the occurrences of the confirmed passages to `covered` (+1 where one begins, -1 where it ends).

    Words of the group become letters, passages become strings, and the automaton of the passages reads
    each document once. A passage counts in a row whose id is above the first ids of all its windows;
    the longest runs of each row are among the passages, so every covered word is found.
    """
    import ahocorasick

    starts, ends, latest = passages(w, ids, there, codes, first)
    if not len(starts):
        return
    kinds, letter = np.unique(w.words, return_inverse=True)
    if len(kinds) > LETTERS:  # a single text with so many different words
        np.add.at(covered, starts, 1)
        np.add.at(covered, ends, -1)
        return
    letter = letter.astype(np.uint32) + 1
    letter[letter >= 0xD800] += 0x800
    text = letter.astype("<u4").tobytes().decode("utf-32-le")
    automaton = ahocorasick.Automaton()
    for a, b, least in zip(starts.tolist(), ends.tolist(), latest.tolist(), strict=True):
        automaton.add_word(text[a:b], (b - a, least))
    automaton.make_automaton()
    found: list[tuple[int, int]] = []
    for row, (a, b) in enumerate(zip(w.rows[:-1].tolist(), w.rows[1:].tolist(), strict=True)):
        if b - a >= w.width and there[row]:
            own = int(ids[row])
            found += [(a + end, size) for end, (size, least) in automaton.iter(text[a:b]) if least < own]
    last, size = np.array(found, np.int64).reshape(-1, 2).T
    np.add.at(covered, last - size + 1, 1)
    np.add.at(covered, last + 1, -1)
