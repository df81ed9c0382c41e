"""Removal of repeated byte passages: equal windows by interval expansion on Burrows-Wheeler transforms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.arrow import kept_columns, text_bytes
from tickerloom.llm.substrings import in_sorted, packed, unpacked
from tickerloom.llm.words import mix, prefix_sums
from tickerloom.session import ship_package, small_side

#: Bytes of a window by default, and of the grams among which a window's anchor is chosen.
WIDTH, GRAM = 50, 16
#: Text that is worked on at once, text of one bucket of documents, anchors that meet in a shard, segments that meet in a shard.
PIECE_BYTES, BUCKET_BYTES, SHARD_ENTRIES, SHARD_BYTES = 1 << 17, 4 << 20, 400_000, 32 << 20
#: Transforms that the segments of a shard are dealt to.
TRANSFORMS = 64
#: (anchor, bucket) pairs that a task holds before it writes them out.
FLUSH = 400_000
#: An anchor with more places than this is dealt by whole windows, so that no shard gets all of its places.
HOT = 1 << 16
PLACES = "key bigint, low binary, buckets binary, weights binary"
TOLD = "key bigint, codes binary, hot binary"
SEGMENTS = "key bigint, bucket bigint, bytes binary, sizes binary, subs binary, hot binary, least binary, greatest binary, anchors binary"
RUNS = "key bigint, codes binary, starts binary, ends binary, ids binary, hot binary, anchors binary"
RESULTS = ["n_bytes", "n_removed", "span_starts", "span_ends", "clean_bytes"]


@dataclass
class Piece:
    """Bytes of some whole rows, or of a part of one long row, and the runs of windows with one anchor in them.

    `base` is the piece's place in the data; run k has the windows that start at first[k] to last[k] (in the piece).
    """

    base: int
    data: np.ndarray
    sums: np.ndarray
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray
    anchor: np.ndarray

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start to end (not including it)."""
        sums, inverse = self.sums
        with np.errstate(over="ignore"):
            return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pieces(data: np.ndarray, offsets: np.ndarray, width: int, most: int = PIECE_BYTES) -> Iterator[Piece]:
    """Pieces of at most about `most` bytes; those of a long row overlap by width - 1, so each window is in one piece."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = min(max(int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1, first + 1), rows)
        lo, hi = int(offsets[first]), int(offsets[last])
        if last == first + 1 and hi - lo > most:
            for at in range(lo, hi - width + 1, most):
                yield piece_of(data, np.array([at, min(at + most + width - 1, hi)]), first, width)
        elif hi - lo >= width:
            yield piece_of(data, offsets[first:last + 1], first, width)
        first = last


def piece_of(data: np.ndarray, offsets: np.ndarray, row: int, width: int) -> Piece:
    """The piece between the first and last offset; row numbers count from `row`.

    The anchor of a window is the least hash among its grams, so equal windows have equal anchors.
    """
    lo, part = int(offsets[0]), data[offsets[0]:offsets[-1]]
    ends = offsets - lo
    sums = prefix_sums(part)
    gram = min(GRAM, width)
    with np.errstate(over="ignore"):
        least = mix((sums[0][gram:] - sums[0][:-gram]) * sums[1][:len(part) - gram + 1])
    have, want = 1, width - gram + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:len(least) - step], least[step:])
        have += step
    # The row of each window; windows that cross a row's end are none.
    of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[:len(least)]
    there = ends[1:][of] - np.arange(len(least)) >= width
    new = np.append(True, (least[1:] != least[:-1]) | (of[1:] != of[:-1])) & there
    done = np.append(new[1:] | ~there[1:], True) & there
    first, last = np.flatnonzero(new), np.flatnonzero(done)
    # In periodic bytes an anchor can go on; its windows are cut in runs of the usual length.
    count = -(-(last - first + 1) // want)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(first, count) + nth * want
    last = np.minimum(first + want - 1, np.repeat(last, count))
    return Piece(lo, part, sums, first, last, of[first] + row, least[first])


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after another."""
    where = np.repeat(start - (np.cumsum(size) - size), size)
    return data[where + np.arange(len(where))]


def suffix_order(text: np.ndarray, depth: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Suffixes in the order of at least their first `depth` symbols (numbers below 256), by prefix doubling.

    Keys and places share a number as long as both fit, so that plain numbers are sorted. Also returns, of
    the symbols that the first sort compares, but at most `lead`: all of them and all but the last as a
    number for each place in the text, and how many they are.
    """
    n = len(text)
    bits = np.uint64(max(n, 1).bit_length())
    used = np.zeros(256, bool)
    used[text] = True
    used[0] = True
    code = (np.cumsum(used) - 1).astype(np.uint64)
    size = np.uint64(max(int(code[-1]).bit_length(), 1))
    known = max(1, (64 - int(bits)) // int(size))
    wide = np.append(code[text], np.zeros(known, np.uint64))
    key = np.zeros(n, np.uint64)
    for j in range(known):
        if j == min(known, lead) - 1:
            short = key.copy()
        key <<= size
        key |= wide[j:j + n]
        if j == min(known, lead) - 1:
            full = key.copy()
    lead = min(known, lead)
    place, mask = np.arange(n, dtype=np.uint64), (np.uint64(1) << bits) - np.uint64(1)
    fits = True
    while True:
        if fits:
            key <<= bits
            key |= place
            key.sort()
            order = (key & mask).astype(np.int32)
            key >>= bits
        else:
            order = np.argsort(key).astype(np.int32)
            key = key[order]
        if known >= depth:
            return order, full, short, lead
        rank = np.zeros(n + known, np.uint32)
        rank[order] = np.cumsum(np.append(True, key[1:] != key[:-1]), dtype=np.uint32)
        key = rank[:n].astype(np.uint64)
        key <<= bits
        key |= rank[known:]
        known, fits = 2 * known, 3 * int(bits) <= 64


def equal_windows(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, whether each one shares its first `width` symbols with the one before it).

    Zeros in the text are ends, different from everything. Common prefixes are derived from the
    Burrows-Wheeler transform by increasing length, without looking at the text again; the first few lengths are
    read from the symbols that the first sort packs together. A bound between two intervals of length k, extended
    backward by a symbol, parts the two neighbours of length k + 1 whose images (places after the removal of their first
    symbol) lie on both sides of it. All bounds of one length are extended at once, and the search stops at
    `width`: intervals that are not parted by then are equal windows.
    """
    n = len(text)
    order, full, short, lead = suffix_order(text, width + 2, width)
    ended = np.append(text == 0, np.ones(lead, bool))
    early = np.zeros(n, bool)  # an end among the first lead - 1 symbols
    for j in range(lead - 1):
        early |= ended[j:j + n]

    def bounds(heads: np.ndarray, cut: np.ndarray) -> np.ndarray:
        heads = heads[order]
        return np.append(True, heads[1:] != heads[:-1]) | cut[order]

    parted = bounds(full, early | ended[lead - 1:lead - 1 + n])
    fresh = parted & ~bounds(short, early)
    place = np.empty(n + 1, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    place[n] = 0
    # Bounds to come: those not parted yet. Suffixes that are equal in all compared symbols can be in either order.
    later = np.flatnonzero(~parted)
    left, right = place[order[later - 1] + 1], place[order[later] + 1]
    left, right = np.minimum(left, right), np.maximum(left, right)
    count = np.cumsum(fresh, dtype=np.int32)
    fresh = count[left] != count[right]
    # From here on only bounds to come become bounds, so places are counted among them.
    among = np.cumsum(~parted, dtype=np.int32)
    left, right = among[left], among[right]
    for _ in range(lead, width):
        if not fresh.any():
            break
        parted[later[fresh]] = True
        count = np.append(np.int32(0), np.cumsum(fresh, dtype=np.int32))
        stay = np.flatnonzero(~fresh)
        later, left, right = later[stay], left[stay], right[stay]
        among = np.cumsum(~fresh, dtype=np.int32)
        fresh = count[left] != count[right]
        among = np.append(np.int32(0), among)
        left, right = among[left], among[right]
    return order, ~parted


def first_ids(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment of each window, least id of a segment with an equal window), for all windows of the segments in order."""
    ends = np.cumsum(sizes + 1)
    text = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = data + np.uint8(1)  # UTF-8 has no byte 255
    order, same = equal_windows(text, width)
    segment = np.repeat(np.arange(len(sizes)), sizes + 1)
    group = np.flatnonzero(~same)
    least = np.minimum.reduceat(ids[segment[order]], group) if len(group) else np.zeros(0, np.int64)
    first = np.empty(len(text), np.int64)
    first[order] = np.repeat(least, np.diff(np.append(group, len(text))))
    windows = ends[segment] - np.arange(len(text)) > width
    return segment[windows], first[windows]


def spread_out(kinds: np.ndarray, keys: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """For each of the kinds, the data of its items as one binary value; items are in the order of their keys."""
    ends = np.append(0, np.cumsum(sizes))
    bounds = np.append(ends[np.searchsorted(keys, kinds)], ends[-1]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(kinds), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def kept_docs(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, which ids are there, bytes, offsets) of a bucket."""
    ids = table.column("doc_id").combine_chunks()
    text = pa.concat_arrays([c.cast(pa.large_string()) for c in table.column("text").chunks]) if table.num_rows else pa.array([], pa.large_string())
    if isinstance(ids, pa.ChunkedArray):
        ids = pa.concat_arrays(ids.chunks)
    return ids.fill_null(0).to_numpy(zero_copy_only=False), ~np.asarray(ids.is_null()), *text_bytes(text)


def short_codes(anchors: np.ndarray, shards: int) -> np.ndarray:
    """What a shard knows of an anchor: its shard and 32 further bits."""
    shards = np.uint64(shards)
    return (anchors // shards & np.uint64(0xFFFFFFFF)) * shards + anchors % shards


def single_windows(piece: Piece, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, run) of each window of some runs."""
    size = piece.last[runs] - piece.first[runs] + 1
    return np.repeat(piece.first[runs] - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), np.repeat(runs, size)


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
                   keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, the kept columns, n_bytes, n_removed, span_starts, span_ends and clean_bytes per row.

    A window is `width` consecutive bytes of a text's UTF-8 form. Bytes covered by a window that also starts in a row
    with a smaller id are removed; windows are judged on the input, and can overlap. Spans are the maximal runs of removed
    bytes, from a start to before an end. clean_bytes is the rest, which need not be valid UTF-8.

    Steps: (1) every window has an anchor, the least hash among its grams; tasks send the anchors of their rows, and
    shards tell the buckets of rows which ones stand in several places; (2) buckets send the segments
    (windows with a common anchor, in one piece) of these anchors, each different one once; (3) in a shard, a
    Burrows-Wheeler transform of the segments gives equal windows by interval expansion (`equal_windows`),
    and so the least id of each window; (4) buckets remove what a smaller id has.

    Rows are dealt by a hash of id and text, equal rows beyond BUCKET_BYTES to several buckets by their position, so no
    id or text fills a bucket. A passage in many rows is sent once by each bucket. Anchors with more than HOT
    places, like a row of blanks, are dealt by whole windows instead.

    A NULL or empty text has no bytes. A row with a NULL id neither gives nor loses bytes. Rows with equal ids do not
    take bytes from each other, and each is returned. Texts of any length are searched whole. An empty table
    gives no rows. Ids are cast to bigint. Kept columns named like result columns are left out.
    """
    ship_package(docs.sparkSession)
    extra = kept_columns(docs, keep, ["doc_id", *RESULTS])
    sized = docs.select(F.xxhash64(id_col, text_col).alias("base"), F.octet_length(text_col).cast("bigint").alias("size"))
    equal = sized.groupBy("base").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    size, hottest = equal.agg(F.sum("size"), F.max(F.when(F.col("n") > 1, F.col("size")))).first()
    size = size or 0
    parts, shards = size // BUCKET_BYTES + 1, size // 18 // SHARD_ENTRIES + 1
    groups = size // SHARD_BYTES + 1

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(id_col, text_col).alias("base"),
                       F.monotonically_increasing_id().alias("at"), *[F.col(c).alias(f"__{c}") for c in extra])
    if (hottest or 0) > BUCKET_BYTES:
        salts = F.least(F.ceil(F.col("size") / BUCKET_BYTES), F.col("n")).alias("salts")
        rows = rows.join(small_side(equal.where(f"n > 1 and size > {BUCKET_BYTES}").select("base", salts)), "base", "left")
    else:
        rows = rows.withColumn("salts", F.lit(None).cast("bigint"))
    salts = F.coalesce("salts", F.lit(1))
    rows = rows.withColumn("buckets", F.transform(F.sequence(F.lit(1), salts), lambda s: F.pmod(F.xxhash64("base", s), F.lit(parts))))
    dealt = rows.withColumn("bucket", F.element_at("buckets", (F.pmod("at", salts) + 1).cast("int"))).select(
        "bucket", "doc_id", "text", *[f"__{c}" for c in extra])

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: list[np.ndarray] = []
        buckets: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            code, bucket = short_codes(np.concatenate(codes), shards), np.concatenate(buckets)
            order = np.lexsort((bucket, code))
            code, bucket = code[order], bucket[order]
            at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])))
            weight = np.log2(np.diff(np.append(at, len(code)))).astype(np.uint8)
            code = code[at]
            kinds, cols = packed((code % np.uint64(shards)).astype(np.int64),
                                 [(code // np.uint64(shards)).astype(np.uint32), bucket[at].astype(np.int32), weight])
            return pa.RecordBatch.from_arrays([pa.array(kinds), *cols], names=["key", "low", "buckets", "weights"])

        for batch in batches:
            own = batch.column(0)
            ends = np.append(0, np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False)))
            flat = own.flatten().to_numpy(zero_copy_only=False)
            for piece in pieces(*text_bytes(batch.column(1)), width):
                copies = np.diff(ends)[piece.row]  # equal rows in several buckets tell all of them
                codes.append(np.repeat(piece.anchor, copies))
                buckets.append(flat[np.repeat(ends[piece.row] - (np.cumsum(copies) - copies), copies) + np.arange(int(copies.sum()))])
                held += len(codes[-1])
                if held > FLUSH:
                    yield flush()
                    codes, buckets, held = [], [], 0
        if held:
            yield flush()

    def recurring(table: pa.Table) -> pa.Table:
        shard = table.column("key")[0].as_py()
        low, bucket, weight = (unpacked(table, n, k)[0] for n, k in (("low", np.uint32), ("buckets", np.int32), ("weights", np.uint8)))
        order = np.argsort(low, kind="stable")
        low, bucket, weight = low[order], bucket[order], weight[order].astype(np.int64)
        start = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        entries = np.diff(np.append(start, len(low)))
        places = np.add.reduceat(np.int64(1) << np.minimum(weight, 40), start)
        told = np.repeat((entries > 1) | (places > 1), entries)
        hot = np.repeat(places > HOT, entries)[told].astype(np.uint8)
        kinds, cols = packed(bucket[told].astype(np.int64), [low[told].astype(np.uint64) * np.uint64(shards) + np.uint64(shard), hot])
        return pa.table([pa.array(kinds), *cols], names=["key", "codes", "hot"])

    def send_segments(docs_: pa.Table, told: pa.Table) -> pa.Table:
        schema = pa.schema([("key", pa.int64()), ("bucket", pa.int64()), *((n, pa.binary()) for n in ("bytes", "sizes", "subs", "hot", "least", "greatest", "anchors"))])
        if not docs_.num_rows or not told.num_rows:
            return schema.empty_table()
        bucket = docs_.column("bucket")[0].as_py()
        ids, there, data, offsets = kept_docs(docs_)
        codes, at = np.unique(unpacked(told, "codes", np.uint64)[0], return_index=True)
        hot = unpacked(told, "hot", np.uint8)[0][at].astype(bool)
        found: list[tuple[np.ndarray, ...]] = []
        for piece in pieces(data, offsets, width):
            known = in_sorted(short_codes(piece.anchor, shards), codes)
            told_here = (known >= 0) & there[piece.row]
            runs = np.flatnonzero(told_here & ~hot[known])
            start, end = piece.first[runs], piece.last[runs] + width
            found.append((piece.hashes(start, end), piece.anchor[runs], ids[piece.row[runs]], start + piece.base, end - start,
                          np.zeros(len(runs), np.uint8), piece.anchor[runs]))
            start, runs = single_windows(piece, np.flatnonzero(told_here & hot[known]))
            if len(start):
                own = piece.hashes(start, start + width)
                found.append((own, own, ids[piece.row[runs]], start + piece.base, np.full(len(start), width), np.ones(len(start), np.uint8), piece.anchor[runs]))
        if not found:
            return schema.empty_table()
        code, route, who, start, length, single, anchor = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(code):
            return schema.empty_table()
        order = np.lexsort((who, single, code))
        code, route, who, start, length, single, anchor = (x[order] for x in (code, route, who, start, length, single, anchor))
        at = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (single[1:] != single[:-1])))
        least, greatest = who[at], who[np.append(at[1:], len(code)) - 1]
        route, start, length, single, anchor = (x[at] for x in (route, start, length, single, anchor))
        key = (route % np.uint64(groups)).astype(np.int64)
        sub = (route // np.uint64(groups) % np.uint64(TRANSFORMS)).astype(np.uint8)
        order = np.argsort(key, kind="stable")
        kinds, cols = packed(key, [length.astype(np.uint16), sub, single, least, greatest])
        blob = spread_out(kinds, key[order], length[order], gathered(data, start[order], length[order]))
        alone = order[single[order] == 1]
        anchors = spread_out(kinds, key[alone], np.full(len(alone), 8), short_codes(anchor[alone], shards))
        return pa.table([pa.array(kinds), pa.array(np.full(len(kinds), bucket)), blob, *cols, anchors], schema=schema)

    def first_places(table: pa.Table) -> pa.Table:
        data = unpacked(table, "bytes", np.uint8)[0]
        size, counts = unpacked(table, "sizes", np.uint16)
        size = size.astype(np.int64)
        sub, single = unpacked(table, "subs", np.uint8)[0], unpacked(table, "hot", np.uint8)[0]
        least, greatest = unpacked(table, "least", np.int64)[0], unpacked(table, "greatest", np.int64)[0]
        bucket = np.repeat(table.column("bucket").to_numpy(), counts)
        anchor = np.zeros(len(size), np.uint64)
        anchor[single == 1] = unpacked(table, "anchors", np.uint64)[0]
        start = np.cumsum(size) - size
        code = segment_hashes(data, start, size)
        out: list[tuple[np.ndarray, ...]] = []
        for part in np.unique(sub):
            own = np.flatnonzero(sub == part)
            # Each different segment once, with the least of its ids.
            kinds, one, which = np.unique(code[own], return_index=True, return_inverse=True)
            one, lowest = own[one], np.full(len(kinds), np.iinfo(np.int64).max)
            np.minimum.at(lowest, which, least[own])
            segment, first = first_ids(gathered(data, start[one], size[one]), size[one], lowest, width)
            # Runs of windows with one first id, in each segment.
            new = np.append(True, (segment[1:] != segment[:-1]) | (first[1:] != first[:-1]))
            run = np.flatnonzero(new)
            begin = run - np.searchsorted(segment, segment[run])
            stop = begin + np.diff(np.append(run, len(segment)))
            runs_of = np.searchsorted(segment[run], np.arange(len(kinds) + 1))
            many = np.diff(runs_of)[which]
            pick = np.repeat(runs_of[which] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            entry = np.repeat(own, many)
            told = first[run[pick]] < greatest[entry]
            pick, entry = pick[told], entry[told]
            out.append((bucket[entry], code[entry], begin[pick].astype(np.uint16), stop[pick].astype(np.uint16), first[run[pick]], single[entry], anchor[entry]))
        key, *cols, single, anchor = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(key, kind="stable")
        alone = order[single[order] == 1]
        kinds, cols = packed(key, [*cols, single])
        anchors = spread_out(kinds, key[alone], np.full(len(alone), 8), anchor[alone])
        return pa.table([pa.array(kinds), *cols, anchors], names=["key", "codes", "starts", "ends", "ids", "hot", "anchors"])

    def clean(docs_: pa.Table, told: pa.Table) -> pa.Table:
        ids, there, data, offsets = kept_docs(docs_) if docs_.num_rows else (*(np.zeros(0, np.int64),) * 3, np.zeros(1, np.int64))
        covered = np.zeros(len(data) + 1, np.int32)
        if told.num_rows and docs_.num_rows:
            codes, starts, ends, first, hot = (unpacked(told, n, k)[0] for n, k in (
                ("codes", np.uint64), ("starts", np.uint16), ("ends", np.uint16), ("ids", np.int64), ("hot", np.uint8)))
            anchors = np.unique(unpacked(told, "anchors", np.uint64)[0])
            for single in (0, 1):
                own = np.flatnonzero(hot == single)
                own = own[np.argsort(codes[own], kind="stable")]
                if not len(own):
                    continue
                known = codes[own]
                for piece in pieces(data, offsets, width):
                    if single:
                        start, run = single_windows(piece, np.flatnonzero(in_sorted(short_codes(piece.anchor, shards), anchors) >= 0))
                        code = piece.hashes(start, start + width)
                    else:
                        start, run = piece.first, np.arange(len(piece.first))
                        code = piece.hashes(start, piece.last + width)
                    hit = np.flatnonzero((in_sorted(code, known) >= 0) & there[piece.row[run]])
                    low = np.searchsorted(known, code[hit])
                    many = np.searchsorted(known, code[hit], "right") - low
                    pick = own[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
                    hit = np.repeat(hit, many)
                    lost = first[pick] < ids[piece.row[run[hit]]]
                    at, pick = start[hit[lost]] + piece.base, pick[lost]
                    np.add.at(covered, at + starts[pick], 1)
                    np.add.at(covered, at + ends[pick] - 1 + width, -1)
        gone = np.cumsum(covered[:-1]) > 0
        removed = np.diff(np.append(0, np.cumsum(gone))[offsets])
        before = np.append(False, gone)
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        open_ = np.flatnonzero(gone & (~before[:-1] | cut[:-1]))
        close = np.flatnonzero(gone & (np.append(~gone[1:], True) | cut[1:])) + 1 if len(gone) else open_
        spans = np.searchsorted(open_, offsets)
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(spans))
        kept = data[~gone]
        bounds = np.append(0, np.cumsum(np.diff(offsets) - removed)).astype(np.int64)
        blob = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).cast(pa.binary())
        listed = [pa.ListArray.from_arrays(pa.array(spans.astype(np.int32)), pa.array((x - offsets[:-1][of]).astype(np.int64))) for x in (open_, close)]
        return pa.table([*(docs_.column(c) for c in ["doc_id", *(f"__{c}" for c in extra)]), pa.array(np.diff(offsets)), pa.array(removed.astype(np.int64)),
                         *listed, blob], names=["doc_id", *extra, *RESULTS])

    told = (rows.where("doc_id is not null").select("buckets", "text").mapInArrow(send_anchors, PLACES)
            .groupBy("key").applyInArrow(recurring, TOLD))
    segments = dealt.groupBy("bucket").cogroup(told.groupBy("key")).applyInArrow(send_segments, SEGMENTS)
    places = segments.groupBy("key").applyInArrow(first_places, RUNS)
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in extra)
    return dealt.groupBy("bucket").cogroup(places.groupBy("key")).applyInArrow(
        clean, f"doc_id bigint, {kinds}n_bytes bigint, n_removed bigint, span_starts array<bigint>, span_ends array<bigint>, clean_bytes binary")


def segment_hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The hash that `Piece.hashes` gives to the bytes of each segment; segments stand one after another."""
    out, first = np.empty(len(start), np.uint64), 0
    while first < len(start):
        last = max(int(np.searchsorted(start, start[first] + PIECE_BYTES)), first + 1)
        lo, hi = int(start[first]), int(start[last - 1] + size[last - 1])
        part = data[lo:hi]
        own = start[first:last] - lo
        out[first:last] = Piece(lo, part, prefix_sums(part), own, own, own, own).hashes(own, own + size[first:last])
        first = last
    return out
