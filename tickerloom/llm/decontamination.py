"""Benchmark decontamination: word-for-word search, latent semantic search of passages, then subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tickerloom.llm.arrow import BATCH_BYTES, BLOCK_BYTES, blocks_of, give_back, map_batches, stored, text_bytes
from tickerloom.llm.words import LOWER, window_hashes, word_hashes
from tickerloom.session import ship_package

#: Hashed terms, latent dimensions, and spare directions of the random range.
TERM_BITS, RANK, SPARE, POWERS = 13, 128, 12, 1
#: Words of half a passage, after common words are dropped; a passage is two neighbouring halves.
HALF = 8
#: A term is common if it is in more than this share of all runs of RUN words.
COMMON, RUN = 0.03, 16
#: Words of the run by which an item is looked up word for word, at most.
ANCHOR = 8
#: Seed of the random directions; items, and bytes of their texts, searched in one scan of the documents, about.
SEED, ITEMS, ITEM_BYTES = 7, 20_000, 16 << 20
#: Least cosine of a candidate; least share of an item's words in common order, without and with its answer.
COSINE, PLAIN_SHARE, ANSWER_SHARE, ANSWER_WORDS = 0.4, 0.8, 0.6, 0.5
#: Share of an item's words, or of 12 of them, that a candidate passage must have in any order.
BAG_SHARE, BAG_WORDS = 0.5, 12
#: Items with fewer words must be found whole, i.e. word for word.
SHORT = 5
WORDS_AT_ONCE = 1 << 14
#: (word, item) pairs that are counted at once, and bytes of texts that are searched at once, so that these stay in a core's cache.
ENTRIES, SEARCH_BYTES = 1 << 20, 1 << 16
#: Tasks that multiply the matrix of co-occurrences, and blocks of terms in which their products meet.
SUMS, PARTS = 4, 32
#: Rows of that matrix in a block, and cells of its lower half.
ROWS, CELLS = 16, (1 << TERM_BITS) * ((1 << TERM_BITS) + 1) // 2
PLAIN = LOWER.copy()
PLAIN[[c for c in range(0x80) if not chr(c).isalnum()]] = 0x20


def terms_of(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def rare_terms(idf: np.ndarray) -> np.ndarray:
    return idf > 1 - np.log(COMMON)


def kept_terms(idf: np.ndarray, items: DataFrame) -> np.ndarray:
    """Terms of the passages: those that are not common, and all terms of items (column words) that would lose too much.

    An item must keep SHORT words and half of its words, so one that is made of common words, or that is
    common because it was copied into many documents, is searched with all of its words.
    """
    rare = rare_terms(idf)

    def lost(batch: pa.RecordBatch):
        found = [np.zeros(0, np.int64)]
        for _, p in passages_of(batch.column(0)):
            terms = terms_of(p.words)
            sizes = np.diff(p.rows)
            left = np.diff(np.append(0, np.cumsum(rare[terms]))[p.rows])
            found.append(terms[np.repeat((left < SHORT) | (2 * left < sizes), sizes)])
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], names=["term"])

    kept = rare.copy()
    kept[[r["term"] for r in map_batches(items.select("words"), lost, "term bigint").distinct().collect()]] = True
    return kept


@dataclass
class Passages:
    """Words of a block of texts without signs, case and common words, and the half passages they form.

    `full` has the common words, too.
    """

    words: np.ndarray
    rows: np.ndarray
    full: Passages | None = None

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, rare: np.ndarray | None = None) -> Passages:
        words, rows = word_hashes(PLAIN[data], offsets)
        if rare is None:
            return cls(words, rows)
        kept = rare[terms_of(words)]
        return cls(words[kept], np.append(0, np.cumsum(kept))[rows], cls(words, rows))

    def halves(self, size: int = HALF) -> tuple[np.ndarray, np.ndarray]:
        """(first word, row) of each half passage; the last one of a row can be shorter."""
        sizes = np.diff(self.rows)
        counts = -(-sizes // size)
        row = np.repeat(np.arange(len(sizes)), counts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.rows[:-1][row] + nth * size, row

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end, row, first half) of each passage."""
        start, row = self.halves()
        end = np.minimum(start + HALF, self.rows[1:][row])
        pair = row[1:] == row[:-1]
        alone = np.append(True, ~pair)[:len(start)] & np.append(~pair, True)[:len(start)]
        first = np.append(pair, False)[:len(start)] | alone
        both = np.flatnonzero(first & ~alone)
        stop = end.copy()
        stop[both] = end[both + 1]
        return start[first], stop[first], row[first], np.flatnonzero(first)

    def sums(self, table: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Vector of each of some passages: the sum of the table's rows of its terms."""
        out, size = np.zeros((len(start), table.shape[1]), np.float32), stop - start
        terms, step = terms_of(self.words), WORDS_AT_ONCE // (2 * HALF)
        for lo in range(0, len(start), step):
            many = size[lo:lo + step]
            before = np.cumsum(many) - many
            where = np.repeat(start[lo:lo + step] - before, many) + np.arange(int(many.sum()))
            out[lo:lo + step] = np.add.reduceat(table[terms[where]], before, axis=0)
        return out

    def vectors(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(vector, first word, end, row) of each passage."""
        start, stop, row, _ = self.spans()
        return self.sums(table, start, stop), start, stop, row


def passages_of(column: pa.Array, rare: np.ndarray | None = None) -> Iterator[tuple[int, Passages]]:
    data, offsets = text_bytes(column)
    for lo, hi in blocks_of(offsets, BLOCK_BYTES if rare is None else SEARCH_BYTES):
        yield lo, Passages.of(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], rare)


def inverse_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """Smoothed idf of each hashed term over the runs of RUN words of all documents."""
    terms = 1 << TERM_BITS
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, total = np.zeros(terms, np.int64), 0
        for batch in batches:
            for _, p in passages_of(batch.column(0)):
                start, _ = p.halves(RUN)
                which = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(p.words))))
                code = which * terms + terms_of(p.words)
                code.sort()
                have += np.bincount(code[np.append(True, code[1:] != code[:-1])[:len(code)]] % terms, minlength=terms)
                total += len(start)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(terms)), pa.array(have), pa.array(np.full(terms, total))],
                                         names=["term", "have", "total"])

    out = np.zeros(terms)
    found = docs.select(text_col).mapInArrow(count, "term bigint, have bigint, total bigint").groupBy("term").agg(
        F.sum("have").alias("have"), F.sum("total").alias("total"))
    for r in found.collect():
        out[r["term"]] = np.log((1 + r["total"]) / (1 + r["have"])) + 1
    return out


def pair_codes(p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the co-occurrence matrix of terms that a block adds to, once and twice for each entry.

    Cell hi * (hi + 1) / 2 + lo stands for two words of one passage with these terms. Words of one half meet in each
    passage of the half, words of neighbouring halves in one passage.
    """
    begin, row = p.halves()
    size = np.diff(np.append(begin, len(p.words)))
    left = np.append(False, row[1:] == row[:-1])[:len(row)]
    right = np.append(left[1:], False)[:len(row)]
    end = begin + size
    own, after = np.repeat(end, size), np.repeat(np.where(right, np.append(end[1:], 0)[:len(end)], end), size)
    two = np.repeat(left & right, size)
    terms, place = terms_of(p.words).astype(np.uint32), np.arange(len(p.words))
    starts = terms * (terms + np.uint32(1)) >> np.uint32(1)
    # Words after each one that meet it twice, and words that meet it at all.
    own, after = np.where(two, own - place, 0), after - place
    once, twice = [], []
    for lag in range(min(2 * HALF, len(terms))):
        last = len(terms) - lag
        code = np.maximum(starts[:last], starts[lag:]) + np.minimum(terms[:last], terms[lag:])
        both, met = own[:last] > lag, after[:last] > lag
        twice.append(code[both])
        once.append(code[met & ~both])
        if lag:  # Equal terms meet in either order.
            same = np.flatnonzero(terms[:last] == terms[lag:])
            twice.append(code[same[both[same]]])
            once.append(code[same[(met & ~both)[same]]])
    none = np.zeros(0, np.uint32)
    return np.concatenate([none, *once]), np.concatenate([none, *twice])


class PairCounts:
    """Exact counts of matrix cells in one byte each; what does not fit into it is kept by cell."""

    def __init__(self):
        self.bytes = np.zeros(CELLS, np.uint8)
        self.waiting: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.size = 0
        self.cells, self.more = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, p: Passages) -> None:
        for kept, codes in zip(self.waiting, pair_codes(p), strict=True):
            kept.append(codes)
            self.size += len(codes)
        if self.size >= ENTRIES:
            self.settle()

    def settle(self) -> None:
        for times, kept in enumerate(self.waiting, 1):
            codes = np.concatenate(kept) if kept else np.zeros(0, np.uint32)
            kept.clear()
            codes.sort()
            first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[:len(codes)])
            cell = codes[first]
            total = self.bytes[cell] + times * np.diff(np.append(first, len(codes)))
            big = total > 255
            if big.any():
                self.cells, self.more = np.append(self.cells, cell[big]), np.append(self.more, total[big])
                total[big] = 0
            self.bytes[cell] = total
        self.size = 0
        if len(self.cells) > ENTRIES:
            self.cells, which = np.unique(self.cells, return_inverse=True)
            more = np.zeros(len(self.cells), np.int64)
            np.add.at(more, which, self.more)
            self.more = more

    def blocks(self) -> Iterator[pa.RecordBatch]:
        """(part, counts) for each block of ROWS matrix rows."""
        self.settle()
        for part in range((1 << TERM_BITS) // ROWS):
            lo, hi = row_start(part * ROWS), row_start((part + 1) * ROWS)
            own = (self.cells >= lo) & (self.cells < hi)
            if own.any():
                block = self.bytes[lo:hi].astype(np.int64)
                np.add.at(block, self.cells[own] - lo, self.more[own])
            elif self.bytes[lo:hi].any():
                block = self.bytes[lo:hi]
            else:
                continue
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block.itemsize], pa.int32()),
                                              pa.array([pa.compress(block.tobytes(), codec="zstd", asbytes=True)], pa.binary())],
                                             names=["part", "width", "counts"])


def row_start(term: int) -> int:
    return term * (term + 1) // 2


def counts_of(part: int, width: int, packed: bytes) -> np.ndarray:
    size = row_start((part + 1) * ROWS) - row_start(part * ROWS)
    return np.frombuffer(pa.decompress(packed, size * width, codec="zstd"), np.uint8 if width == 1 else np.int64)


def co_occurrences(docs: DataFrame, rare: np.ndarray, text_col: str) -> DataFrame:
    """How often two terms meet in a passage, over all passages of all documents: blocks of ROWS rows of half the matrix.

    One scan. A task adds up in memory of a fixed size, and there are no more tasks than cores, so what
    is shuffled does not grow with the documents.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            found = PairCounts()
            for batch in batches:
                for _, p in passages_of(batch.column(0), rare):
                    found.add(p)
            yield from found.blocks()
        finally:
            found = None
            give_back()

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = 0
        for width, packed in zip(rows["width"], rows["counts"], strict=True):
            total = total + counts_of(key[0], width, packed).astype(np.int64)
        return pd.DataFrame({"part": [key[0]], "width": [8], "counts": [pa.compress(total.tobytes(), codec="zstd", asbytes=True)]})

    spark = docs.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    schema = "part int, width int, counts binary"
    found = docs.select(text_col).coalesce(spark.sparkContext.defaultParallelism).mapInArrow(work, schema)
    return found.groupBy("part").applyInPandas(add, schema)


def latent_space(docs: DataFrame, idf: np.ndarray, rare: np.ndarray, text_col: str) -> np.ndarray:
    """(terms x RANK) table that maps terms to whitened latent coordinates.

    A randomised singular value decomposition of the TF-IDF matrix A of the passages of all documents. A'A has a
    fixed size and is counted exactly (`co_occurrences`); its range is found from random directions by products
    with it, and the small matrix q'A'A q gives singular values and vectors.
    """
    terms = 1 << TERM_BITS
    if docs.isEmpty():
        return np.zeros((terms, 1), np.float32)
    counts = stored(co_occurrences(docs, rare, text_col).repartition(SUMS))
    weight = idf[:, None]

    def multiply(q: np.ndarray) -> np.ndarray:
        shared = docs.sparkSession.sparkContext.broadcast(weight * q)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(q.shape)
            for batch in batches:
                for part, width, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    first, values = part * ROWS, counts_of(part, width, packed)
                    block = np.zeros((ROWS, first + ROWS))
                    block[np.arange(first + ROWS) <= first + np.arange(ROWS)[:, None]] = values
                    out[first:first + ROWS] += block @ shared.value[:first + ROWS]
                    # The other half of the matrix, without its diagonal.
                    block[np.arange(ROWS), first + np.arange(ROWS)] = 0
                    out[:first + ROWS] += block.T @ shared.value[first:first + ROWS]
            for part in range(PARTS):
                block = out[part * terms // PARTS:(part + 1) * terms // PARTS]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block.tobytes()], pa.binary())], names=["part", "sum"])

        def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, np.float64) for x in sorted(rows["sum"]))
            return pd.DataFrame({"part": [key[0]], "sum": [total.tobytes()]})

        summed = counts.mapInArrow(work, "part int, sum binary").groupBy("part").applyInPandas(add, "part int, sum binary")
        parts = sorted((r["part"], r["sum"]) for r in summed.collect())  # one matrix of a fixed size
        shared.unpersist()
        return weight * np.concatenate([np.frombuffer(x, np.float64) for _, x in parts]).reshape(q.shape)

    rng = np.random.default_rng(SEED)
    q, _ = np.linalg.qr(rng.standard_normal((terms, RANK + SPARE)))
    for _ in range(1 + POWERS):
        q, _ = np.linalg.qr(multiply(q))
    values, inner = np.linalg.eigh(q.T @ multiply(q))
    values, inner = values[::-1][:RANK], inner[:, ::-1][:, :RANK]
    good = values > max(values[0], 1e-12) * 1e-9
    return (weight * (q @ inner[:, good]) / np.sqrt(values[good])).astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def common_order(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item's words."""
    full = (1 << size) - 1
    v = full
    for w in words:
        m = masks.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def anchors_of(p: Passages, idf: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By width: (sorted hashes of the rarest runs of so many words of the items, item, place of the run in it)."""
    weight = np.append(0, np.cumsum(idf[terms_of(p.words)]))
    found: dict[int, list[tuple[int, int, int]]] = {}
    for item, (a, b) in enumerate(zip(p.rows[:-1].tolist(), p.rows[1:].tolist(), strict=True)):
        width = min(ANCHOR, b - a)
        if width:
            at = int(np.argmax(weight[a + width:b + 1] - weight[a:b - width + 1]))
            found.setdefault(width, []).append((int(window_hashes(p.words[a + at:a + at + width], width)[0]), item, at))
    out = {}
    for width, runs in found.items():
        runs.sort()
        out[width] = (np.array([r[0] for r in runs], np.uint64), np.array([r[1] for r in runs]), np.array([r[2] for r in runs]))
    return out


def whole(p: Passages, known: Items) -> set[tuple[int, int]]:
    """(row, item) for each item that stands in a row word for word."""
    out: set[tuple[int, int]] = set()
    for width, (codes, item, place) in known.anchors.items():
        runs = window_hashes(p.words, width)
        low = np.searchsorted(codes, runs)
        at = np.flatnonzero(codes[np.minimum(low, len(codes) - 1)] == runs)
        row = np.searchsorted(p.rows, at, "right") - 1
        for k, first, own in zip(at.tolist(), low[at].tolist(), row.tolist(), strict=True):
            j, end = first, int(p.rows[own + 1])
            while j < len(codes) and codes[j] == runs[k]:
                which = int(item[j])
                start, words = k - int(place[j]), known.full[which]
                if (own, which) not in out and start >= p.rows[own] and start + len(words) <= end and (
                        p.words[start:start + len(words)].tolist() == words):
                    out.add((own, which))
                j += 1
    return out


@dataclass
class Items:
    """Benchmark items ready for search: passage vectors, words, bit masks and answer words.

    `pairs` are the (term, item) pairs that occur, as term * items + item in order; those of term t begin at
    starts[t]. The same holds for the words in `vocabulary` with `holders` (items), `lists` (where they begin) and `times` (how
    often the item has the word). The vectors of an item's passages begin at pieces[item].
    """

    ids: list
    vectors: np.ndarray
    pieces: np.ndarray
    words: list[list[int]]
    masks: list[dict[int, int]]
    answers: list[set[int]]
    pairs: np.ndarray
    starts: np.ndarray
    vocabulary: np.ndarray
    lists: np.ndarray
    holders: np.ndarray
    times: np.ndarray
    sizes: np.ndarray
    need: np.ndarray
    full: list[list[int]]
    anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: list, texts: list[str], table: np.ndarray, idf: np.ndarray, rare: np.ndarray) -> Items:
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        p = Passages.of(data, offsets, rare)
        vectors, _, _, owner = p.vectors(table)
        words, masks, answers = [], [], []
        for i, (a, b) in enumerate(zip(p.rows[:-1], p.rows[1:], strict=True)):
            own = p.words[a:b].tolist()
            mask: dict[int, int] = {}
            for k, w in enumerate(own):
                mask[w] = mask.get(w, 0) | 1 << k
            # The answer: the rarer half of the words of the last sentence.
            tail = (texts[i] or "").rstrip(" .!?\n").replace("!", ".").replace("?", ".").rpartition(".")[2]
            last = Passages.of(np.frombuffer(tail.encode(), np.uint8), np.array([0, len(tail.encode())]), rare).words
            weight = idf[terms_of(last)]
            words.append(own)
            masks.append(mask)
            answers.append({int(w) for w in last[weight >= np.median(weight)]} if len(last) else set())
        need = np.ceil(BAG_SHARE * np.minimum([len(w) for w in words], BAG_WORDS)).astype(np.int64)
        which = np.repeat(np.arange(len(ids)), np.diff(p.rows))
        pairs = np.unique(terms_of(p.words) * len(ids) + which)
        starts = np.searchsorted(pairs, np.arange((1 << TERM_BITS) + 1) * len(ids))
        vocabulary, place = np.unique(p.words, return_inverse=True)
        holders, times = np.unique(place * len(ids) + which, return_counts=True)
        lists = np.searchsorted(holders, np.arange(len(vocabulary) + 1) * len(ids))
        return cls(ids, unit(vectors), np.searchsorted(owner, np.arange(len(ids) + 1)), words, masks, answers, pairs, starts,
                   vocabulary, lists, holders % max(len(ids), 1), times, np.diff(p.rows), need,
                   [p.full.words[a:b].tolist() for a, b in zip(p.full.rows[:-1], p.full.rows[1:], strict=True)], anchors_of(p.full, idf))

    def check(self, item: int, region: list[int]) -> tuple[bool, float, float]:
        """(whether the region holds the item, share of its words in common order, share of its answer)."""
        size = len(self.words[item])
        share = common_order(self.masks[item], size, region) / size
        answer = self.answers[item]
        said = len(answer.intersection(region)) / len(answer) if answer else 1.0
        if size < SHORT:
            return False, share, said
        return share >= PLAIN_SHARE or (share >= ANSWER_SHARE and said >= ANSWER_WORDS), share, said


def common_words(p: Passages, start: np.ndarray, stop: np.ndarray, items: Items, which: np.ndarray) -> np.ndarray:
    """Whether the passages have enough words of the items, in any order."""
    terms, total = np.append(terms_of(p.words), 0), np.zeros(len(start), np.int64)
    for k in range(2 * HALF):
        at = start + k
        code = terms[np.minimum(at, len(terms) - 1)] * len(items.ids) + which
        place = np.minimum(np.searchsorted(items.pairs, code), len(items.pairs) - 1)
        total += (items.pairs[place] == code) & (at < stop)
    return total >= items.need[which]


def spread_out(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from start on, `size` of them, of all ranges one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def region(p: Passages, start: np.ndarray, stop: np.ndarray, row: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, end) of the passages with so many words on each side, inside their rows."""
    return np.maximum(start - size, p.rows[row]), np.minimum(stop + size, p.rows[row + 1])


def coverable(p: Passages, items: Items, first: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Whether enough words of the items occur between first and end at all, for a common order of ANSWER_SHARE of them.

    A common subsequence has no more words than the item has at places whose word occurs in the region.
    """
    good = np.zeros(len(item), bool)
    if not len(items.vocabulary) or not len(item) or not len(p.words):
        return good
    v = np.minimum(np.searchsorted(items.vocabulary, p.words), len(items.vocabulary) - 1)
    at = np.flatnonzero(items.vocabulary[v] == p.words)
    # The place before each one with the same word.
    order = np.lexsort((at, v[at]))
    again = v[at][order][1:] == v[at][order][:-1]
    earlier = np.full(len(at), -1)
    earlier[order[1:][again]] = at[order[:-1][again]]
    # Words lead to items; places are in order, so a stable sort by item orders them inside the items.
    many = items.lists[v[at] + 1] - items.lists[v[at]]
    entry = spread_out(items.lists[v[at]], many)
    order = np.argsort(items.holders[entry].astype(np.uint16 if len(items.ids) <= 1 << 16 else np.int64), kind="stable")
    entry, hit = entry[order], np.repeat(np.arange(len(at)), many)[order]
    width = len(p.words) + 1
    code, before, weight = items.holders[entry] * width + at[hit], earlier[hit], items.times[entry]
    low, high = np.searchsorted(code, item * width + first), np.searchsorted(code, item * width + end)
    need = ANSWER_SHARE * items.sizes[item] - 1e-9
    # First by all occurrences, then by different words.
    total = np.append(0, np.cumsum(weight))
    left = np.flatnonzero((total[high] - total[low] >= need) & (items.sizes[item] >= SHORT))
    step = max(1, ENTRIES // 32)
    for lo in range(0, len(left), step):
        part = left[lo:lo + step]
        size = high[part] - low[part]
        own = spread_out(low[part], size)
        which = np.repeat(np.arange(len(size)), size)
        new = before[own] < first[part][which]
        good[part] = np.bincount(which, weight[own] * new, len(size)) >= need[part]
    return good


def sharing(p: Passages, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, row) of all passages, and (passage, item) for each pair that can hold the item by its words.

    Words lead to the items that have them. A passage with enough words of an item has at least half of them in one of its
    halves, so pairs are counted for each half first, and only those with so many are looked at.
    """
    start, stop, row, first = p.spans()
    none = np.zeros(0, np.int64)
    if not len(start) or not len(items.pairs):
        return start, stop, row, none, none
    size, begin = len(items.ids), p.halves()[0]
    half = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(p.words))))
    terms = terms_of(p.words)
    many = items.starts[terms + 1] - items.starts[terms]
    # Halves are taken together as long as they lead to about ENTRIES pairs.
    ends = np.append(0, np.cumsum(many))
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + ENTRIES, ENTRIES)))
    cuts = np.unique(np.append(0, np.append(begin, len(terms))[np.searchsorted(begin, cuts)]))
    found = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = many[a:b]
        code = np.repeat(half[a:b], own) * size + items.pairs[spread_out(items.starts[terms[a:b]], own)] % size
        code.sort()
        run = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else none
        count = np.diff(np.append(run, len(code)))
        many_enough = 2 * count >= items.need[code[run] % size]
        found.append((code[run][many_enough], count[many_enough]))
    known, count = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (none, none)
    half, item = known // size, known % size
    fewer = (items.need[item] - 1) // 2  # words of a half that is not known, at most

    def together(other: np.ndarray) -> np.ndarray:
        """Whether the words of a half and of its neighbour can be enough."""
        place = np.minimum(np.searchsorted(known, other * size + item), max(len(known) - 1, 0))
        return count + np.where(known[place] == other * size + item, count[place], fewer) >= items.need[item]

    # The passages that begin with the half, and with the one before it.
    place = np.full(len(begin) + 1, -1)
    place[first] = np.arange(len(first))
    two_halves = stop - start > HALF
    one, two = place[half], np.where(half > 0, place[half - 1], -1)
    one = np.where((one >= 0) & np.where(two_halves[one], together(half + 1), count >= items.need[item]), one, -1)
    two = np.where((two >= 0) & two_halves[two] & together(half - 1), two, -1)
    code = np.concatenate([one[one >= 0] * size + item[one >= 0], two[two >= 0] * size + item[two >= 0]])
    code.sort()
    code = code[np.append(True, code[1:] != code[:-1])] if len(code) else code
    passage, item = code // size, code % size
    good = coverable(p, items, *region(p, start[passage], stop[passage], row[passage], items.sizes[item]), item)
    passage, item = passage[good], item[good]
    good = common_words(p, start[passage], stop[passage], items, item)
    return start, stop, row, passage[good], item[good]


def hits(p: Passages, known: Items, latent: np.ndarray) -> list[tuple]:
    """(row, item, common share, answer share, cosine) for each item that a row of the block holds."""
    start, stop, row, passage, item = sharing(p, known)
    best: dict[tuple[int, int], tuple] = {pair: (1.0, 1.0, 1.0) for pair in whole(p.full, known)}
    for at in range(0, len(passage), 2048):
        part, own = np.unique(passage[at:at + 2048], return_inverse=True)
        vectors = unit(p.sums(latent, start[part], stop[part]))
        several = known.pieces[item[at:at + 2048] + 1] - known.pieces[item[at:at + 2048]]
        which = np.repeat(own, several)
        piece = spread_out(known.pieces[item[at:at + 2048]], several)
        near = np.einsum("ij,ij->i", vectors[which], known.vectors[piece])
        pair = np.repeat(np.arange(at, at + len(own)), several)
        for k in np.flatnonzero(near >= COSINE).tolist():
            j, i = int(item[pair[k]]), int(passage[pair[k]])
            holder = int(row[i])
            if best.get((holder, j), (0,))[0] >= 1.0:
                continue
            a, b = (int(x) for x in region(p, start[i], stop[i], row[i], known.sizes[j]))
            held, share, answer = known.check(j, p.words[a:b].tolist())
            if held and share > best.get((holder, j), (-1.0,))[0]:
                best[holder, j] = (share, answer, float(near[k]))
    return sorted((holder, j, *rest) for (holder, j), rest in best.items())


def item_groups(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str,
                item_text_col: str) -> Iterator[tuple]:
    """Broadcasts of (items, latent table, kept terms), with about ITEMS items or ITEM_BYTES of texts in each."""
    idf = inverse_frequencies(docs, text_col)
    usable = benchmark.where(F.length(item_text_col) > 0).select(
        F.col(item_col).cast("bigint").alias("item"), F.col(item_text_col).alias("words"))
    rare = kept_terms(idf, usable)
    table = latent_space(docs, idf, rare, text_col)
    count, size = usable.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("words")), F.lit(0))).first()
    groups = max(1, -(-count // ITEMS), -(-size // ITEM_BYTES))
    for k in range(groups):
        part = usable.where(F.pmod(F.xxhash64("item", "words"), F.lit(groups)) == k).orderBy("item", "words").collect()
        items = Items.of([r["item"] for r in part], [r["words"] for r in part], table, idf, rare)
        yield docs.sparkSession.sparkContext.broadcast((items, table, rare))


def search(docs: DataFrame, shared, id_col: str, text_col: str) -> DataFrame:
    def work(batch: pa.RecordBatch):
        known, latent, rare = shared.value
        found = [(lo + own, *rest) for lo, p in passages_of(batch.column(1), rare) for own, *rest in hits(p, known, latent)]
        if found:
            rows, which, share, said, cosine = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows)), pa.array([known.ids[i] for i in which], pa.int64()),
                 pa.array(share, pa.float64()), pa.array(said, pa.float64()), pa.array(cosine, pa.float64())],
                names=["doc_id", "item_id", "common_share", "answer_share", "cosine"])

    return map_batches(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col)), work,
                       "doc_id bigint, item_id bigint, common_share double, answer_share double, cosine double")


def without_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, that hold no benchmark item in the sense of `contaminated`.

    Rows are filtered where they are read, so no join is needed and rows with equal or NULL ids are
    judged each by itself.
    """
    at = docs.columns.index(text_col)

    def filtered(rows: DataFrame, shared) -> DataFrame:
        def work(batch: pa.RecordBatch):
            known, latent, rare = shared.value
            good = np.ones(batch.num_rows, bool)
            for lo, p in passages_of(batch.column(at), rare):
                good[[lo + own for own, *_ in hits(p, known, latent)]] = False
            yield batch.filter(pa.array(good))

        return map_batches(rows, work, rows.schema)

    left = docs
    for shared in item_groups(docs, benchmark, id_col, text_col, item_col, item_text_col):
        left = filtered(left, shared)
    return left


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, common_share, answer_share, cosine for every document that holds a benchmark item.

    Items that stand in a document word for word (without signs and case) are found by their rarest run of
    ANCHOR words, or of all words, and have the figures 1.0. For the others, words without the most common ones (see `kept_terms`)
    are cut into passages that overlap by half. A candidate is a passage of any document that shares enough words with an item, in any
    order, and has a cosine of COSINE or more with a passage of the item in whitened latent coordinates of their TF-IDF
    vectors. Words lead to items first (`sharing`), so vectors are only made for passages that can be candidates. Around one, the
    longest common subsequence of words is taken. An item is held if it covers PLAIN_SHARE of the item's words, or
    ANSWER_SHARE of them together with half of the answer words (the rarer ones of its last sentence);
    items of fewer than SHORT words must be found word for word. idf covers all documents.

    Items are searched in groups of ITEMS, with one scan of the documents for each, so what is
    sent to the tasks has a fixed size. NULL and empty texts, on either side, hold nothing and are held by
    nothing. A NULL doc_id is returned as such; rows with equal ids are judged each by itself, and
    repeated items give a row each. Other columns are left out. Empty tables give no rows.
    """
    out = None
    for shared in item_groups(docs, benchmark, id_col, text_col, item_col, item_text_col):
        found = search(docs, shared, id_col, text_col)
        out = found if out is None else out.unionByName(found)
    return out
