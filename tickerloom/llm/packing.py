"""Packing by power-of-two decomposition: pieces of binary lengths, one document per sequence."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from tickerloom.llm.arrow import blocks_of, kept_columns, map_batches, text_bytes
from tickerloom.llm.words import span_hashes, word_spans

#: Encoded words remembered by a task, at most.
CACHE_WORDS = 3_000_000
#: Pieces in a batch that leaves a task, at most.
PIECES = 5_000
LETTER, SIGN = np.zeros(256, bool), np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
SIGN[0x21:0x7F] = True
SIGN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
PIECE = StructType([StructField("start", LongType()), StructField("length", LongType()),
                    StructField("doc_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))])


class WordEncoder:
    """Token ids of whole texts, word by word.

    For a tokenizer that lower-cases, drops white space and never joins a letter with a sign, the
    ids of a text are those of its runs of letters or signs in turn. A task encodes each run once
    and then looks runs up by their 64-bit hashes, a block of texts at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def encode_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each run). Plain words go through the tokenizer as one text, which is faster; the rest one by one."""
        if all(map(str.isalpha, runs)):
            joined = self.tokenizer.encode(" ".join(runs), add_special_tokens=False)
            ids, cuts = np.array(joined.ids, np.int32), np.flatnonzero(np.diff(np.array(joined.word_ids, dtype=float))) + 1
            if len(cuts) + 1 == len(runs):
                return ids, np.diff(np.concatenate([[0], cuts, [len(ids)]]))
        found = [x.ids for x in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.int32), np.fromiter(map(len, found), np.int64, len(found))

    def learn(self, hashes: np.ndarray, runs: list[str]) -> None:
        plain = sorted(range(len(runs)), key=lambda i: not runs[i].isalpha())
        found, counts = zip(*(self.encode_runs([runs[k] for k in plain[i:i + 1000]]) for i in range(0, len(runs), 1000)), strict=True)
        if len(self.known) + len(runs) > CACHE_WORDS:
            self.clear()
        sizes = np.concatenate(counts)
        begins = len(self.flat) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, *found])
        new = hashes[plain]
        order = np.argsort(new, kind="stable")
        at = np.searchsorted(self.known, new[order])
        self.known = np.insert(self.known, at, new[order])
        self.begin = np.insert(self.begin, at, begins[order])
        self.size = np.insert(self.size, at, sizes[order])

    def find(self, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.known, kinds)
        near = np.minimum(at, len(self.known) - 1)
        return at, (self.known[near] == kinds) & (at < len(self.known)) if len(self.known) else np.zeros(len(kinds), bool)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, id offsets of the rows) of a block of texts."""
        cuts, plain = offsets, b"<|" not in data.tobytes()
        if plain and len(data):
            # A special token can stand in a text only with these two signs; else letters end a run.
            cuts = np.union1d(offsets, np.flatnonzero(LETTER[data[:-1]] & SIGN[data[1:]]) + 1)
        starts, ends = word_spans(data, cuts)
        hashes, rows = span_hashes(data, starts, ends, lower=plain), np.searchsorted(starts, offsets)
        if not plain:
            hashes = hashes ^ np.uint64(0x5851F42D4C957F2D)
        kinds, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, there = self.find(kinds)
        if not there.all():
            if len(self.known) + int((~there).sum()) > CACHE_WORDS:
                self.clear()
                there[:] = False
            new = np.flatnonzero(~there)
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            raw = data.tobytes()
            self.learn(kinds[new], [raw[s:e].lower().decode() if plain else raw[s:e].decode() for s, e in spans])
            at, _ = self.find(kinds)
        counts = self.size[at][which] if len(kinds) else np.zeros(0, np.int64)
        ends_at = np.cumsum(counts)
        shift = (self.begin[at][which] if len(kinds) else counts) - (ends_at - counts)
        ids = self.flat[np.repeat(shift, counts) + np.arange(int(counts.sum()))]
        return ids, np.concatenate([[0], ends_at])[rows]


def binary_lengths(tokens: int, most: int) -> list[int]:
    """Lengths of the pieces of a document: as many of `most` as fit, then falling powers of two."""
    rest = tokens % most
    return [most] * (tokens // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, text_col: str = "text", max_tokens: int = 4096,
         keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per piece: the kept columns, start, length, doc_tokens, ids, sequence_id, offset.

    Every document is tokenised whole, gets `end_id`, and is cut into full sequences and pieces
    with the lengths of the binary digits of the rest. A piece is a sequence by itself: its
    length is a power of two, so nothing is padded, no sequence crosses documents, and `length`
    is the bucket that a reader batches by. No row is moved: the work is one scan.

    max_tokens must be a power of two. A NULL or empty text is the end id alone. Rows with equal
    ids are packed each by itself. The tokenizer must
    drop white space, lower-case and cut between letters and signs. An empty table gives
    no rows. Columns of the input named like result columns are replaced.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    results = [*PIECE.names, "sequence_id", "offset"]
    keep = kept_columns(docs, keep, results)
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    state: dict = {}

    def work(batch: pa.RecordBatch):
        if "encode" not in state:
            state["encode"] = WordEncoder(tokenizer_path)
        encode = state["encode"]
        data, offsets = text_bytes(batch.column(len(keep)))
        for first, last in blocks_of(offsets):
            ids, bounds = encode(data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
            row, starts, lengths, totals = [], [], [], []
            counts = np.diff(bounds) + 1
            for i, total in enumerate(counts.tolist(), first):
                at = 0
                for size in binary_lengths(total, max_tokens):
                    row.append(i)
                    starts.append(at)
                    lengths.append(size)
                    totals.append(total)
                    at += size
            out = np.insert(ids, bounds[1:], end_id)
            for lo in range(0, len(row), PIECES):
                hi = min(lo + PIECES, len(row))
                sizes = np.cumsum([0, *lengths[lo:hi]])
                lists = pa.ListArray.from_arrays(pa.array(sizes.astype(np.int32)), pa.array(out[:sizes[-1]], pa.int32()))
                out = out[sizes[-1]:]
                kept = [batch.column(c).take(pa.array(row[lo:hi], pa.int64())) for c in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*kept, *(pa.array(x[lo:hi], pa.int64()) for x in (starts, lengths, totals)), lists],
                    names=[*keep, *PIECE.names])

    schema = StructType([*rows.select(*keep).schema.fields, *PIECE.fields])
    pieces = map_batches(rows, work, schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})
