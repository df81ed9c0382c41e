"""Quality scores by nearest-neighbour voting in a latent-semantic space."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickerloom.llm.arrow import blocks_of, kept_columns, map_batches, text_bytes
from tickerloom.llm.words import word_hashes
from tickerloom.session import small_side

#: Hashed terms, latent dimensions, labelled documents kept as neighbours (at most about), and votes.
TERMS, RANK, SAMPLE, VOTES = 2048, 48, 3000, 15
#: The first terms stand for words that repeat the word before them.
REPEATS = 8
#: Dense rows worked on at a time.
ROWS = 256


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows x TERMS) counts of hashed runs of three bytes and of words said twice in a row."""
    out = np.zeros((len(offsets) - 1, TERMS), np.float32)
    for first, last in blocks_of(offsets):
        part, cuts = data[offsets[first]:offsets[last]].astype(np.uint32), offsets[first:last + 1] - offsets[first]
        for lo in range(0, max(len(part) - 2, 0), 1 << 20):  # one text can be longer than a block
            chunk = part[lo:lo + (1 << 20) + 2]
            slots = ((chunk[:-2] * np.uint32(0x9E3779B1)) ^ (chunk[1:-1] * np.uint32(0x85EBCA6B)) ^ (chunk[2:] * np.uint32(0xC2B2AE35)))
            slots = ((slots * np.uint32(0x27D4EB2F)) >> np.uint32(33 - TERMS.bit_length())).astype(np.int64)
            slots = np.maximum(slots, REPEATS)
            bounds = np.clip(cuts - lo, 0, len(chunk))
            for k in range(last - first):
                a, b = bounds[k], bounds[k + 1] - (2 if cuts[k + 1] - lo <= len(chunk) else 0)
                if b > a:
                    out[first + k] += np.bincount(slots[a:b], minlength=TERMS)
        words, rows = word_hashes(data[offsets[first]:offsets[last]], cuts)
        again = np.concatenate([[0], np.cumsum(words[1:] == words[:-1]), [0]]) if len(words) else np.zeros(2)
        for k in np.flatnonzero(np.diff(rows) > 1):
            out[first + k, :REPEATS] = again[rows[k + 1] - 1] - again[rows[k]]
    return out


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of unit length: logarithmic counts times idf; rows without terms stay zero."""
    rows = np.log1p(counts) * idf
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Smoothed idf of every hashed term over all documents."""
    def count(batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column(0))
        have = np.zeros(TERMS, np.int64)
        for lo in range(0, len(offsets) - 1, ROWS):
            cut = offsets[lo:lo + ROWS + 1]
            have += (term_counts(data[cut[0]:cut[-1]], cut - cut[0]) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS)), pa.array(have),
                                          pa.array(np.full(TERMS, len(offsets) - 1))], names=["term", "have", "rows"])

    found = map_batches(docs.select(text_col), count, "term bigint, have bigint, rows bigint").groupBy("term").agg(
        F.sum("have").alias("have"), F.sum("rows").alias("rows")).collect()
    idf = np.zeros(TERMS)
    for r in found:
        idf[r["term"]] = np.log((1 + r["rows"]) / (1 + r["have"])) + 1
    return idf.astype(np.float32)


class Voters:
    """Labelled documents as vectors in the latent space: projection, unit vectors, labels."""

    def __init__(self, idf: np.ndarray, counts: np.ndarray, labels: np.ndarray, rank: int = RANK):
        rows = weigh(counts, idf)
        self.mean = rows.mean(axis=0)
        _, _, right = np.linalg.svd(rows - self.mean, full_matrices=False)
        self.idf, self.project, self.labels = idf, right[:rank].T.astype(np.float32), labels.astype(np.float32)
        self.vectors = self.place(counts)
        self.prior = float(labels.mean())

    def place(self, counts: np.ndarray) -> np.ndarray:
        spots = (weigh(counts, self.idf) - self.mean) @ self.project
        return spots / np.maximum(np.linalg.norm(spots, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray, votes: int = VOTES) -> np.ndarray:
        """Share of label 1 among the nearest voters, weighted by similarity; the prior if all weights are 0."""
        near = self.place(counts) @ self.vectors.T
        k = min(votes, near.shape[1])
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 0) ** 4
        total = weight.sum(axis=1)
        return np.where(total > 0, (weight * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-12), self.prior)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, text_col: str = "text", id_col: str = "doc_id",
        sample: int = SAMPLE) -> Voters | None:
    """Voters from the documents that `labels` (id and a 0/1 label) names; None without labelled documents.

    The idf covers all documents. Neighbours are a sample of about `sample` labels, drawn by a hash
    of the id before any text is read: half of each label, as far as there are so many. Other
    labels and NULL ids are left out.
    """
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__label"))
    sizes = {r[0]: r[1] for r in rows.groupBy("__label").count().collect()}
    if not sizes:
        return None
    draw = F.pmod(F.xxhash64(F.col("__id").cast("string")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("__label") == 1, min(1.0, sample / 2 / sizes.get(1, 1))).otherwise(min(1.0, sample / 2 / sizes.get(0, 1)))
    drawn = small_side(rows.where(draw < share))
    chosen = docs.join(drawn, docs[id_col] == drawn["__id"]).select(F.col(text_col).alias("__text"), "__label")

    def vectors(batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column(0))
        counts = term_counts(data, offsets)
        yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in counts], pa.binary()), batch.column(1)],
                                         names=["counts", "label"])

    found = map_batches(chosen, vectors, "counts binary, label int").collect()
    found.sort(key=lambda r: (bytes(r["counts"]), r["label"]))
    if not found:
        return None
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in found])
    return Voters(inverse_frequencies(docs, text_col), counts, np.array([r["label"] for r in found]))


def vote(docs: DataFrame, voters: Voters | None, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
         votes: int = VOTES) -> DataFrame:
    """The kept columns with a score per row: how likely label 1 is.

    Every document's vector is compared with those of all voters, a block of rows at a time; the
    `votes` most similar ones vote with the fourth power of their cosine. The voters have a fixed
    size and go to every task. A NULL or empty text is compared as a zero vector; without
    voters the score is 0.5. Rows with equal ids are scored each by itself. Input columns named
    like result columns are replaced.
    """
    keep = kept_columns(docs, keep, ["score"])
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def work(batch: pa.RecordBatch):
        data, offsets = text_bytes(batch.column(len(keep)))
        known = shared.value
        scores = [np.zeros(0)]
        for lo in range(0, len(offsets) - 1, ROWS):
            cut = offsets[lo:lo + ROWS + 1]
            if known is None:
                scores.append(np.full(len(cut) - 1, 0.5))
            else:
                scores.append(np.clip(known.score(term_counts(data[cut[0]:cut[-1]], cut - cut[0]), votes), 0.0, 1.0))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(len(keep))),
                                          pa.array(np.concatenate(scores).astype(np.float64))], names=[*keep, "score"])

    return map_batches(rows, work, StructType([*rows.select(*keep).schema.fields, StructField("score", DoubleType())]))
