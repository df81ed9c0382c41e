"""Running a function over Arrow batches of a DataFrame, and views of text columns as bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from tickerloom.session import durable, ship_package

#: Texts are worked on in blocks of about this many bytes, so that temporary arrays stay small.
BLOCK_BYTES = 1 << 20
#: Bytes of a batch of rows that is sent to Python, about (or one row).
BATCH_BYTES = 8 << 20


def give_back() -> None:
    """Return freed memory to the system, since a Python worker lives on for later tasks."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """mapInArrow with the package shipped to the executors, batches bounded by bytes, and memory given back after a task."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        try:
            for batch in batches:
                yield from work(batch)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def stored(df: DataFrame) -> DataFrame:
    """A reliable checkpoint with columns of its own, so that it can be joined and united with itself."""
    kept = durable(df)
    return kept.select(*[F.col(c).alias(c) for c in kept.columns])


def hashed_part(id_col: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo `parts`; NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets) of a string column; NULL counts as an empty text."""
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0]:starts[-1]], starts - starts[0]


def blocks_of(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges with at most `most` bytes each, or one row."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def kept_columns(df: DataFrame, keep: Sequence[str], results: Sequence[str]) -> list[str]:
    """Columns to pass through; a result column replaces an input column of its name."""
    return [c for c in keep if c not in results and c in df.columns]
