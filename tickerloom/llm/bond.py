"""Hard negatives by a vertical scan of vector components with bounds (BOND)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.llm.arrow import stored
from tickerloom.session import ship_package

#: Components of the anchors that are sent to all tasks at once, and of the rows that are scanned at once.
ANCHOR_VALUES, BLOCK_VALUES = 1 << 21, 1 << 20
#: Components read between two looks at the bounds, and candidates that are finished without a further look.
STEP, FEW = 8, 32
#: Products of a task, about; more rows or anchors make more tasks.
TASK_PRODUCTS = 1 << 35
NOTHING = np.iinfo(np.int64).min
FOUND = "anchor bigint, nth int, score bigint, vec_id bigint, rid bigint"


def quantised(vector: Column | str, scale: float = 256.0) -> Column:
    """Components as whole numbers: floor(scale * x), x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(id_col: str, label_col: str, vector_col: str) -> Column:
    """Rows with an id, a label, and a vector whose components are all finite numbers."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(finite, F.lit(False))


def columns_of(lists: pa.Array, dims: int, kind: type) -> np.ndarray:
    """(dims x rows) matrix, one contiguous line for each component; a shorter vector ends with zeros."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    if (sizes == dims).all():
        return np.ascontiguousarray(values.reshape(-1, dims).T) if dims else np.zeros((0, len(sizes)), kind)
    out = np.zeros((dims, len(sizes)), kind)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = values
    return out


@dataclass
class Anchors:
    """A group of anchors: row keys, labels, vectors, and for each its score windows (nth, least, greatest)."""

    rids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    windows: list[list[tuple[int, int, int]]]


class Block:
    """Rows with their components as columns, in order of their labels, and the bounds of every component."""

    def __init__(self, rid: np.ndarray, vec_id: np.ndarray, label: np.ndarray, columns: np.ndarray):
        order = np.argsort(label, kind="stable")
        self.rid, self.vec_id, self.label, self.columns = rid[order], vec_id[order], label[order], columns[:, order]
        self.bounds: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def span(self, label: int) -> tuple[int, int]:
        return int(np.searchsorted(self.label, label)), int(np.searchsorted(self.label, label, "right"))

    def limits(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) value of each component among some rows."""
        if (first, last) not in self.bounds:
            part = self.columns[:, first:last]
            self.bounds[first, last] = part.min(axis=1), part.max(axis=1)
        return self.bounds[first, last]


class Scan:
    """Inner products of one anchor with some rows, a few components at a time.

    Components come in order of falling magnitude in the anchor. `least` and `most` bound the
    score of each row that is left, by the least and greatest contributions of the components not read yet.
    """

    def __init__(self, anchor: np.ndarray, block: Block, first: int, last: int, alive: np.ndarray):
        self.block, self.alive = block, alive
        low, high = block.limits(first, last)
        order = np.argsort(-np.abs(anchor), kind="stable")
        weight = anchor[order]
        a, b = weight * low[order], weight * high[order]
        none = np.zeros(1, anchor.dtype)
        self.rest_low = np.append(np.cumsum(np.minimum(a, b)[::-1])[::-1], none)
        self.rest_high = np.append(np.cumsum(np.maximum(a, b)[::-1])[::-1], none)
        self.order, self.weight, self.read = order, weight, 0
        self.partial = np.zeros(len(alive), anchor.dtype)

    def advance(self) -> bool:
        """Read further components; False if all were read before."""
        size = len(self.order)
        if self.read >= size:
            return False
        end = size if len(self.alive) <= FEW else min(self.read + STEP, size)
        own = self.order[self.read:end]
        self.partial = self.partial + self.weight[self.read:end] @ self.block.columns[own[:, None], self.alive]
        self.read = end
        return True

    @property
    def least(self) -> np.ndarray:
        return self.partial + self.rest_low[self.read]

    @property
    def most(self) -> np.ndarray:
        return self.partial + self.rest_high[self.read]

    def keep(self, good: np.ndarray) -> None:
        if not good.all():
            self.alive, self.partial = self.alive[good], self.partial[good]


class Best:
    """The `size` best (score, vec_id, rid) of each list: higher scores first, ties by smaller ids."""

    def __init__(self, lists: int, size: int):
        self.size = size
        self.score = np.full((lists, size), NOTHING, np.int64)
        self.vec_id, self.rid = np.zeros((2, lists, size), np.int64)

    def threshold(self, k: int) -> int:
        return int(self.score[k, -1])

    def add(self, k: int, score: np.ndarray, vec_id: np.ndarray, rid: np.ndarray) -> None:
        score, vec_id, rid = (np.append(x[k], y) for x, y in ((self.score, score), (self.vec_id, vec_id), (self.rid, rid)))
        order = np.lexsort((rid, vec_id, ~score))[:self.size]  # ~ turns the order of whole numbers round
        self.score[k], self.vec_id[k], self.rid[k] = score[order], vec_id[order], rid[order]


def scan_positives(block: Block, anchors: Anchors, best: Best) -> None:
    """Add the best rows of the anchors' own labels to `best` (a list for each anchor)."""
    for k, (rid, label) in enumerate(zip(anchors.rids.tolist(), anchors.labels.tolist(), strict=True)):
        first, last = block.span(label)
        alive = np.arange(first, last)
        alive = alive[block.rid[first:last] != rid]
        if not len(alive):
            continue
        scan = Scan(anchors.vectors[k], block, first, last, alive)
        while scan.advance():
            least = scan.least
            bound = best.threshold(k)
            if len(least) >= best.size:
                bound = max(bound, int(np.partition(least, len(least) - best.size)[len(least) - best.size]))
            scan.keep(scan.most >= bound)
        best.add(k, scan.partial.astype(np.int64), block.vec_id[scan.alive], block.rid[scan.alive])


def scan_windows(block: Block, anchors: Anchors, best: Best, per_anchor: int) -> None:
    """Add the best rows of other labels inside each window to `best` (`per_anchor` lists for each anchor)."""
    rows = len(block.rid)
    for k, label in enumerate(anchors.labels.tolist()):
        windows = anchors.windows[k]
        first, last = block.span(label)
        if not windows or last - first == rows:
            continue
        alive = np.append(np.arange(first), np.arange(last, rows))
        # A row must reach the least of what the windows still take, and not exceed the greatest.
        bottom = min(max(low, best.threshold(k * per_anchor + nth)) for nth, low, _ in windows)
        top = max(high for _, _, high in windows)
        scan = Scan(anchors.vectors[k], block, 0, rows, alive)
        while len(scan.alive) and scan.advance():
            scan.keep((scan.most >= bottom) & (scan.least <= top))
        score = scan.partial.astype(np.int64)
        for nth, low, high in windows:
            inside = (score >= max(low, best.threshold(k * per_anchor + nth))) & (score <= high)
            if inside.any():
                own = scan.alive[inside]
                best.add(k * per_anchor + nth, score[inside], block.vec_id[own], block.rid[own])


def blocks(batches: Iterator[pa.RecordBatch], dims: int, kind: type) -> Iterator[Block]:
    """Blocks of rows (rid, vec_id, label, vector)."""
    step = max(1, BLOCK_VALUES // max(dims, 1))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            rid, vec_id, label, vector = (batch.column(c).slice(at, step) for c in range(4))
            yield Block(*(x.to_numpy(zero_copy_only=False) for x in (rid, vec_id, label)), columns_of(vector, dims, kind))


def scanned(rows: DataFrame, anchors: Anchors, size: int, per_anchor: int, dims: int, kind: type) -> DataFrame:
    """The `size` best rows of each list from every task: positives, or negatives if the anchors have windows."""
    spark = rows.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(anchors)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = shared.value
        best = Best(len(group.rids) * per_anchor, size)
        for block in blocks(batches, dims, kind):
            if group.windows:
                scan_windows(block, group, best, per_anchor)
            else:
                scan_positives(block, group, best)
        which, place = np.nonzero(best.score != NOTHING)
        yield pa.RecordBatch.from_arrays(
            [pa.array(group.rids[which // per_anchor]), pa.array((which % per_anchor).astype(np.int32)), pa.array(best.score[which, place]),
             pa.array(best.vec_id[which, place]), pa.array(best.rid[which, place])], names=["anchor", "nth", "score", "vec_id", "rid"])

    return rows.select("rid", "vec_id", "label", "vector").mapInArrow(work, FOUND)


def first_of(found: DataFrame, size: int) -> DataFrame:
    """The `size` best rows of each (anchor, nth), numbered from 1."""
    order = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least_percent: int = 50,
         most_percent: int = 95, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the hard negatives of each anchor.

    Vectors are whole numbers, and a score is their inner product with the anchor. Positives are the
    anchor's `positives` best other rows of its label. For each of them, the `negatives` best rows of other labels whose
    score is between least_percent and most_percent of the positive's score are returned. Higher scores come
    first, ties go to smaller ids. No row is left out: bounds only skip rows that cannot be in the result.

    The rows are dealt evenly to tasks by their position, so no label, id or vector can make a task large.
    Anchors go to all tasks in groups of ANCHOR_VALUES components, with two scans of the rows for each group; a task returns its
    best few for each anchor, and these meet by anchor.

    A row without an id, a label or a vector, or with a NULL component takes no part. A shorter vector
    counts as ending with zeros. Rows with equal ids are rows of their own, each an anchor if chosen. Other columns are
    left out. Scores must fit in 63 bits by the largest component, otherwise this raises ValueError. Empty
    tables, anchors without positives, and windows without rows give no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"),
                          F.col(vector_col).cast("array<bigint>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("chosen"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()
                      & F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False)))
    peak = F.greatest(*(F.abs(f("vector").cast("double")) for f in (F.array_max, F.array_min)))
    count, chosen, dims, peak = rows.agg(F.count(F.lit(1)), F.count_if("chosen"), F.max(F.size("vector")), F.max(peak)).first()
    dims, bound = dims or 0, (dims or 0) * (peak or 0.0) ** 2
    if bound >= 2.0 ** 62:
        raise ValueError("components are too large for whole scores of 64 bits")
    kind = np.float64 if bound < 2.0 ** 52 else np.int64
    groups = max(1, -(-chosen * max(dims, 1) // ANCHOR_VALUES))
    parts = max(spark.sparkContext.defaultParallelism, -(-count * (chosen // groups + 1) * max(dims, 1) // TASK_PRODUCTS))
    rows = stored(rows.repartition(int(parts)).withColumn("rid", F.monotonically_increasing_id()))
    out = None
    for k in range(groups):
        own = rows.where("chosen").where(F.pmod(F.xxhash64("rid"), F.lit(groups)) == k).orderBy("rid").collect()
        matrix = np.zeros((len(own), dims), kind)
        for at, r in enumerate(own):
            matrix[at, :len(r["vector"])] = r["vector"]
        anchors = Anchors(np.array([r["rid"] for r in own], np.int64), np.array([r["label"] for r in own], np.int64), matrix, [])
        near = first_of(scanned(rows, anchors, positives, 1, dims, kind), positives).select(
            "anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        near = stored(near)
        place = {int(rid): at for at, rid in enumerate(anchors.rids)}
        anchors.windows = [[] for _ in own]
        for r in near.collect():  # at most `positives` for each anchor of the group
            low, high = -(-least_percent * r["positive_score"] // 100), most_percent * r["positive_score"] // 100
            if low <= high:
                anchors.windows[place[r["anchor"]]].append((r["place"] - 1, low, high))
        if not own:
            anchors.windows = [[]]
        hard = first_of(scanned(rows, anchors, negatives, positives, dims, kind), negatives).select(
            "anchor", (F.col("nth") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        names = rows.where("chosen").select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        found = hard.join(near, ["anchor", "place"]).join(names, "anchor").select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
        out = found if out is None else out.unionByName(found)
    return out
