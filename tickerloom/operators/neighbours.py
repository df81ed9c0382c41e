"""Exact nearest neighbours in any number of columns, and synthetic rows of the smaller classes.

Points are cut into cells by recursive halving: every node is cut across the axis in which it is
widest. A cell's box bounds the distance of every point in it from below. A point searches its own
cell, then the nearest few cells, and then only those whose bound is still within its k-th
distance, which is an exact stop. No pair of rows is ever emitted: each task keeps k candidates
per point.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions.numbers import HASH_MODULUS, hash_order
from tickerloom.operators.ordering import take_by_hash
from tickerloom.operators.rollup import union_tables
from tickerloom.session import durable, ship_package

#: Rows of a cell, about, and the most cells that are made; with more rows than both allow, cells grow.
CELL_ROWS, MAX_CELLS = 2048, 1 << 15
#: Sampled points for each cell, from which the cuts are taken.
SAMPLE_PER_CELL = 32
#: Cells searched before the k-th distance is taken again.
FIRST_VISITS = 4
QUERY_CHUNK = 256
FOUND = "qid long, near_d array<double>, near_id array<long>, near_v array<array<double>>"


@dataclass
class CellTree:
    """A complete binary tree of cuts; node i has the children 2i + 1 and 2i + 2, leaves are cells."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def grow(cls, sample: np.ndarray, depth: int) -> CellTree:
        inner, width = (1 << depth) - 1, sample.shape[1]
        tree = cls(depth, np.zeros(inner, np.int64), np.full(inner, np.inf),
                   np.full((2 * inner + 1, width), np.inf), np.full((2 * inner + 1, width), -np.inf))
        parts = {0: sample}
        for node in range(inner):
            own = parts.pop(node)
            if len(own):
                tree.axis[node] = int(np.argmax(np.ptp(own, axis=0)))
                tree.cut[node] = np.median(own[:, tree.axis[node]])
            right = own[:, tree.axis[node]] >= tree.cut[node]
            parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
        return tree

    @property
    def cells(self) -> int:
        return 1 << self.depth

    def place(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        node, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[rows, self.axis[node]] >= self.cut[node])
        return node - (self.cells - 1)

    def set_boxes(self, cell: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Boxes of the cells that hold points, and of the nodes above them."""
        self.low[self.cells - 1 + cell], self.high[self.cells - 1 + cell] = low, high
        for node in reversed(range(self.cells - 1)):
            self.low[node] = np.minimum(self.low[2 * node + 1], self.low[2 * node + 2])
            self.high[node] = np.maximum(self.high[2 * node + 1], self.high[2 * node + 2])

    def within(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, bound, cell) of all cells whose box is within a point's radius, nearest first for each point."""
        found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            node, own = waiting.pop()
            x = points[own]
            away = np.maximum(np.maximum(self.low[node] - x, x - self.high[node]), 0.0)
            bound = np.sqrt((away ** 2).sum(axis=1))
            near = np.isfinite(bound) & (bound <= radius[own])
            if not near.any():
                continue
            if node >= self.cells - 1:
                found.append((own[near], bound[near], np.full(int(near.sum()), node - self.cells + 1)))
            else:
                waiting += [(2 * node + 1, own[near]), (2 * node + 2, own[near])]
        point, bound, cell = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((cell, bound, point))
        return point[order], bound[order], cell[order]


def closest(queries: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int):
    """Per query: up to k (distance, position) pairs, nearest first, ties by id."""
    for start in range(0, len(queries), QUERY_CHUNK):
        part = queries[start:start + QUERY_CHUNK]
        d2 = np.zeros((len(part), len(points)))
        for j in range(points.shape[1]):
            d2 += (part[:, j, None] - points[None, :, j]) ** 2
        for row in d2:
            near = np.flatnonzero(row <= np.partition(row, k - 1)[k - 1]) if len(row) > k else np.arange(len(row))
            near = near[np.lexsort((ids[near], row[near]))][:k]
            yield np.sqrt(row[near]), near


def with_slack(distance):
    """A radius that rounding cannot make too small."""
    return distance * (1 + 1e-9) + 1e-9


def neighbour_lists(df: DataFrame, cols: Sequence[str], id_col: str, k: int) -> tuple[DataFrame, DataFrame, int]:
    """(rows: id, v; lists: v, near, visited; number of cells). near has up to k + 1 rows, the row itself among them.

    Rows with equal values share one search, and at most k + 1 of them are searched for, which is
    all that k neighbours can need. Cuts come from about SAMPLE_PER_CELL rows for each cell,
    drawn by a hash of the id; they only decide which task handles a row.
    """
    spark = df.sparkSession
    ship_package(spark)
    xs = [f"x{i}" for i in range(len(cols))]
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(cols, xs)])
    copy = F.row_number().over(Window.partitionBy(*xs).orderBy("id"))
    points = durable(rows.withColumn("copy", copy).where(F.col("copy") <= k + 1))
    total = points.count()
    depth = min(MAX_CELLS.bit_length() - 1, max(0, math.ceil(math.log2(max(total, 1) / CELL_ROWS))))
    wanted = SAMPLE_PER_CELL << depth
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sample = points.where(draw < int((1 << 30) * min(1.0, wanted / max(total, 1)))).select(*xs).limit(2 * wanted).toPandas()
    tree = CellTree.grow(sample.to_numpy().reshape(-1, len(xs)), depth)
    cuts = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=cuts.value.place(batch[xs].to_numpy()))

    placed = durable(points.mapInPandas(place, "id long, " + ", ".join(f"{x} double" for x in xs) + ", copy int, cell long"))
    boxes = placed.groupBy("cell").agg(F.array(*[F.min(x) for x in xs]).alias("low"), F.array(*[F.max(x) for x in xs]).alias("high")).collect()
    if boxes:
        tree.set_boxes(np.array([b["cell"] for b in boxes]), np.array([b["low"] for b in boxes]), np.array([b["high"] for b in boxes]))
    boxed = spark.sparkContext.broadcast(tree)

    def lists_of(found, points_: np.ndarray, ids: np.ndarray) -> dict:
        pairs = list(found)
        return {"near_d": [d for d, _ in pairs], "near_id": [ids[n] for _, n in pairs], "near_v": [points_[n].tolist() for _, n in pairs]}

    def home(group: pd.DataFrame) -> pd.DataFrame:
        every, ids, own = group[xs].to_numpy(), group["id"].to_numpy(), int(group["cell"].iloc[0])
        asked = group[group["copy"] == 1]
        if not len(asked):
            return pd.DataFrame([], columns=["qid", "v", "near_d", "near_id", "near_v", "bounds", "cells"])
        at = asked[xs].to_numpy()
        found = lists_of(closest(at, every, ids, k + 1), every, ids)
        radius = np.array([with_slack(d[-1]) if len(d) > k else np.inf for d in found["near_d"]])
        point, bound, cell = boxed.value.within(at, radius)
        other = cell != own
        point, bound, cell = point[other], bound[other], cell[other]
        starts = np.searchsorted(point, np.arange(len(at) + 1))
        split = [slice(a, b) for a, b in zip(starts[:-1], starts[1:])]
        return pd.DataFrame({"qid": asked["id"].to_numpy(), "v": list(at), **found, "bounds": [bound[s] for s in split], "cells": [cell[s] for s in split]})

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["qid", "near_d", "near_id", "near_v"])
        every, ids = right[xs].to_numpy(), right["id"].to_numpy()
        found = lists_of(closest(np.stack(left["v"]), every, ids, k + 1), every, ids)
        return pd.DataFrame({"qid": left["qid"].to_numpy(), **found})

    def near() -> Column:
        return F.transform(F.arrays_zip("near_d", "near_id", "near_v"), lambda n: F.struct(
            n["near_d"].alias("d"), n["near_id"].alias("id"), n["near_v"].alias("v")))

    def visit(asked: DataFrame, cells: Column) -> DataFrame:
        """asked with `near` after a search of further cells."""
        probes = asked.select("qid", "v", F.explode(cells).alias("cell"))
        hits = probes.groupBy("cell").cogroup(placed.select("cell", "id", *xs).groupBy("cell")).applyInPandas(search, FOUND)
        more = hits.select("qid", near().alias("n")).groupBy("qid").agg(F.flatten(F.collect_list("n")).alias("_more"))
        best = F.slice(F.array_sort(F.concat("near", F.coalesce("_more", F.array().cast("array<struct<d:double,id:bigint,v:array<double>>>")))), 1, k + 1)
        return asked.join(more, "qid", "left").withColumn("near", best).drop("_more")

    first = placed.groupBy("cell").applyInPandas(home, f"v array<double>, {FOUND}, bounds array<double>, cells array<long>")
    first = durable(first.select("qid", "v", near().alias("near"), "bounds", "cells"))
    second = visit(first, F.slice("cells", 1, FIRST_VISITS))
    reach = F.when(F.size("near") > k, with_slack(F.get("near", F.lit(k))["d"])).otherwise(float("inf"))
    later = F.filter(F.slice(F.arrays_zip("bounds", "cells"), FIRST_VISITS + 1, tree.cells), lambda c: c["bounds"] <= F.col("_reach"))
    second = durable(second.withColumn("_reach", reach).withColumn("later", F.transform(later, lambda c: c["cells"])))
    visited = 1 + F.least(F.size("cells"), F.lit(FIRST_VISITS)) + F.size("later")
    lists = visit(second, F.col("later")).select("v", "near", visited.alias("visited"))
    return rows.select("id", F.array(*xs).alias("v")), lists, tree.cells


def nearest(df: DataFrame, cols: Sequence[str], id_col: str, k: int) -> DataFrame:
    """(id, v, near): the k nearest other rows of each row, as an array of (d, id, v); ties by id."""
    rows, lists, _ = neighbour_lists(df, cols, id_col, k)
    return rows.join(lists, "v").select("id", "v", F.slice(F.filter("near", lambda n: n["id"] != F.col("id")), 1, k).alias("near"))


def synthetic(rows: DataFrame, cols: Sequence[str], label: str, value, size: int, wanted: int, id_col: str, k: int, seed: int) -> DataFrame:
    """`wanted` rows between the `size` rows of one class and their neighbours."""
    near = nearest(rows, cols, id_col, k).withColumn("_g", F.lit(0))
    shared = take_by_hash(near, ["_g"], lambda n: n.withColumn("quota", F.lit(wanted % size)), "id", seed)
    copies = F.lit(wanted // size) + F.col("picked").cast("int")
    rows = shared.where((copies > 0) & (F.size("near") > 0)).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies.cast("bigint"))))
    draw = hash_order(hash_order("id", seed) + F.col("copy") * 7919)
    chosen = F.get("near", (draw % F.size("near")).cast("int"))
    share = hash_order(draw, 1) / F.lit(float(HASH_MODULUS))
    made = rows.withColumns({"_to": chosen, "segment_share": share}).withColumn(
        "_s", F.zip_with("v", F.col("_to.v"), lambda a, b: a + F.col("segment_share") * (b - a)))
    return made.select(
        F.col("id").alias("base_id"), F.col("_to.id").alias("neighbour_id"), "copy", "segment_share",
        *[F.get("_s", F.lit(i)).alias(c) for i, c in enumerate(cols)], F.lit(value).alias(label))


def smote(df: DataFrame, cols: Sequence[str], label: str, id_col: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Synthetic rows that bring every class to the size of the largest; rows without a label are left out.

    Every row of a class serves equally often (the remainder goes to the rows with the
    smallest id hashes). Neighbour and position on the segment come from hashes as well. With classes of one size, no
    row is made.
    """
    sizes = {r[label]: r["n"] for r in df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    largest = max(sizes.values(), default=0)
    smaller = sorted(c for c in sizes if sizes[c] < largest) or sorted(sizes)[:1]
    return union_tables([synthetic(df.where(F.col(label) == c), cols, label, c, sizes[c], largest - sizes[c], id_col, k, seed) for c in smaller])


def oversample(df: DataFrame, cols: Sequence[str], label: str, id_col: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Real rows plus synthetic rows; `synthetic` tells them apart."""
    made = smote(df, cols, label, id_col, k, seed).select(*cols, label, F.lit(1).alias("synthetic"))
    real = df.select(*[F.col(c).cast("double").alias(c) for c in cols], label, F.lit(0).alias("synthetic"))
    return real.unionByName(made)
