"""Hard negatives against all pairs in plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import bond, queries


def by_hand(rows, chosen, positives=5, negatives=3):
    """rows: (vec_id, label, vector); the result as sorted tuples."""
    rows = [r for r in rows if None not in r[:2] and r[2] is not None and None not in r[2]]
    out = []
    for a, (anchor, label, v) in enumerate(rows):
        if not chosen(anchor):
            continue
        score = [(-sum(x * y for x, y in zip(v, w)), i, b) for b, (i, _, w) in enumerate(rows)]
        near = sorted(s for s in score if s[2] != a and rows[s[2]][1] == label)[:positives]
        for p, positive, _ in near:
            fit = sorted((s, i) for s, i, b in score if rows[b][1] != label and 50 * -p <= 100 * -s <= 95 * -p)
            out += [(anchor, positive, k + 1, i, -p, -s) for k, (s, i) in enumerate(fit[:negatives])]
    return sorted(out)


def vectors_of(seed, size, dims, top, labels):
    rng = random.Random(seed)
    return [(rng.randrange(size // 2) if rng.random() < 0.1 else i, rng.choice(labels),
             [rng.randrange(-top, top + 1) for _ in range(dims)]) for i in range(size)]


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, label bigint, vector array<bigint>")
    df = df.withColumns({n: F.lit("x") for n in ("rid", "anchor", "score", "rank", "nth")})
    out = bond.mine(df, F.col("vec_id") % 10 == 0, **kw)
    assert out.columns == COLUMNS
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("dims, top, labels", [(12, 40, [1, 2, 3]), (3, 2, [0, 0, 0, 7]), (1, 1, [1, 2])])
def test_equals_all_pairs(spark, monkeypatch, dims, top, labels):
    rows = vectors_of(dims, 300, dims, top, labels)
    monkeypatch.setattr(bond, "ANCHOR_VALUES", 10 * dims)  # several groups of anchors
    assert mined(spark, rows) == by_hand(rows, lambda i: i % 10 == 0)


def test_large_whole_numbers(spark):
    rows = [(i, lab, [x << 24 for x in v]) for i, lab, v in vectors_of(4, 120, 5, 30, [1, 2])]
    assert mined(spark, rows) == by_hand(rows, lambda i: i % 10 == 0)
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1 << 40])])


def test_hard_rows(spark):
    same = [(i, i % 2, [3, 4, 0]) for i in range(100, 160)]  # ties
    rows = same + [(10, 0, [3, 4]), (10, 0, [3, 4]), (20, 1, [2]), (30, None, [1]), (None, 0, [3, 4, 0]), (40, 0, None),
                   (50, 0, [1, None]), (60, 0, []), (70, 5, [9, 9, 9]), (11, 1, [2, 3, 1]), (12, 1, [2, 2, 2])]
    padded = [(i, lab, None if v is None else v + [0] * (3 - len(v))) for i, lab, v in rows]
    got = mined(spark, rows)
    assert got == by_hand(padded, lambda i: i % 10 == 0)
    assert len([r for r in got if r[0] == 10]) > 0
    assert mined(spark, rows, positives=1, negatives=100) == by_hand(padded, lambda i: i % 10 == 0, 1, 100)


def test_no_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1]), (2, 2, [1])]) == []  # no anchor


def test_small_blocks_give_the_same_and_bounds_drop_rows():
    rng = np.random.default_rng(3)
    columns = (rng.standard_normal((32, 4000)) * 50 * np.linspace(3, 0.1, 32)[:, None]).astype(np.int64).astype(float)
    label, ids = rng.integers(0, 4, 4000), np.arange(4000)
    anchors = bond.Anchors(ids[:20], label[:20], columns.T[:20].copy(), [])
    results = []
    for step in (64, 4000):
        best = bond.Best(20, 5)
        for at in range(0, 4000, step):
            own = slice(at, at + step)
            bond.scan_positives(bond.Block(ids[own], ids[own], label[own], columns[:, own]), anchors, best)
        results.append((best.score.tolist(), best.vec_id.tolist()))
    assert results[0] == results[1]
    block = bond.Block(ids, ids, label, columns)
    scan = bond.Scan(columns[:, 0].copy(), block, 0, 4000, np.arange(4000))
    fifth = np.sort(columns[:, 0] @ block.columns)[-5]
    sizes = []
    while scan.advance():
        scan.keep(scan.most >= fifth)
        sizes.append(len(scan.alive))
    assert sizes[1] < 4000 and sizes == sorted(sizes, reverse=True) and sizes[-1] == 5


def test_unusable_components(spark):
    rows = [(1, 1, [0.5, -0.001]), (2, 1, [float("nan"), 1.0]), (3, 1, [float("inf"), 1.0]), (4, 1, [None, 1.0]), (5, 1, None),
            (6, None, [1.0]), (None, 1, [1.0]), (7, 1, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, e array<float>").where(bond.usable("vec_id", "label", "e"))
    assert {r["vec_id"]: r["v"] for r in df.select("vec_id", bond.quantised("e").alias("v")).collect()} == {1: [128, -1], 7: []}


def test_query_relabels_every_seventh(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, i % 3, [rng.randrange(-100, 100) / 128 for _ in range(6)]) for i in range(200)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, [int(np.floor(256 * x)) for x in v]) for i, lab, v in rows]
    got = sorted(tuple(r) for r in queries.QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect())
    assert got == by_hand(whole, lambda i: i % 50 == 0) and got
