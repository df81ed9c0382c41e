import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tickerloom.operators import balance, joins, neighbours, rollup, vectors


def day(n):
    return dt.date(2021, 1, n)


@pytest.fixture(scope="module")
def news(spark):
    rows = [(3, day(1), "b"), (1, day(1), "a"), (2, day(4), ""), (4, day(4), None), (5, day(6), "c"), (6, day(8), "d")]
    return spark.createDataFrame(rows, "news_id long, dt date, content string")


def test_previous_text_skips_dates_without_text(news):
    got = {r["dt"].day: r["prev_day_news"] for r in joins.asof_prev_text(news, "content", "news_id").collect()}
    assert got == {1: joins.NO_NEWS, 4: "a b", 6: "a b", 8: "c"}


def test_previous_rows(news):
    got = {(r["dt"].day, r["news_id"]) for r in joins.asof_prev_rows(news, news).collect()}
    assert got == {(4, 1), (4, 3), (6, 2), (6, 4), (8, 5)}


def test_offset_join_drops_weekend_news(spark, news):
    bars = spark.createDataFrame([(day(5), 1.0), (day(7), 2.0)], "dt date, open double")
    assert sorted(r["news_id"] for r in joins.offset_join(news, bars).collect()) == [2, 4, 5]


def test_previous_vector(spark):
    df = spark.createDataFrame([(day(1), [1.0, 2.0]), (day(1), [3.0, 4.0]), (day(3), [5.0, 5.0])], "dt date, emb array<float>")
    got = {r["dt"].day: r["prev_day_embedding"] for r in joins.asof_prev_vector(df, "emb", 2).collect()}
    assert got == {1: [0.0, 0.0], 3: [2.0, 3.0]}


def test_ordered_texts_over_many_ranges(spark):
    ids = [0, 9_999, 10_000, 25_000, 7]
    df = spark.createDataFrame([("k", i, f"t{i}") for i in ids], "k string, i long, t string")
    assert rollup.ordered_texts(df, ["k"], ["t"], "i", "|").first()["t"] == "t0|t7|t9999|t10000|t25000"


def test_rollup_volume_variants(spark):
    df = spark.createDataFrame([(day(1), i, 1.0, 2.0, 3.0, 10, "T", "g", "c") for i in (1, 2)],
                               "dt date, news_id long, open double, close double, high double, volume long, title string, tag string, content string")
    assert rollup.daily_rollup(df, "news_id").first()["volume"] == 20
    assert rollup.daily_rollup(df, "news_id", volume="first").first()["volume"] == 10


def brute(points, k):
    out = {}
    for i, v in points.items():
        d = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in points.items() if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


@pytest.mark.parametrize("cell_rows", [8, 2048])
def test_neighbours_with_many_copies(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell_rows)
    rng = np.random.default_rng(11)
    pts = {i: (np.array([1.0, 1.0]) if i % 3 == 0 else rng.normal(size=2).round(2)) for i in range(150)}
    df = spark.createDataFrame([(i, float(v[0]), float(v[1])) for i, v in pts.items()], "id long, a double, b double")
    got = {r["id"]: [n["id"] for n in r["near"]] for r in neighbours.nearest(df, ["a", "b"], "id", 5).collect()}
    assert got == brute(pts, 5)


@pytest.mark.parametrize("kind, most", [("clusters", 0.2), ("normal", 0.9)])
def test_neighbours_in_eight_columns_visit_few_cells(spark, monkeypatch, kind, most):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 32)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 8))
    if kind == "clusters":
        x = 0.2 * x + 3 * rng.normal(size=(40, 8))[rng.integers(0, 40, 2000)]
    pts = dict(enumerate(x))
    cols = [f"c{i}" for i in range(8)]
    df = spark.createDataFrame([(i, *v.tolist()) for i, v in pts.items()], "id long, " + ", ".join(f"{c} double" for c in cols))
    rows, lists, cells = neighbours.neighbour_lists(df, cols, "id", 5)
    assert cells == 64
    assert lists.agg({"visited": "avg"}).first()[0] < most * cells
    got = {r["id"]: [n["id"] for n in r["near"]] for r in neighbours.nearest(df, cols, "id", 5).collect()}
    assert got == brute(pts, 5)


def test_neighbours_of_few_rows(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0)], "id long, a double")
    assert {r["id"]: [n["id"] for n in r["near"]] for r in neighbours.nearest(df, ["a"], "id", 5).collect()} == {1: [2], 2: [1]}
    assert neighbours.nearest(df.where("false"), ["a"], "id", 5).count() == 0


def test_smote_fills_all_smaller_classes(spark):
    df = spark.range(100).selectExpr("id", "id * 1.0 as a", "case when id < 60 then 0 when id < 85 then 1 when id < 99 then 2 end as y")
    sizes = neighbours.oversample(df, ["a"], "y", "id").where("y is not null").groupBy("y", "synthetic").count().collect()
    assert {(r["y"], r["synthetic"]): r["count"] for r in sizes} == {(0, 0): 60, (1, 0): 25, (1, 1): 35, (2, 0): 14, (2, 1): 46}


def test_smote_fills_the_smaller_class(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame({"id": range(100), "a": rng.normal(size=100), "b": rng.normal(size=100), "y": [1] * 23 + [0] * 77})
    df = spark.createDataFrame(pdf)
    made = neighbours.smote(df, ["a", "b"], "y", "id").toPandas()
    assert len(made) == 54 and (made["y"] == 1).all()
    at = pdf.set_index("id")[["a", "b"]]
    base, to = at.loc[made["base_id"]].to_numpy(), at.loc[made["neighbour_id"]].to_numpy()
    assert np.allclose(made[["a", "b"]], base + made[["segment_share"]].to_numpy() * (to - base))
    both = neighbours.oversample(df, ["a", "b"], "y", "id").groupBy("y").count().collect()
    assert {r["count"] for r in both} == {77}


def test_stratified_and_undersample(spark):
    df = spark.range(103).selectExpr("id", "case when id < 70 then 0 when id < 95 then 1 else 2 end as y")
    out = balance.stratified_split(df, 0.2, "y", "id").groupBy("y", "part").count().collect()
    tests = {r["y"]: r["count"] for r in out if r["part"] == "test"}
    assert sum(tests.values()) == 21 and tests[0] == 14 and tests[1] == 5 and tests[2] == 2
    assert {r["count"] for r in balance.undersample(df, "y", "id").groupBy("y").count().collect()} == {8}


def test_pca_equals_singular_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5)) + 4
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, emb array<double>")
    got = np.stack(vectors.pca(df, "emb", 3).orderBy("id").toPandas()["emb"])
    centred = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(centred @ vt[:3].T))


def test_fusion_is_repeatable(spark):
    df = spark.createDataFrame([([1.0, -2.0], [0.5, 0.1, -0.3])], "a array<double>, b array<double>")
    first = vectors.fuse_vectors(df, "a", "b", 2, 3, width=4).first()["market_vector"]
    m = vectors.fusion_layers(2, 3, 4, 42)

    def through(v, w):
        return np.array(v) @ w[:-1] + w[-1]

    def lift(v, w):
        z = through(v, w)
        return np.where(z < 0, 0.01 * z, z)
    sides = [through(through(lift([0.5, 0.1, -0.3], m[1]), m[2]), m[3]), through(through(lift([1.0, -2.0], m[0]), m[4]), m[5])]
    assert np.allclose(first, through(np.concatenate(sides), m[6]))
    assert all(np.abs(w).max() <= 1 / np.sqrt(len(w) - 1) and abs(w.mean()) < 0.3 for w in m)
    missing = spark.createDataFrame([([1.0, -2.0], None), (None, [0.5, 0.1, -0.3])], "a array<double>, b array<double>")
    assert [r["market_vector"] for r in vectors.fuse_vectors(missing, "a", "b", 2, 3, width=4).collect()] == [None, None]
