"""Skewed groups, ties and tiny buckets against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickerloom.operators import ordering


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(list("abcdef"), n))
    value = np.where(rng.random(n) < 0.35, 7.25, np.round(rng.normal(0, 10, n), 2))
    return pd.DataFrame({"id": rng.permutation(n).astype("int64"), "key": key, "value": value,
                         "dt": pd.to_datetime("2020-01-01") + pd.to_timedelta(rng.integers(0, 9, n), unit="D")})


@pytest.mark.parametrize("bucket_rows", [7, 500, 10**6])
@pytest.mark.parametrize("by", [[], ["key"]])
def test_row_index(spark, skewed, bucket_rows, by):
    df = spark.createDataFrame(skewed).withColumn("dt", F.to_date("dt"))
    got = ordering.row_index(df, "dt", "id", by, bucket_rows=bucket_rows).toPandas().set_index("id")["row_id"]
    ordered = skewed.sort_values(["dt", "id"])
    want = ordered.groupby(by)["id"].cumcount() if by else pd.Series(range(len(ordered)), index=ordered.index)
    want = pd.Series(want.to_numpy(), index=ordered["id"].to_numpy())
    assert (got.sort_index() == want.sort_index()).all()


@pytest.mark.parametrize("bits", [1, 4, 11])
def test_exact_quantiles(spark, skewed, bits):
    df = spark.createDataFrame(skewed)
    got = ordering.exact_quantiles(df, ["value", "id"], [0.0, 0.1, 0.5, 0.99, 1.0], ["key"], bits=bits).toPandas()
    assert len(got) == 2 * skewed["key"].nunique()
    for row in got.itertuples():
        want = skewed.loc[skewed["key"] == row.key, row.metric].quantile([0.0, 0.1, 0.5, 0.99, 1.0])
        assert np.allclose([row.q0, row.q1, row.q2, row.q3, row.q4], want)


def test_quantiles_skip_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,), (2.0,), (4.0,)], "x double")
    assert ordering.exact_quantiles(df, ["x"], [0.5]).first()["q0"] == 2.0


@pytest.mark.parametrize("by", [[], ["key"]])
def test_area_under_curve_with_ties(spark, skewed, by):
    from tickerloom.operators.metrics import roc_auc
    pdf = skewed.assign(y=(skewed["id"] % 3 == 0).astype(int))
    got = roc_auc(spark.createDataFrame(pdf), by, "y", "value").toPandas()
    for row in got.to_dict("records"):
        part = pdf[pdf["key"] == row["key"]] if by else pdf
        pos, neg = part.loc[part.y == 1, "value"].to_numpy(), part.loc[part.y == 0, "value"].to_numpy()
        wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
        assert row["roc_auc"] == pytest.approx(wins / len(pos) / len(neg))


def test_take_by_hash_takes_the_quota(spark, skewed):
    df = spark.createDataFrame(skewed)
    sizes = skewed.groupby("key").size()
    quotas = pd.DataFrame({"key": sizes.index, "quota": [min(n, 100 + 37 * i) for i, n in enumerate(sizes)]})
    table = spark.createDataFrame(quotas)
    marked = ordering.take_by_hash(df, ["key"], lambda sizes: sizes.join(table, "key"), "id").toPandas()
    assert len(marked) == len(skewed)
    hashed = ((skewed["id"] + 1) * 48271 * 69621) % 2147483647
    rank = hashed.groupby(skewed["key"]).rank(method="first")
    want = set(skewed.loc[rank <= skewed["key"].map(quotas.set_index("key")["quota"]), "id"])
    assert set(marked.loc[marked["picked"], "id"]) == want


def test_hash_accepts_any_id(spark):
    from tickerloom.functions.numbers import hash_order
    df = spark.createDataFrame([(0,), (2**62,), (-5,)], "id long")
    assert all(0 <= r[0] < 2147483647 for r in df.select(hash_order("id")).collect())
