"""Quantiles, moments and box figures from two scans against pandas."""

import numpy as np
import pandas as pd
import pytest

from tickerloom.operators import profile


def table(spark, kind):
    rng = np.random.default_rng(4)
    n = 60_000
    x = {"normal": rng.normal(size=n), "ties": rng.integers(0, 7, n).astype(float), "heavy": rng.standard_cauchy(n)}[kind]
    pdf = pd.DataFrame({"g": np.where(np.arange(n) % 3 == 0, "a", np.where(np.arange(n) % 997 == 1, "few", "b")), "x": x, "y": -x ** 2})
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("whole", [10_000, 100])
@pytest.mark.parametrize("kind", ["normal", "ties", "heavy"])
def test_describe_and_box_equal_pandas(spark, monkeypatch, kind, whole):
    monkeypatch.setattr(profile, "WHOLE", whole)
    if whole == 100:
        monkeypatch.setattr(profile, "MARGIN", 0.02)  # small groups need more room
    pdf, df = table(spark, kind)
    got = {(r["g"], r["metric"]): r for r in profile.describe(df, ["x", "y"], ["g"]).collect()}
    assert len(got) == 6
    for (g, c), r in got.items():
        v = pdf[pdf.g == g][c]
        assert r["n"] == len(v) and np.allclose([r["mean"], r["std"], r["min"], r["max"]], [v.mean(), v.std(), v.min(), v.max()])
        assert np.allclose([r["p25"], r["p50"], r["p75"]], v.quantile([0.25, 0.5, 0.75]))
    for r in profile.box_stats(df, "x", ["g"]).collect():
        v = pdf[pdf.g == r["g"]]["x"]
        a, m, b = v.quantile([0.25, 0.5, 0.75])
        inside = v[(v >= a - 1.5 * (b - a)) & (v <= b + 1.5 * (b - a))]
        assert np.allclose([r["q1"], r["median"], r["q3"], r["whisker_low"], r["whisker_high"]], [a, m, b, inside.min(), inside.max()])
        assert r["outliers"] == len(v) - len(inside)


def test_null_groups_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan")), ("a", None), ("a", 3.0)], "g string, x double")
    got = {r["g"]: (r["n"], r["p50"]) for r in profile.describe(df, ["x"], ["g"]).collect()}
    assert got == {None: (1, 1.0), "a": (1, 3.0)}
    box = {r["g"]: (r["median"], r["whisker_low"], r["outliers"]) for r in profile.box_stats(df, "x", ["g"]).collect()}
    assert box == {None: (1.0, 1.0, 0), "a": (3.0, 3.0, 0)}
    assert profile.describe(df.where("false"), ["x"]).count() == 0


def test_source_is_read_twice(spark, tmp_path):
    spark.range(50_000).selectExpr("id % 5 as g", "cast(id * id % 7919 as double) as x").write.parquet(f"{tmp_path}/t")
    reads = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    df = spark.read.parquet(f"{tmp_path}/t").mapInArrow(count, "g bigint, x double")
    profile.describe(df, ["x"], ["g"]).collect()
    assert reads.value == 2 * 50_000
    profile.box_stats(df, "x", ["g"]).collect()
    assert reads.value == 4 * 50_000
