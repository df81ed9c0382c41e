"""GARCH over blocks of time against the fit of a whole series."""

import datetime as dt

import numpy as np
import pytest

from tickerloom.operators import garch, garch_blocks
from tickerloom.operators.garch_blocks import Garch


def returns(n: int, seed: int = 4) -> np.ndarray:
    rng = np.random.default_rng(seed)
    h, out = 1.0, []
    for z in rng.normal(size=n):
        out.append(0.1 + z * np.sqrt(h))
        h = 0.05 + 0.1 * (out[-1] - 0.1) ** 2 + 0.85 * h
    return np.array(out)


def frame(spark, r):
    first = dt.date(2000, 1, 3)
    rows = [(first + dt.timedelta(days=i), float(x)) for i, x in enumerate(r)]
    return spark.createDataFrame(rows[::-1], "dt date, r double")


def test_blocks_keep_order_and_leads(spark, monkeypatch):
    monkeypatch.setattr(garch_blocks, "BLOCK_ROWS", 40)
    r = returns(200)
    rows = garch_blocks.time_blocks(frame(spark, r), "r", "dt", lead=2).rows.orderBy("block").collect()
    assert [len(x["r"]) for x in rows] == [40] * 5
    assert np.allclose(np.concatenate([x["r"] for x in rows]), r)
    assert [x["lead"] for x in rows] == [[]] + [r[k - 2:k].tolist() for k in (40, 80, 120, 160)]


@pytest.mark.parametrize("g", [Garch(0.1, 0.05, (0.1,), (0.85,)), Garch(0.0, 0.2, (0.05, 0.1), (0.5, 0.2, 0.05)), Garch(0.1, 0.4, (0.3,), ())])
def test_path_and_gradient_do_not_depend_on_blocks(spark, monkeypatch, g):
    r = returns(230)
    df = frame(spark, r)
    e2 = (r - g.mu) ** 2
    whole = garch.variances(e2, g.omega, g.alpha, g.beta or (0.0,), garch.start_variance(e2))
    monkeypatch.setattr(garch_blocks, "BLOCK_ROWS", 37)
    path = garch_blocks.variance_path(df, "r", "dt", g, scale=1.0).orderBy("dt").toPandas()
    assert np.allclose(path["cond_variance"], whole[:230]) and np.allclose(path["garch_cond_variance"], whole[1:231])
    blocks = garch_blocks.time_blocks(df, "r", "dt", lead=2)
    flat = garch_blocks.flat(g)

    def moved(k, d):
        x = flat.copy()
        x[k] += d
        p = len(g.alpha)
        return Garch(x[0], x[1], tuple(x[2:2 + p]), tuple(x[2 + p:]))
    models = [g] + [moved(k, s * 1e-5) for k in range(len(flat)) for s in (1, -1)]
    (loss, gradient), *others = garch_blocks.likelihood(blocks, models)
    assert np.isclose(loss, 0.5 * float(np.sum(np.log(2 * np.pi * whole[:230]) + e2 / whole[:230])))
    numeric = [(others[2 * k][0] - others[2 * k + 1][0]) / 2e-5 for k in range(len(flat))]
    assert np.allclose(gradient, numeric, rtol=1e-4, atol=1e-4)


@pytest.mark.parametrize("p, q, mean", [(1, 1, "zero"), (1, 1, "constant"), (2, 1, "zero")])
def test_optimum_equals_the_fit_of_the_whole_series(spark, monkeypatch, p, q, mean):
    monkeypatch.setattr(garch_blocks, "BLOCK_ROWS", 150)
    r = returns(600)
    one, found = garch.fit(r, p, q, mean), garch_blocks.fit_series(frame(spark, r), "r", "dt", p, q, mean, scale=1.0)
    assert found["status"] == "ok" and found["n"] == 600
    assert found["aic"] <= one["aic"] + 1e-4
    if (p, q) == (1, 1):
        assert np.allclose([found["omega"], *found["alpha"], *found["beta"]], [one["omega"], *one["alpha"], *one["beta"]], atol=2e-3)


def test_series_without_a_model(spark):
    assert garch_blocks.fit_series(frame(spark, returns(8)), "r", "dt") == {"n": 8, "status": "short"}
    assert garch_blocks.fit_series(frame(spark, np.ones(50)), "r", "dt")["status"] == "constant"
    assert garch_blocks.variance_path(frame(spark, returns(3)).where("false"), "r", "dt", Garch(0, 1, (0.1,), (0.8,))).count() == 0
