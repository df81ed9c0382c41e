"""GARCH models of one long series, in many tasks.

The series is cut into blocks of time. Inside a block the variance is a linear filter of the squared
residuals, so the state at a block's end is an affine map of the state at its start. The driver
composes the maps of at most MAX_BLOCKS blocks, which gives every block its start; likelihood and gradient are then sums
over blocks. The same holds for the derivatives of the variance, which run through the same filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tickerloom.operators.garch import BACKCAST_DAYS, BACKCAST_DECAY, ORDERS, garch_models, garch_select
from tickerloom.operators.ordering import row_index
from tickerloom.operators.rollup import panel_mean
from tickerloom.session import durable, ship_package

#: Rows of a block, and the most blocks of a series; a longer series has longer blocks.
BLOCK_ROWS, MAX_BLOCKS = 4096, 1024
#: Lengths that are tried along a search direction, all in one job, and the most directions.
STEPS, DIRECTIONS = (1.0, 0.5, 0.2, 0.05, 0.005), 100


@dataclass(frozen=True)
class Garch:
    """Parameters of a variance equation: squared residuals weigh alpha, earlier variances beta."""

    mu: float
    omega: float
    alpha: tuple[float, ...]
    beta: tuple[float, ...]

    def step(self, rows: int) -> np.ndarray:
        """The matrix that `rows` steps without input apply to the state (the last variances, latest first)."""
        q = len(self.beta)
        one = np.eye(q, k=-1)
        one[:1] = self.beta
        return np.linalg.matrix_power(one, rows)


@dataclass
class Blocks:
    """Blocks of a series (block, size, dts, r, lead: the returns before it), its length and its first returns."""

    rows: DataFrame
    size: int
    n: int
    head: np.ndarray

    def sizes(self) -> np.ndarray:
        return np.minimum(self.size, self.n - self.size * np.arange(-(-self.n // self.size)))

    def start(self, g: Garch) -> tuple[float, float]:
        """(variance assumed before the series, its derivative by mu)."""
        if not len(self.head):
            return 0.0, 0.0
        e = self.head - g.mu
        weight = BACKCAST_DECAY ** np.arange(len(e))
        return float(weight @ e ** 2 / weight.sum()), float(weight @ (-2 * e) / weight.sum())


def time_blocks(df: DataFrame, c: str, date_col: str, scale: float = 1.0, lead: int = 1) -> Blocks:
    """Cut a series with one row per date into blocks of consecutive rows; rows without a value are left out."""
    ship_package(df.sparkSession)
    rows = df.where(F.col(c).isNotNull()).select(F.col(date_col).alias("dt"), (F.col(c) * scale).alias("r"))
    keyed = rows.withColumns({"_month": F.trunc("dt", "month"), "_day": F.unix_date(F.col("dt").cast("date"))})
    placed = durable(row_index(keyed, "_month", "_day", name="i").select("i", "dt", "r"))
    n = placed.count()
    size = max(BLOCK_ROWS, -(-n // MAX_BLOCKS))
    block = F.floor(F.try_divide("i", F.lit(size))).cast("bigint")
    own = placed.withColumn("block", block)
    after = placed.where(F.pmod("i", F.lit(size)) >= size - lead).withColumn("block", block + 1)
    packed = own.unionByName(after).where(F.col("block") * size < n).groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("i", "dt", "r"))).alias("s"))
    inside = F.filter("s", lambda x: x["i"] >= F.col("block") * size)
    out = packed.select("block", F.transform(inside, lambda x: x["dt"]).alias("dts"), F.transform(inside, lambda x: x["r"]).alias("r"),
                        F.transform(F.filter("s", lambda x: x["i"] < F.col("block") * size), lambda x: x["r"]).alias("lead"))
    head = placed.where(F.col("i") < BACKCAST_DAYS).orderBy("i").select("r").collect()
    return Blocks(durable(out), size, n, np.array([x["r"] for x in head], float))


def filtered(inputs: np.ndarray, beta: Sequence[float], state: np.ndarray) -> np.ndarray:
    """y with y[t] = inputs[t] + sum of beta[j] y[t - 1 - j]; state has the rows before, latest first."""
    if not len(beta):
        return inputs
    if len(beta) == 1:
        return np.array(list(accumulate(inputs, lambda y, u: u + beta[0] * y, initial=state[0]))[1:]).reshape(inputs.shape)
    past, out, weights = [*state], np.empty_like(inputs), np.array(beta)
    for t, u in enumerate(inputs):
        y = u + weights @ np.array(past)
        past = [y, *past[:-1]]
        out[t] = y
    return out


def last_rows(y: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state after y, latest first."""
    q = len(state)
    return np.concatenate([state[::-1], y])[len(y):][::-1] if q else state


def inputs_of(g: Garch, block: int, r: np.ndarray, lead: np.ndarray, start: tuple[float, float], further: int = 0):
    """(residuals, lagged squared residuals per alpha, their derivatives by mu) of a block.

    `further` rows after the block's last one have a lag but no residual.
    """
    p, e = len(g.alpha), r - g.mu
    before = lead[len(lead) - p:] - g.mu if block else np.zeros(p)
    squares = np.concatenate([before ** 2 if block else np.full(p, start[0]), e ** 2])
    slopes = np.concatenate([-2 * before if block else np.full(p, start[1]), -2 * e])
    rows = len(r) + further
    lags = [slice(p - 1 - i, p - 1 - i + rows) for i in range(p)]
    return e, [squares[s] for s in lags], [slopes[s] for s in lags]


def drive(g: Garch, squares: Sequence[np.ndarray], rows: int) -> np.ndarray:
    return g.omega + sum((a * s for a, s in zip(g.alpha, squares, strict=True)), np.zeros(rows))


def each_block(blocks: Blocks, work: Callable[[int, np.ndarray, np.ndarray], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that `work` gives for (block, returns, returns before it)."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, r, lead in zip(batch["block"], batch["r"], batch["lead"], strict=True):
                yield pd.DataFrame(list(work(int(block), np.asarray(r, float), np.asarray(lead, float))), columns=names)

    return blocks.rows.select("block", "r", "lead").mapInPandas(run, schema)


def starts(blocks: Blocks, models: Sequence[Garch]) -> list[list[np.ndarray]]:
    """For each model, the state (last variances) before each block."""
    begin = [blocks.start(g) for g in models]

    def ends(block: int, r: np.ndarray, lead: np.ndarray) -> Iterator[dict]:
        for k, g in enumerate(models):
            zero = np.zeros(len(g.beta))
            _, squares, _ = inputs_of(g, block, r, lead, begin[k])
            yield {"block": block, "model": k, "gain": last_rows(filtered(drive(g, squares, len(r)), g.beta, zero), zero).tolist()}

    gains = {(x["block"], x["model"]): np.array(x["gain"]) for x in each_block(blocks, ends, "block long, model int, gain array<double>").collect()}
    out = []
    for k, g in enumerate(models):
        state, own = np.full(len(g.beta), begin[k][0]), []
        for block, rows in enumerate(blocks.sizes()):
            own.append(state)
            state = g.step(int(rows)) @ state + gains[block, k]
        out.append(own)
    return out


def likelihood(blocks: Blocks, models: Sequence[Garch]) -> list[tuple[float, np.ndarray]]:
    """For each model, (negative log-likelihood, its gradient by mu, omega, alpha, beta), in two jobs for all of them."""
    begin, states = [blocks.start(g) for g in models], starts(blocks, models)

    def sums(block: int, r: np.ndarray, lead: np.ndarray) -> Iterator[dict]:
        for k, g in enumerate(models):
            p, q, rows = len(g.alpha), len(g.beta), len(r)
            e, squares, slopes = inputs_of(g, block, r, lead, begin[k])
            h = filtered(drive(g, squares, rows), g.beta, states[k][block])
            if not (np.isfinite(h) & (h > 0)).all():
                yield {"block": block, "model": k, "loss": float("inf"), "own": [0.0] * (2 + p + q), "by_state": [0.0] * q, "gain": [0.0] * (q * (2 + p + q))}
                continue
            weight = 0.5 * (1 - e ** 2 / h) / h
            earlier = np.concatenate([states[k][block][::-1], h])
            # Derivatives by each parameter from a zero state, then responses to a state of one.
            inputs = np.zeros((rows, 2 + p + q + q))
            inputs[:, 0] = sum((a * s for a, s in zip(g.alpha, slopes, strict=True)), np.zeros(rows))
            inputs[:, 1] = 1
            for i, s in enumerate(squares):
                inputs[:, 2 + i] = s
            for j in range(q):
                inputs[:, 2 + p + j] = earlier[q - 1 - j:q - 1 - j + rows]
            zero = np.concatenate([np.zeros((q, 2 + p + q)), np.eye(q)], axis=1)
            paths = filtered(inputs, g.beta, zero)
            own = weight @ paths
            own[0] -= (e / h).sum()
            gain = last_rows(paths, zero)[:, :2 + p + q]
            yield {"block": block, "model": k, "loss": float(0.5 * (np.log(2 * np.pi * h) + e ** 2 / h).sum()), "own": own[:2 + p + q].tolist(),
                   "by_state": own[2 + p + q:].tolist(), "gain": gain.ravel().tolist()}

    found = {(x["block"], x["model"]): x for x in each_block(
        blocks, sums, "block long, model int, loss double, own array<double>, by_state array<double>, gain array<double>").collect()}
    out = []
    for k, g in enumerate(models):
        width, q = 2 + len(g.alpha) + len(g.beta), len(g.beta)
        slope = np.zeros((q, width))
        slope[:, 0] = begin[k][1]
        loss, gradient = 0.0, np.zeros(width)
        for block, rows in enumerate(blocks.sizes()):
            x = found[block, k]
            loss += x["loss"]
            gradient += np.array(x["own"]) + np.array(x["by_state"]).reshape(q) @ slope
            slope = g.step(int(rows)) @ slope + np.array(x["gain"]).reshape(q, width)
        out.append((loss, gradient))
    return out


def free_form(spread: float, p: int, q: int, constant: bool) -> Callable[[np.ndarray], Garch]:
    """Parameters from unbounded numbers; shares of one keep the sum of alpha and beta below one."""
    def model(v: np.ndarray) -> Garch:
        shares = np.exp(np.append(v[1:1 + p + q], 0.0) - max(0.0, v[1:1 + p + q].max()))
        shares /= shares.sum()
        return Garch(float(v[-1] * np.sqrt(spread)) if constant else 0.0, float(spread * np.exp(v[0]) * shares[-1]),
                     tuple(shares[:p].tolist()), tuple(shares[p:p + q].tolist()))
    return model


def flat(g: Garch) -> np.ndarray:
    return np.array([g.mu, g.omega, *g.alpha, *g.beta])


def descend(values: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], start: np.ndarray) -> tuple[np.ndarray, float, bool]:
    """Quasi-Newton descent; several step lengths are tried at once. (point, value, whether it came together)."""
    (value, slope), = values([start])
    point, inverse = start, np.eye(len(start)) / max(1.0, float(np.linalg.norm(slope)))
    for _ in range(DIRECTIONS):
        way = -inverse @ slope
        if way @ slope >= 0:
            inverse = np.eye(len(start)) / max(1.0, float(np.linalg.norm(slope)))
            way = -inverse @ slope
        tried = [point + t * way for t in STEPS]
        found = values(tried)
        k = min(range(len(STEPS)), key=lambda i: found[i][0] if np.isfinite(found[i][0]) else np.inf)
        better, new = found[k]
        if not better < value:
            return point, value, bool(np.abs(slope).max() < 1e-3 * (1 + abs(value)))
        s, y = tried[k] - point, new - slope
        if s @ y > 1e-12:
            rho, eye = 1 / (s @ y), np.eye(len(s))
            inverse = (eye - rho * np.outer(s, y)) @ inverse @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        gained, point, value, slope = value - better, tried[k], better, new
        if gained < 1e-10 * (1 + abs(value)) and np.abs(slope).max() < 1e-4 * (1 + abs(value)):
            return point, value, True
    return point, value, False


def fit_series(df: DataFrame, c: str, date_col: str, p: int = 1, q: int = 1, mean: str = "zero", scale: float = 100.0) -> dict:
    """Maximum likelihood of one series over its blocks: p, q, n, mu, omega, alpha, beta, loglik, aic, status.

    Without a model, status is short or constant, and n is the only other entry.
    """
    blocks = time_blocks(df, c, date_col, scale, max(p, 1))
    n, k, constant = blocks.n, 1 + p + q + (mean == "constant"), mean == "constant"
    average, spread = blocks.rows.select(F.explode("r").alias("r")).agg(F.avg("r"), F.var_pop("r")).first()
    if n < 10 + k or not spread:
        return {"n": n, "status": "short" if n < 10 + k else "constant"}
    model = free_form(spread, p, q, constant)

    def values(points: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        out = []
        for v, (loss, slope) in zip(points, likelihood(blocks, [model(v) for v in points]), strict=True):
            # The change of variables has few entries, so its derivative is taken numerically on the driver.
            moves = np.array([(flat(model(v + d)) - flat(model(v - d))) / 2e-6 for d in 1e-6 * np.eye(len(v))])
            out.append((loss, moves @ slope))
        return out

    seeds = []
    for a, total in ((0.05, 0.9), (0.1, 0.95), (0.02, 0.5)):
        shares = np.array([a / p] * p + [(total - a) / q] * q) / (1 - total)
        seeds.append(np.concatenate([[0.0], np.log(shares), [average / np.sqrt(spread)] if constant else []]))
    first = seeds[int(np.argmin([loss for loss, _ in values(seeds)]))]
    point, loss, together = descend(values, first)
    g = model(point)
    return {"p": p, "q": q, "n": n, "mu": g.mu, "omega": g.omega, "alpha": list(g.alpha), "beta": list(g.beta), "loglik": -loss,
            "aic": 2 * loss + 2 * k, "status": "ok" if together else "not converged"}


def variance_path(df: DataFrame, c: str, date_col: str, g: Garch, scale: float = 100.0) -> DataFrame:
    """dt, r, cond_variance (of the day), garch_cond_variance (forecast for the next day) and residual for given parameters."""
    blocks = time_blocks(df, c, date_col, scale, max(len(g.alpha), 1))
    begin, (states,) = blocks.start(g), starts(blocks, [g])

    def path(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, dts, r, lead in zip(batch["block"], batch["dts"], batch["r"], batch["lead"], strict=True):
                r = np.asarray(r, float)
                e, squares, _ = inputs_of(g, int(block), r, np.asarray(lead, float), begin, 1)
                h = filtered(drive(g, squares, len(r) + 1), g.beta, states[int(block)])
                yield pd.DataFrame({"dt": list(dts), "r": r, "cond_variance": h[:-1], "garch_cond_variance": h[1:], "garch_residuals": e})

    return blocks.rows.mapInPandas(path, f"dt {dict(df.dtypes)[date_col]}, r double, cond_variance double, garch_cond_variance double, garch_residuals double")


def garch_compare(df: DataFrame, c: str, date_col: str, by: str, scale: float = 100.0,
                  orders: Sequence[tuple[int, int]] = tuple(ORDERS)) -> DataFrame:
    """AIC and log-likelihood: GARCH(1,1) on the panel mean, fitted over blocks, and the best order per series."""
    pooled = fit_series(panel_mean(df, c, [date_col], scale), c, date_col, mean="constant", scale=1.0)
    best = garch_select(garch_models(df, c, date_col, [by], orders, scale=scale), [by])
    one = df.sparkSession.createDataFrame([("All", *(pooled.get(k) for k in ("p", "q", "aic", "loglik")))],
                                          f"`{by}` string, p int, q int, aic double, loglik double")
    return one.unionByName(best.select(by, "p", "q", "aic", "loglik"))
