"""GARCH(p, q) models per series.

A task fits one daily series (one row per date, so its size is bounded by the calendar);
Spark spreads series and candidate orders over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tickerloom.functions.dates import next_business_days

# Start of the variance recursion (decay, days), orders searched, forecast days.
BACKCAST_DECAY, BACKCAST_DAYS = 0.94, 75
ORDERS = [(p, q) for p in (1, 2, 3) for q in (1, 2, 3)]
HORIZON = 5
#: Further searches from the best point, while the search has not come together.
RESTARTS = 3
SUMMARY = "p int, q int, n long, mu double, omega double, alpha array<double>, beta array<double>, " \
          "loglik double, aic double, status string, last_dt date, forecast array<double>"


def start_variance(e2: np.ndarray) -> float:
    weights = BACKCAST_DECAY ** np.arange(min(BACKCAST_DAYS, len(e2)))
    return float(weights @ e2[:len(weights)] / weights.sum())


def variances(e2: np.ndarray, omega: float, alpha: Sequence[float], beta: Sequence[float], start: float) -> np.ndarray:
    """Conditional variances for t = 0..n; entry n is the one-step forecast."""
    n = len(e2)
    drive = np.full(n + 1, omega)
    padded = np.concatenate([np.full(len(alpha), start), e2])
    for i, a in enumerate(alpha):
        lag = len(alpha) - 1 - i
        drive += a * padded[lag:lag + n + 1]
    if len(beta) == 1:
        b = beta[0]
        return np.fromiter(accumulate(drive.tolist(), lambda h, d: d + b * h, initial=start), float, n + 2)[1:]
    if len(beta) > 3:
        raise ValueError("at most three lagged variances")
    b1, b2, b3 = (list(beta) + [0.0, 0.0])[:3]
    h1 = h2 = h3 = start
    out = []
    for d in drive.tolist():
        h1, h2, h3 = d + b1 * h1 + b2 * h2 + b3 * h3, h1, h2
        out.append(h1)
    return np.array(out)


def minimise(f, start: np.ndarray, steps: int) -> tuple[np.ndarray, float, bool]:
    """Downhill simplex search: the best point, its value, and whether the values came together in time."""
    dim = len(start)
    points = [start] + [start + 0.5 * np.eye(dim)[i] for i in range(dim)]
    values = [f(p) for p in points]
    together = False
    for _ in range(steps):
        order = np.argsort(values)
        points, values = [points[i] for i in order], [values[i] for i in order]
        together = bool(values[-1] - values[0] < 1e-8 * (1 + abs(values[0])))
        if together:
            break
        centre = np.mean(points[:-1], axis=0)
        trial = 2 * centre - points[-1]
        value = f(trial)
        if value < values[0]:
            further = 3 * centre - 2 * points[-1]
            far = f(further)
            points[-1], values[-1] = (further, far) if far < value else (trial, value)
        elif value < values[-2]:
            points[-1], values[-1] = trial, value
        else:
            inner = 0.5 * (centre + (trial if value < values[-1] else points[-1]))
            near = f(inner)
            if near < min(value, values[-1]):
                points[-1], values[-1] = inner, near
            else:
                points = [points[0]] + [0.5 * (points[0] + p) for p in points[1:]]
                values = [values[0]] + [f(p) for p in points[1:]]
    best = int(np.argmin(values))
    return points[best], values[best], together


def fit(r: np.ndarray, p: int, q: int, mean: str) -> dict:
    """Maximum likelihood with normal errors.

    status is ok, not converged (the last point of the search is kept), or, without a model, short,
    constant or failed.
    """
    n, k = len(r), 1 + p + q + (mean == "constant")
    spread = float(np.var(r)) if n else 0.0
    if n < 10 + k or spread <= 0:
        return {"status": "short" if n < 10 + k else "constant"}

    def unpack(v: np.ndarray):
        # Shares of 1 for alpha, beta and a remainder keep every sum below one.
        mu = v[-1] * np.sqrt(spread) if mean == "constant" else 0.0
        shares = np.exp(np.append(v[1:1 + p + q], 0.0) - max(0.0, v[1:1 + p + q].max()))
        shares /= shares.sum()
        omega = spread * np.exp(v[0]) * shares[-1]
        return mu, omega, shares[:p], shares[p:p + q]

    def loss(v: np.ndarray) -> float:
        if np.abs(v).max() > 30:
            return np.inf
        mu, omega, alpha, beta = unpack(v)
        e2 = (r - mu) ** 2
        h = variances(e2, omega, alpha, beta, start_variance(e2))[:n]
        return 0.5 * float(np.sum(np.log(2 * np.pi * h) + e2 / h))

    starts = []
    for a, total in ((0.05, 0.9), (0.1, 0.95), (0.02, 0.5)):
        shares = np.array([a / p] * p + [(total - a) / q] * q) / (1 - total)
        tail = [float(r.mean() / np.sqrt(spread))] if mean == "constant" else []
        starts.append(np.concatenate([[0.0], np.log(shares), tail]))
    first = min(starts, key=loss)
    best, value, _ = minimise(loss, first, 60 * k)
    for _ in range(RESTARTS):
        best, value, together = minimise(loss, best, 60 * k)
        if together:
            break
    if not np.isfinite(value):
        return {"status": "failed"}
    mu, omega, alpha, beta = unpack(best)
    e = r - mu
    h = variances(e * e, omega, alpha, beta, start_variance(e * e))
    return {"p": p, "q": q, "n": n, "mu": float(mu), "omega": float(omega), "alpha": alpha.tolist(), "beta": beta.tolist(),
            "loglik": -value, "aic": 2 * value + 2 * k, "status": "ok" if together else "not converged", "h": h, "resid": e}


def forecast(model: dict, days: int) -> list[float]:
    """Variance path: unknown squared residuals are replaced by their expectation."""
    e2, h = (model["resid"] ** 2).tolist(), model["h"].tolist()
    for t in range(model["n"], model["n"] + days):
        if t >= len(h):
            h.append(model["omega"] + sum(a * e2[t - 1 - i] for i, a in enumerate(model["alpha"]))
                     + sum(b * h[t - 1 - j] for j, b in enumerate(model["beta"])))
        e2.append(h[t])
    return h[model["n"]:model["n"] + days]


def series_frame(df: DataFrame, c: str, date_col: str, by: Sequence[str], scale: float) -> DataFrame:
    keyed = df if by else df.withColumn("series", F.lit("all"))
    keys = list(by) or ["series"]
    return keyed.where(F.col(c).isNotNull()).select(*keys, F.col(date_col).alias("dt"), (F.col(c) * scale).alias("r"))


def spread_out(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Many small tasks: fits cost much time per byte, so tasks must not be merged by size."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def key_schema(df: DataFrame, keys: Sequence[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{k}` {types[k]}, " for k in keys)


def garch_fit(df: DataFrame, c: str, date_col: str, by: Sequence[str] = (), p: int = 1, q: int = 1,
              mean: str = "zero", scale: float = 100.0) -> DataFrame:
    """Per date: variance and volatility of the day, the forecast for the next day, residual.

    garch_cond_variance is the one-step forecast made on the date, cond_variance the one
    that applied to it. garch_status tells how the fit went; rows of a series without a model have NULLs.
    """
    base = series_frame(df, c, date_col, by, scale)
    keys = [k for k in base.columns if k not in ("dt", "r")]
    schema = key_schema(base, keys) + "dt date, r double, cond_variance double, cond_volatility double, " \
        "garch_cond_variance double, garch_cond_volatility double, garch_residuals double, garch_status string"
    names = [*keys, "dt", "r", "cond_variance", "cond_volatility", "garch_cond_variance", "garch_cond_volatility", "garch_residuals", "garch_status"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt").reset_index(drop=True)
        model = fit(rows["r"].to_numpy(), p, q, mean)
        rows["garch_status"] = model["status"]
        if "h" not in model:
            return rows.reindex(columns=names)
        h, n = model["h"], model["n"]
        return rows.assign(cond_variance=h[:n], cond_volatility=np.sqrt(h[:n]), garch_cond_variance=h[1:n + 1],
                           garch_cond_volatility=np.sqrt(h[1:n + 1]), garch_residuals=model["resid"])[names]

    return spread_out(base, keys).groupBy(*keys).applyInPandas(run, schema)


def garch_models(df: DataFrame, c: str, date_col: str, by: Sequence[str] = (), orders: Sequence[tuple[int, int]] = ((1, 1),),
                 mean: str = "constant", scale: float = 100.0, days: int = HORIZON) -> DataFrame:
    """One row per (series, order): parameters, log-likelihood, AIC and variance forecast.

    Each (series, order) pair is a task of its own.
    """
    base = series_frame(df, c, date_col, by, scale)
    keys = [k for k in base.columns if k not in ("dt", "r")]
    tried = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in orders])
    names = [*keys, *[f.split()[0] for f in SUMMARY.split(", ")]]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("dt")
        p, q = int(key[-2]), int(key[-1])
        model = fit(rows["r"].to_numpy(), p, q, mean)
        record = dict.fromkeys(names) | dict(zip(keys, key)) | {"p": p, "q": q, "last_dt": rows["dt"].iloc[-1], "n": len(rows)}
        record |= {k: v for k, v in model.items() if k in names}
        if "h" in model:
            record["forecast"] = forecast(model, days)
        return pd.DataFrame([record], columns=names)

    spread = base.withColumn("_o", F.explode(tried)).select(*keys, "_o.p", "_o.q", "dt", "r")
    return spread_out(spread, [*keys, "p", "q"]).groupBy(*keys, "p", "q").applyInPandas(run, key_schema(base, keys) + SUMMARY)


def garch_select(models: DataFrame, by: Sequence[str] = ("series",)) -> DataFrame:
    """The order with the lowest AIC per series, converged fits first; orders without a model are skipped."""
    rest = [c for c in models.columns if c not in by]
    best = models.where(F.col("aic").isNotNull()).groupBy(*by).agg(F.min_by(F.struct(*rest), F.struct(F.col("status") != "ok", "aic", "p", "q")).alias("m"))
    return best.select(*by, "m.*")


def garch_forecast(rows: DataFrame, models: DataFrame, by: Sequence[str] = ("series",), days: int = HORIZON) -> DataFrame:
    """Append the forecast variances on the next weekdays to the rows of the series."""
    ahead = models.where(F.col("forecast").isNotNull()).select(
        *by, F.explode(F.arrays_zip(next_business_days("last_dt", days).alias("dt"), F.col("forecast"))).alias("f"))
    future = ahead.select(*by, F.col("f.dt").alias("dt"), F.col("f.forecast").alias("forecasted_volatility"))
    return rows.unionByName(future, allowMissingColumns=True)
