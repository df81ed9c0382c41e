"""Time-series tests. Rows are reduced to sums of lagged products by Spark aggregates;
column expressions solve the few equations of each reduced row."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions import tails
from tickerloom.operators.windows import series
from tickerloom.session import join_on

# Significance level, default lags of the tests.
SIGNIFICANCE = 0.05
GRANGER_LAGS, ACF_LAGS = 3, 30


def centred(df: DataFrame, c: str, by: Sequence[str]) -> Column:
    return F.col(c) - F.avg(c).over(Window.partitionBy(*by))


def acf(df: DataFrame, c: str, lags: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Autocorrelation for lags 0..lags: one row per (series, lag)."""
    base = df.where(F.col(c).isNotNull()).select(*by, *order, centred(df, c, by).alias("_x"))
    shifted = base.withColumns({f"_l{k}": F.lag("_x", k).over(series(by, order)) for k in range(1, lags + 1)})
    total = F.sum(F.col("_x") * F.col("_x"))
    row = shifted.groupBy(*by).agg(
        F.lit(1.0).alias("0"),
        *[F.try_divide(F.sum(F.col("_x") * F.col(f"_l{k}")), total).alias(str(k)) for k in range(1, lags + 1)])
    long = row.unpivot(list(by), [str(k) for k in range(lags + 1)], "lag", "acf")
    return long.withColumn("lag", F.col("lag").cast("int"))


def pacf(df: DataFrame, c: str, lags: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Partial autocorrelation (Yule-Walker) from the lags + 1 autocorrelations, by Levinson's recursion as a column expression."""
    pairs = F.array_sort(F.collect_list(F.struct("lag", "acf")))
    row = acf(df, c, lags, by, order).groupBy(*by).agg(F.transform(pairs, lambda p: p["acf"]).alias("_r"))

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)

    def longer(known: Column, k: Column) -> Column:
        """Coefficients of the regression on k values from those of the regression on k - 1, and the last one of each so far."""
        past = F.slice("_r", F.lit(2), k - 1)
        last = F.try_divide(F.get("_r", k) - dot(known["phi"], F.reverse(past)), 1.0 - dot(known["phi"], past))
        phi = F.concat(F.zip_with(known["phi"], F.reverse(known["phi"]), lambda u, v: u - last * v), F.array(last))
        return F.struct(phi.alias("phi"), F.concat(known["out"], F.array(last)).alias("out"))

    empty = F.array().cast("array<double>")
    zero = F.struct(empty.alias("phi"), F.array(F.lit(1.0)).cast("array<double>").alias("out"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(lags)), zero, longer, lambda known: known["out"])
    return row.select(*by, F.posexplode(found).alias("lag", "pacf"))


def lagged_sums(df: DataFrame, cols: Sequence[str], lags: int, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per series: n, sums of x[t] y[t - l] for all ordered pairs of columns and l = 0..lags, and both ends of the columns.

    `sums` holds pair (a, b) and lag l at (a * columns + b) * (lags + 1) + l; `head` and `tail` hold the first and
    last lags + 1 values (the last one first) of column a from a * (lags + 1) on. Sums over any shorter range of t follow from
    them (see `gram`). Columns must not be NULL.
    """
    w, whole = series(by, order), Window.partitionBy(*by)
    position = F.row_number().over(w)
    rows = df.select(*by, *order, *[F.col(c).cast("double").alias(f"_{i}_0") for i, c in enumerate(cols)])
    rows = rows.withColumns({"_at": position, "_left": F.count(F.lit(1)).over(whole) - position,
                             **{f"_{i}_{k}": F.lag(f"_{i}_0", k).over(w) for i in range(len(cols)) for k in range(1, lags + 1)}})
    every = range(len(cols))
    sums = [F.coalesce(F.sum(F.col(f"_{a}_0") * F.col(f"_{b}_{k}")), F.lit(0.0)) for a in every for b in every for k in range(lags + 1)]
    head = [F.max(F.when(F.col("_at") == k + 1, F.col(f"_{a}_0"))) for a in every for k in range(lags + 1)]
    tail = [F.max(F.when(F.col("_left") == k, F.col(f"_{a}_0"))) for a in every for k in range(lags + 1)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array(*sums).alias("sums"), F.array(*head).alias("head"), F.array(*tail).alias("tail"))


def gram(design: Column, first: Column, columns: int, lags: int) -> Column:
    """Products of the columns of a regression, summed over the rows from number `first` (counted from 0) on.

    design: array of (col, lag), no lag above `first`. Needs the columns of `lagged_sums`: the sum over all rows is
    taken, and the products that begin before `first` or stand behind the last row are taken off.
    """
    width = lags + 1

    def cell(p: Column, q: Column) -> Column:
        swap = p["lag"] > q["lag"]
        a, i = F.when(swap, q["col"]).otherwise(p["col"]), F.when(swap, q["lag"]).otherwise(p["lag"])
        b, j = F.when(swap, p["col"]).otherwise(q["col"]), F.when(swap, p["lag"]).otherwise(q["lag"])
        apart = j - i
        before = F.when(first > j, F.sequence(apart, first - i - 1)).otherwise(F.array().cast("array<int>"))
        behind = F.when(i > 0, F.sequence(F.lit(0), i - 1)).otherwise(F.array().cast("array<int>"))
        early = F.aggregate(before, F.lit(0.0), lambda t, s: t + F.get("head", a * width + s) * F.get("head", b * width + s - apart))
        late = F.aggregate(behind, F.lit(0.0), lambda t, u: t + F.get("tail", a * width + u) * F.get("tail", b * width + u + apart))
        return F.get("sums", (a * columns + b) * width + apart) - early - late

    return F.transform(design, lambda p: F.transform(design, lambda q: F.coalesce(cell(p, q), F.lit(0.0))))


def eliminated(matrix: Column, pivots: Column) -> Column:
    """A matrix of products after the columns `pivots` have been taken out of all others, one after the other.

    A pivot that is zero but for rounding (a column that depends on earlier ones) takes nothing out.
    """
    def step(m: Column, p: Column) -> Column:
        pivot = F.get(F.get(m, p), p)
        return F.transform(m, lambda row, i: F.transform(row, lambda v, j: F.when(
            pivot > 1e-10, v - F.get(row, p) * F.get(F.get(m, p), j) / pivot).otherwise(v)))
    return F.aggregate(pivots, matrix, step)


def at(matrix: str, i: int | Column, j: int | Column) -> Column:
    return F.get(F.get(matrix, F.lit(i) if isinstance(i, int) else i), F.lit(j) if isinstance(j, int) else j)


def unit(c: str, by: Sequence[str]) -> Column:
    """Standardised values; tests that allow a shift and a factor are better conditioned with them."""
    x, whole = F.col(c).cast("double"), Window.partitionBy(*by)
    return F.try_divide(x - F.avg(x).over(whole), F.stddev_pop(x).over(whole))


def ar1_residuals(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Regression of x on its previous value; residuals and squared residuals per row."""
    by = list(by)
    base = df.where(F.col(c).isNotNull()).withColumn("_before", F.lag(c, 1).over(series(by, order)))
    whole = Window.partitionBy(*by)
    fit = base.withColumns({"_b": F.regr_slope(c, "_before").over(whole), "_a": F.regr_intercept(c, "_before").over(whole)})
    out = fit.withColumn("residual", F.col(c) - F.col("_a") - F.col("_b") * F.col("_before"))
    return out.withColumn("squared_residual", F.col("residual") * F.col("residual")).drop("_before", "_a", "_b")


def granger(df: DataFrame, pairs: Sequence[tuple[str, str]], maxlag: int, by: Sequence[str],
            order: Sequence[str]) -> DataFrame:
    """For each (effect, cause): does `cause` help to predict `effect`? Four tests per lag.

    One aggregate per series sums lagged products of the columns (`lagged_sums`); the regressions of all pairs and
    lags are made from these sums. The tests do not change when a column is shifted
    or scaled, so columns are standardised first, which keeps the sums well conditioned.
    """
    by = list(by)
    names = sorted({c for pair in pairs for c in pair})
    base = df.dropna(subset=names).select(*by, *order, *[unit(c, by).alias(f"_u{i}") for i, c in enumerate(names)], F.lit(1.0).alias("_one"))
    base = base.withColumns({f"_u{i}": F.coalesce(f"_u{i}", F.lit(0.0)) for i in range(len(names))})
    sums = lagged_sums(base, [*(f"_u{i}" for i in range(len(names))), "_one"], maxlag, by, order)

    def column(i: int, lag: int) -> Column:
        return F.struct(F.lit(i).alias("col"), F.lit(lag).alias("lag"))

    cases = F.array(*[F.struct(
        F.lit(effect).alias("effect"), F.lit(cause).alias("cause"), F.lit(p).alias("lag"),
        F.array(column(len(names), 0), *[column(names.index(effect), k) for k in range(1, p + 1)],
                *[column(names.index(cause), k) for k in range(1, p + 1)], column(names.index(effect), 0)).alias("design"))
        for effect, cause in pairs for p in range(1, maxlag + 1)])
    keys = [*by, "effect", "cause", "lag"]
    tried = sums.withColumn("_c", F.explode(cases)).select(*by, "n", "sums", "head", "tail", "_c.*").where(F.col("n") > F.col("lag"))
    tried = tried.withColumn("_g", gram(F.col("design"), F.col("lag"), len(names) + 1, maxlag))
    own, other = F.sequence(F.lit(0), F.col("lag")), F.sequence(F.col("lag") + 1, 2 * F.col("lag"))
    tried = tried.withColumn("_r", eliminated(F.col("_g"), own)).withColumn("_f", eliminated(F.col("_r"), other))
    last = 2 * F.col("lag") + 1
    fits = tried.select(*keys, (F.col("n") - F.col("lag")).alias("n"), at("_r", last, last).alias("ssr_r"), at("_f", last, last).alias("ssr_u"))
    free = (F.col("n") - 2 * F.col("lag") - 1).cast("double")
    gain = F.try_divide(F.col("ssr_r") - F.col("ssr_u"), F.col("ssr_u"))
    f_value = gain * free / F.col("lag")
    lag = F.col("lag").cast("double")
    tests = F.array(*[F.struct(F.lit(name).alias("test"), value.alias("statistic"), num.alias("df_num"), den.alias("df_denom"))
                      for name, value, num, den in (
        ("ssr_ftest", f_value, lag, free), ("ssr_chi2test", F.col("n") * gain, lag, F.lit(None).cast("double")),
        ("lrtest", F.col("n") * F.ln(F.try_divide("ssr_r", "ssr_u")), lag, F.lit(None).cast("double")),
        ("params_ftest", f_value, lag, free))])
    long = fits.select(*keys, F.explode(tests).alias("t"))
    return long.select(*keys, "t.*").withColumn(
        "p_value", test_p_value(F.col("statistic"), F.col("df_num"), F.col("df_denom")))


def test_p_value(statistic: Column, num: Column, den: Column) -> Column:
    """Upper tail of F(num, den), or of chi-square(num) where den is NULL."""
    @F.pandas_udf("double")
    def tail(s: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x != x else tails.f_sf(x, n, d) if d == d and d is not None
                          else tails.chi2_sf(x, int(n)) for x, n, d in zip(s, a, b)], dtype="float64")
    return tail(statistic, num, den)


def granger_decision(tests: DataFrame, by: Sequence[str] = (), level: float = SIGNIFICANCE) -> DataFrame:
    """First lag with a significant F test per direction, NULL when there is none."""
    f = tests.where(F.col("test") == "ssr_ftest")
    return f.groupBy(*by, "effect", "cause").agg(
        F.min(F.when(F.col("p_value") < level, F.col("lag"))).alias("first_lag"),
        F.min("p_value").alias("smallest_p")).withColumn("causes", F.col("first_lag").isNotNull().cast("int"))


def default_lags(n: Column) -> Column:
    """Most lags that the unit-root test tries for a series of n values."""
    return F.least(F.ceil(12 * F.pow(n / 100.0, F.lit(0.25))), F.floor(n / 2) - 2).cast("int")


def adf(df: DataFrame, c: str, by: Sequence[str], order: Sequence[str], maxlag: int | None = None) -> DataFrame:
    """Unit-root test (Dickey-Fuller regression with constant) per series.

    With a given maxlag this is the number of lagged differences, else the number with the lowest AIC, among
    those up to `default_lags`, on the rows that all of them have. All regressions of a series come from one aggregate of
    lagged products (`lagged_sums`): taking out one lag after the other gives the residuals of every number of lags.

    A series that is too short or constant keeps its row, with NULLs and a status.
    """
    by = list(by)
    base = df.where(F.col(c).isNotNull())
    sizes = base.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    most = maxlag if maxlag is not None else max(0, sizes.agg(F.max(default_lags(F.col("_n")))).first()[0] or 0)
    levels = base.select(*by, *order, F.coalesce(unit(c, by), F.lit(0.0)).alias("_x"), F.stddev_pop(F.col(c).cast("double")).over(Window.partitionBy(*by)).alias("_sd"))
    # Row t holds the level before it and the difference to it, so the first row of a series drops out.
    before = F.lag("_x", 1).over(series(by, order))
    pairs = levels.select(*by, *order, "_sd", before.alias("_level"), (F.col("_x") - before).alias("_change"), F.lit(1.0).alias("_one"))
    pairs = pairs.where(F.col("_level").isNotNull())
    spreads = levels.groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.max("_sd").alias("_sd"))
    sums = lagged_sums(pairs, ["_change", "_level", "_one"], most, by, order)
    rows = join_on(spreads, sums, by, "left") if by else spreads.withColumn("_k", F.lit(0)).join(sums.withColumn("_k", F.lit(0)), "_k", "left").drop("_k")
    lags = F.lit(maxlag) if maxlag is not None else default_lags(F.col("size"))
    rows = rows.withColumn("most", lags).withColumn("fits", F.coalesce(
        (F.col("size") >= 4) & (F.col("most") >= 0) & (F.col("_sd") > 0) & (F.col("n") > F.col("most") + 2), F.lit(False)))

    def column(i: int, lag: Column) -> Column:
        return F.struct(F.lit(i).alias("col"), lag.cast("int").alias("lag"))

    def design(lag: Column) -> Column:
        """Constant, lagged differences, level before, difference."""
        past = F.when(lag > 0, F.transform(F.sequence(F.lit(1), lag), lambda k: column(0, k))).otherwise(F.array().cast("array<struct<col:int,lag:int>>"))
        return F.concat(F.array(column(2, F.lit(0))), past, F.array(column(1, F.lit(0)), column(0, F.lit(0))))

    zero = F.lit(0)
    if maxlag is None:
        # The level comes before the lags here, so that taking out the first 2 + k columns leaves the residuals with k lags.
        swapped = F.transform(F.sequence(zero, F.col("most")), lambda k: F.when(k == 0, column(1, F.lit(0))).otherwise(column(0, k)))
        whole = gram(F.concat(F.array(column(2, F.lit(0))), swapped, F.array(column(0, F.lit(0)))), F.col("most"), 3, most)
        tried = rows.where("fits").withColumn("_g", whole)
        end = F.col("most") + 2

        def narrower(known: Column, k: Column) -> Column:
            m = eliminated(known["m"], F.array(k))
            return F.struct(m.alias("m"), F.concat(known["ssr"], F.array(F.get(F.get(m, end), end))).alias("ssr"))

        start = F.struct(eliminated(F.col("_g"), F.array(zero)).alias("m"), F.array().cast("array<double>").alias("ssr"))
        ssr = F.aggregate(F.sequence(F.lit(1), F.col("most") + 1), start, narrower, lambda known: known["ssr"])
        size = (F.col("n") - F.col("most")).cast("double")
        tried = tried.withColumn("_aic", F.transform(ssr, lambda v, k: size * F.ln(v / size) + 2.0 * (k + 2)))
        best = (F.array_position("_aic", F.array_min("_aic")) - 1).cast("int")
        tried = tried.withColumn("used_lag", best).drop("_g", "_aic")
    else:
        tried = rows.where("fits").withColumn("used_lag", F.lit(maxlag))
    tried = tried.withColumn("_g", eliminated(gram(design(F.col("used_lag")), F.col("used_lag"), 3, most), F.sequence(zero, F.col("used_lag"))))
    x, y = F.col("used_lag") + 1, F.col("used_lag") + 2
    rest = at("_g", y, y) - F.try_divide(at("_g", x, y) * at("_g", x, y), at("_g", x, x))
    used = F.col("n") - F.col("used_lag")
    error = F.sqrt(F.try_divide(F.try_divide(rest, used - F.col("used_lag") - 2), at("_g", x, x)))
    found = tried.select(*by, F.try_divide(F.try_divide(at("_g", x, y), at("_g", x, x)), error).alias("statistic"), "used_lag", used.cast("bigint").alias("n"))
    found = with_tail(found)
    others = rows.where(~F.col("fits")).select(*by, F.col("size").cast("bigint").alias("n"), F.lit("short or constant").alias("status"))
    return found.withColumn("status", F.lit("ok")).unionByName(others, allowMissingColumns=True).select(
        *by, "statistic", "p_value", "used_lag", "n", "critical_1", "critical_5", "critical_10", "status")


def with_tail(found: DataFrame) -> DataFrame:
    """p-value and critical values of unit-root statistics, on reduced rows."""
    @F.pandas_udf("p_value double, critical_1 double, critical_5 double, critical_10 double")
    def tail(tau: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"p_value": [tails.adf_p_value(t) for t in tau],
                             **{f"critical_{k}": [tails.adf_critical(f"{k}%", int(x)) for x in n] for k in (1, 5, 10)}})
    return found.withColumn("_t", tail("statistic", "n")).select("*", "_t.*").drop("_t")
