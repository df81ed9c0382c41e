"""Queries on time-series tests, volatility models, vectors and synthetic rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tickerloom.catalog.bars import BY, FEATURE_STEPS, ORDER, W, roll_sql, rounded
from tickerloom.catalog.news import SCORED, STOPS_SQL, scored_news
from tickerloom.catalog.registry import query
from tickerloom.functions.vectors import cosine
from tickerloom.operators import garch, garch_blocks, joins, neighbours, profile, rollup, scaling, stats, vectors, windows
from tickerloom.plans import views
from tickerloom.plans.views import sql
from tickerloom.session import durable

RETURNS = ("r", f"SELECT ticker, dt, close / lag(close) {W} - 1 AS ret, CAST(volume AS DOUBLE) AS volume FROM bars")


def returns(spark, sf):
    df = views.bars(spark, sf).withColumn("ret", windows.pct_change("close", BY, ORDER))
    return df.select("ticker", "dt", "ret", F.col("volume").cast("double").alias("volume"))


# ---- tests ----

def acf_sql(source, c, lags=30):
    lagged = ", ".join(f"lag(x, {k}) {W} AS l{k}" for k in range(1, lags + 1))
    rows = " UNION ALL ".join(f"SELECT ticker, CAST({k} AS INT) AS lag, round(sum(x * {'x' if k == 0 else f'l{k}'}) / sum(x * x), 6) AS acf "
                              "FROM lagged GROUP BY ticker" for k in range(lags + 1))
    return (("c", f"SELECT ticker, dt, {c} - avg({c}) OVER (PARTITION BY ticker) AS x FROM {source} WHERE {c} IS NOT NULL"),
            ("lagged", f"SELECT ticker, x, {lagged} FROM c"), rows)


@query("acf", sql("bars", RETURNS, *acf_sql("r", "ret")))
def acf(spark, sf):
    return rounded(stats.acf(returns(spark, sf), "ret", 30, BY, ORDER), "acf")


AR1 = (("p", f"SELECT *, lag(ret) {W} AS before FROM (SELECT * FROM r WHERE ret IS NOT NULL)"),
       ("a", """SELECT *, ret - regr_intercept(ret, before) OVER (PARTITION BY ticker)
  - regr_slope(ret, before) OVER (PARTITION BY ticker) * before AS e FROM p"""))


@query("ar1_residuals", sql("bars", RETURNS, *AR1, """SELECT ticker, dt, round(e, 6) AS residual,
  round(e * e, 6) AS squared_residual FROM a"""))
def ar1_residuals(spark, sf):
    df = stats.ar1_residuals(returns(spark, sf), "ret", BY, ORDER)
    return rounded(df.select("ticker", "dt", "residual", "squared_residual"), "residual", "squared_residual")


@query("acf_squared_residuals", sql("bars", RETURNS, *AR1, ("s", "SELECT ticker, dt, e * e AS e2 FROM a"), *acf_sql("s", "e2")))
def acf_squared_residuals(spark, sf):
    df = stats.ar1_residuals(returns(spark, sf), "ret", BY, ORDER)
    return rounded(stats.acf(df, "squared_residual", 30, BY, ORDER), "acf")


def pacf_steps(lags=30):
    """Levinson's recursion, a step for each lag; r[1] is lag 0."""
    steps = [("r0", "SELECT ticker, list(acf ORDER BY lag) AS r, []::DOUBLE[] AS phi, [1.0::DOUBLE] AS out FROM acf GROUP BY ticker")]
    for k in range(1, lags + 1):
        past = f"r[2:{k}]"
        last = (f"(r[{k + 1}] - coalesce(list_dot_product(phi, list_reverse({past})), 0)) / (1 - coalesce(list_dot_product(phi, {past}), 0))" if k > 1 else "r[2]")
        steps += [(f"l{k}", f"SELECT *, {last} AS last FROM r{k - 1}"),
                  (f"r{k}", f"""SELECT ticker, r, list_append(list_transform(range(1, {k}), lambda q: phi[q] - last * phi[{k} - q]), last) AS phi,
  list_append(out, last) AS out FROM l{k}""")]
    return steps


PACF_LAGS = 30


@query("pacf", sql("bars", RETURNS, *acf_sql("r", "ret", PACF_LAGS)[:-1], ("acf", acf_sql("r", "ret", PACF_LAGS)[-1].replace("round(", "(").replace(", 6)", ")")),
                   *pacf_steps(PACF_LAGS), f"SELECT ticker, CAST(unnest(range(0, {PACF_LAGS + 1})) AS INT) AS lag, round(unnest(out), 6) AS pacf FROM r{PACF_LAGS}"))
def pacf(spark, sf):
    return rounded(stats.pacf(returns(spark, sf), "ret", PACF_LAGS, BY, ORDER), "pacf")


def elimination_steps(name, source, columns, out):
    """Products of the columns per ticker, then one column after the other taken out of the rest; the first `out` of them."""
    cells = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    steps = [(f"{name}0", "SELECT ticker, count(*) AS n, " + ", ".join(f"sum({columns[i]} * {columns[j]}) AS g{i}_{j}" for i, j in cells)
              + f" FROM {source} GROUP BY ticker")]
    for p in range(out):
        cells = [(i, j) for i, j in cells if i > p]
        steps.append((f"{name}{p + 1}", "SELECT ticker, n, " + ", ".join(f"g{i}_{j} - g{p}_{i} * g{p}_{j} / g{p}_{p} AS g{i}_{j}" for i, j in cells) + f" FROM {name}{p}"))
    return steps


@query("granger_lag1", sql("bars", RETURNS, ("c", f"""SELECT ticker, ret AS y, lag(ret) {W} AS y1, lag(volume) {W} AS x1
  FROM r WHERE ret IS NOT NULL"""), ("k", """SELECT ticker, count(*) AS n, corr(y, x1) AS a, corr(y, y1) AS b, corr(x1, y1) AS d
  FROM c WHERE y1 IS NOT NULL GROUP BY ticker"""), ("m", "SELECT ticker, n, (a - b * d) / sqrt((1 - b * b) * (1 - d * d)) AS pr FROM k"),
       "SELECT ticker, n - 3 AS df_denom, round(pr * pr / (1 - pr * pr) * (n - 3), 6) AS f FROM m"))
def granger_lag1(spark, sf):
    df = stats.granger(returns(spark, sf), [("ret", "volume")], 1, BY, ORDER).where(F.col("test") == "ssr_ftest")
    return df.select("ticker", F.col("df_denom").cast("bigint").alias("df_denom"), F.round("statistic", 6).alias("f"))


def granger_sql(lags):
    """F of all lags, for both directions between returns and volume; each regression is eliminated column by column."""
    past = ", ".join(f"lag({c}, {k}) {W} AS {c}{k}" for c in ("ret", "vol") for k in range(1, max(lags) + 1))
    steps = [("c", f"SELECT ticker, dt, 1.0::DOUBLE AS one, ret, (volume - avg(volume) OVER (PARTITION BY ticker)) AS vol FROM r WHERE ret IS NOT NULL"),
             ("z", f"SELECT *, {past} FROM c")]
    parts = []
    for y, x in (("ret", "vol"), ("vol", "ret")):
        for p in lags:
            name = f"{y}{p}_"
            columns = ["one", *(f"{y}{k}" for k in range(1, p + 1)), *(f"{x}{k}" for k in range(1, p + 1)), y]
            steps += [(f"{name}z", f"SELECT * FROM z WHERE {y}{p} IS NOT NULL"), *elimination_steps(name, f"{name}z", columns, 2 * p + 1)]
            last, full = f"g{2 * p + 1}_{2 * p + 1}", {"ret": "ret", "vol": "volume"}
            parts.append(f"""SELECT ticker, '{full[y]}' AS effect, '{full[x]}' AS cause, CAST({p} AS INT) AS lag, f.n - {2 * p + 1} AS df_denom,
  round((a.{last} / f.{last} - 1) / {p} * (f.n - {2 * p + 1}), 5) AS f FROM {name}{p + 1} a JOIN {name}{2 * p + 1} f USING (ticker)""")
    return sql("bars", RETURNS, *steps, " UNION ALL ".join(parts))


@query("granger_lags", granger_sql([2, 3, 4, 5]))
def granger_lags(spark, sf):
    df = stats.granger(returns(spark, sf), [("ret", "volume"), ("volume", "ret")], 5, BY, ORDER)
    return df.where((F.col("test") == "ssr_ftest") & (F.col("lag") > 1)).select(
        "ticker", "effect", "cause", "lag", F.col("df_denom").cast("bigint").alias("df_denom"), F.round("statistic", 5).alias("f"))


@query("granger_tests")
def granger_tests(spark, sf):
    tests = stats.granger(returns(spark, sf), [("ret", "volume"), ("volume", "ret")], 5, BY, ORDER)
    return rounded(tests, "statistic", "p_value")


def sentiment_series(spark, sf):
    """Index series of sentiment, volatility and next-open movement."""
    df = joins.join_pre_aggregated(views.index_bars(spark, sf), scored_news(spark, sf))
    df = windows.movement_return(df, [], ORDER)
    df = df.withColumn("ret", windows.pct_change("close", [], ORDER) * 100)
    return df.withColumn("volatility", windows.rolling_std("ret", 5, [], ORDER)).select(
        "dt", F.col("aggregate_sentiment_score").alias("sentiment"), "movement", "volatility").where(F.col("volatility").isNotNull())


@query("granger_decisions")
def granger_decisions(spark, sf):
    df = sentiment_series(spark, sf)
    pairs = [("movement", "sentiment"), ("volatility", "sentiment"), ("sentiment", "volatility"),
             ("volatility", "movement"), ("movement", "volatility")]
    return rounded(stats.granger_decision(stats.granger(df, pairs, 3, [], ORDER)), "smallest_p")


@query("adf_lag0", sql("bars", RETURNS, ("d", f"SELECT ticker, ret - lag(ret) {W} AS y, lag(ret) {W} AS x FROM r WHERE ret IS NOT NULL"),
       ("k", """SELECT ticker, count(*) AS n, regr_slope(y, x) AS b, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy,
  regr_sxy(y, x) AS sxy FROM d WHERE x IS NOT NULL GROUP BY ticker"""),
       "SELECT ticker, n, round(b / sqrt((syy - b * sxy) / (n - 2) / sxx), 6) AS statistic FROM k"))
def adf_lag0(spark, sf):
    return rounded(stats.adf(returns(spark, sf), "ret", BY, ORDER, maxlag=0).select("ticker", "n", "statistic"), "statistic")


def adf_sql(lags):
    past = ", ".join(f"lag(y, {k}) {W} AS y{k}" for k in range(1, max(lags) + 1))
    steps = [("d", f"SELECT ticker, dt, 1.0::DOUBLE AS one, ret - lag(ret) {W} AS y, lag(ret) {W} AS x FROM r WHERE ret IS NOT NULL"),
             ("z", f"SELECT *, {past} FROM d WHERE x IS NOT NULL")]
    parts = []
    for p in lags:
        columns = ["one", *(f"y{k}" for k in range(1, p + 1)), "x", "y"]
        steps += [(f"z{p}_", f"SELECT * FROM z WHERE {f'y{p}' if p else 'y'} IS NOT NULL"), *elimination_steps(f"e{p}_", f"z{p}_", columns, p + 1)]
        x, y = p + 1, p + 2
        parts.append(f"""SELECT ticker, CAST({p} AS INT) AS used_lag, n, round(g{x}_{y} / g{x}_{x}
  / sqrt((g{y}_{y} - g{x}_{y} * g{x}_{y} / g{x}_{x}) / (n - {p + 2}) / g{x}_{x}), 6) AS statistic FROM e{p}_{p + 1}""")
    return sql("bars", RETURNS, *steps, " UNION ALL ".join(parts))


@query("adf_lags", adf_sql([0, 1, 2, 3]))
def adf_lags(spark, sf):
    df = returns(spark, sf)
    found = [stats.adf(df, "ret", BY, ORDER, maxlag=p).select("ticker", "used_lag", "n", "statistic") for p in range(4)]
    return rounded(rollup.union_tables(found), "statistic")


@query("adf_tests")
def adf_tests(spark, sf):
    return rounded(stats.adf(returns(spark, sf), "ret", BY, ORDER), "statistic", "p_value", "critical_1", "critical_5", "critical_10")


# ---- volatility models, on logarithmic returns ----

def log_returns(spark, sf):
    return windows.daily_returns(views.bars(spark, sf), BY, ORDER).select("ticker", "dt", "log_return", "intraday_return")


@query("garch_fit")
def garch_fit(spark, sf):
    df = garch.garch_fit(log_returns(spark, sf), "log_return", "dt", BY)
    return rounded(df, *[c for c in df.columns if c not in ("ticker", "dt", "garch_status")], digits=4)


@query("garch_features")
def garch_features(spark, sf):
    df = garch.garch_fit(log_returns(spark, sf), "log_return", "dt", BY)
    df = windows.garch_feature_table(df, BY, ORDER)
    return windows.volatility_features(df, "cond_volatility", "garch_residuals", BY, ORDER)


@query("garch_select")
def garch_select(spark, sf):
    models = garch.garch_models(log_returns(spark, sf), "log_return", "dt", BY, garch.ORDERS)
    return garch.garch_select(models, BY).select("ticker", "p", "q", "n", "mu", "omega", "alpha", "beta", "loglik", "aic")


@query("garch_forecast")
def garch_forecast(spark, sf):
    rows = log_returns(spark, sf)
    return garch.garch_forecast(rows, garch.garch_models(rows, "log_return", "dt", BY), BY)


@query("garch_compare")
def garch_compare(spark, sf):
    return garch_blocks.garch_compare(log_returns(spark, sf), "log_return", "dt", "ticker")


PATHS = {"garch_variance_path": garch_blocks.Garch(0.0, 40.0, (0.08,), (0.9,)),
         "garch_variance_path_22": garch_blocks.Garch(0.5, 60.0, (0.05, 0.04), (0.6, 0.2))}


def path_sql(g):
    """A recursion over the days; each row carries the last two variances and squared residuals."""
    (a1, a2), (b1, b2) = (*g.alpha, 0.0)[:2], (*g.beta, 0.0)[:2]
    body = sql("index_bars", ("r", "SELECT dt, 100 * (close / lag(close) OVER (ORDER BY dt) - 1) AS r FROM index_bars"),
               ("i", f"SELECT dt, r, r - {g.mu}::DOUBLE AS e, row_number() OVER (ORDER BY dt) AS i FROM r WHERE r IS NOT NULL"),
               ("w", "SELECT sum(pow(0.94::DOUBLE, i - 1) * e * e) / sum(pow(0.94::DOUBLE, i - 1)) AS s FROM i WHERE i <= 75"),
               ("p", f"""SELECT CAST(0 AS BIGINT) AS i, s AS h1, s AS h2, s AS x1, s AS x2 FROM w UNION ALL
  SELECT i.i, {g.omega}::DOUBLE + {a1}::DOUBLE * p.x1 + {a2}::DOUBLE * p.x2 + {b1}::DOUBLE * p.h1 + {b2}::DOUBLE * p.h2, p.h1, i.e * i.e, p.x1
  FROM p JOIN i ON i.i = p.i + 1"""),
               f"""SELECT dt, round(r, 6) AS r, round(h1, 6) AS cond_variance, round({g.omega}::DOUBLE + {a1}::DOUBLE * x1 + {a2}::DOUBLE * x2
  + {b1}::DOUBLE * h1 + {b2}::DOUBLE * h2, 6) AS garch_cond_variance, round(e, 6) AS garch_residuals FROM i JOIN p USING (i)""")
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


def variance_path(name):
    def run(spark, sf):
        df = views.index_bars(spark, sf).withColumn("ret", windows.pct_change("close", [], ORDER))
        return rounded(garch_blocks.variance_path(df, "ret", "dt", PATHS[name]), "r", "cond_variance", "garch_cond_variance", "garch_residuals")
    return run


for _name in PATHS:
    query(_name, path_sql(PATHS[_name]))(variance_path(_name))


# ---- vectors ----

MEAN = ("m", """SELECT dt, i, avg(CAST(emb[i] AS DOUBLE)) AS x FROM news_vectors, range(1, 65) t(i) GROUP BY dt, i""")


@query("mean_vector", sql("news_vectors", MEAN, "SELECT dt, i - 1 AS pos, round(x, 6) AS x FROM m"))
def mean_vector(spark, sf):
    df = rollup.mean_vector(views.news_vectors(spark, sf), ["dt"], "emb")
    return df.select("dt", F.posexplode("emb").alias("pos", "x")).select("dt", F.col("pos").cast("bigint"), F.round("x", 6).alias("x"))


@query("asof_prev_embedding", sql("news_vectors", MEAN, ("d", "SELECT dt, lag(dt) OVER (ORDER BY dt) AS p FROM (SELECT DISTINCT dt FROM news_vectors)"),
       ("g", "SELECT d.dt, d.p, i FROM d, range(1, 65) t(i)"),
       "SELECT g.dt, g.i - 1 AS pos, round(coalesce(m.x, 0), 6) AS x FROM g LEFT JOIN m ON m.dt = g.p AND m.i = g.i"))
def asof_prev_embedding(spark, sf):
    df = joins.asof_prev_vector(views.news_vectors(spark, sf), "emb", 64)
    return df.select("dt", F.posexplode("prev_day_embedding").alias("pos", "x")).select(
        "dt", F.col("pos").cast("bigint"), F.round("x", 6).alias("x"))


@query("cosine", sql("", ("s", "SELECT count(*) AS n FROM embeddings"), ("v AS MATERIALIZED", """SELECT d.doc_id AS news_id,
  CAST(DATE '1995-01-01' + CAST((d.doc_id % 400) * 6 AS INT) AS DATE) AS dt, CAST(e.embedding AS DOUBLE[]) AS emb
  FROM (SELECT doc_id, doc_id % n AS k FROM documents, s) d JOIN embeddings e ON e.vec_id = d.k"""),
  ("m AS MATERIALIZED", """SELECT dt, list(x ORDER BY i) AS mean FROM (SELECT dt, i, avg(x) AS x FROM
  (SELECT dt, unnest(emb) AS x, generate_subscripts(emb, 1) AS i FROM v) GROUP BY dt, i) GROUP BY dt"""),
  "SELECT news_id, dt, round(list_cosine_similarity(emb, mean), 6) AS similarity FROM v JOIN m USING (dt)"))
def cosine_query(spark, sf):
    v = views.news_vectors(spark, sf)
    means = rollup.mean_vector(v, ["dt"], "emb").withColumnRenamed("emb", "mean")
    return v.join(means, "dt").select("news_id", "dt", F.round(cosine("emb", "mean"), 6).alias("similarity"))


def multimodal_rows(spark, sf):
    """Scaled numbers and the previous day's mean vector per date."""
    df = joins.join_pre_aggregated(views.index_bars(spark, sf), scored_news(spark, sf))
    df = windows.baseline_features(df, [], ORDER, sentiment=True)
    df = df.join(joins.asof_prev_vector(views.news_vectors(spark, sf), "emb", 64), "dt")
    return scaling.scale(df, windows.SENTIMENT_FEATURES)


@query("market_vector", sql("news_vectors index_bars", MEAN, ("d", "SELECT dt, lag(dt) OVER (ORDER BY dt) AS p FROM (SELECT DISTINCT dt FROM news_vectors)"),
       ("g", "SELECT d.dt, d.p, open, close, i FROM d JOIN index_bars USING (dt), range(1, 65) t(i)"),
       """SELECT g.dt, g.i + 1 AS pos, round(coalesce(m.x, 0), 6) AS x FROM g LEFT JOIN m ON m.dt = g.p AND m.i = g.i
  UNION ALL SELECT dt, 0, round(open, 6) FROM g WHERE i = 1 UNION ALL SELECT dt, 1, round(close, 6) FROM g WHERE i = 1"""))
def market_vector(spark, sf):
    """All values: two prices, then the mean vector of the news date before."""
    dates = rollup.distinct_dates(views.news_vectors(spark, sf))
    df = joins.asof_prev_vector(views.news_vectors(spark, sf), "emb", 64).join(dates, "dt").join(views.index_bars(spark, sf), "dt")
    df = vectors.market_vector(df, ["open", "close"], "prev_day_embedding")
    return df.select("dt", F.posexplode("market_vector").alias("pos", "x")).select("dt", F.col("pos").cast("bigint"), F.round("x", 6).alias("x"))


@query("pca")
def pca(spark, sf):
    df = vectors.pca(views.news_vectors(spark, sf), "emb", 8)
    return df.select("news_id", F.posexplode("emb").alias("pos", "x")).withColumn("x", F.round("x", 6))


# Turning the axes keeps the total variance; the squared variances add up to the squared covariance matrix only if the
# turned columns do not vary together, i.e. if the axes are its eigenvectors.
@query("pca_spectrum", sql("news_vectors", ("u", "SELECT news_id, unnest(emb)::DOUBLE AS x, generate_subscripts(emb, 1) AS i FROM news_vectors"),
       ("c", "SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS v FROM u a JOIN u b USING (news_id) GROUP BY 1, 2"),
       """SELECT CAST(64 AS BIGINT) AS components, (SELECT count(*) FROM news_vectors) AS n_rows,
  round(sum(CASE WHEN i = j THEN v ELSE 0 END), 6) AS total_variance, round(sum(v * v), 6) AS squared_variance, true AS falling FROM c"""))
def pca_spectrum(spark, sf):
    """Variances along all principal components: their sum, the sum of their squares, and whether they fall."""
    turned = vectors.pca(views.news_vectors(spark, sf), "emb", 64).select(F.posexplode("emb").alias("pos", "x"))
    along = turned.groupBy("pos").agg(F.var_samp("x").alias("v"), F.count(F.lit(1)).alias("n"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"])
    falls = F.forall(F.sequence(F.lit(0), F.size("vs") - 2), lambda i: F.get("vs", i) >= F.get("vs", i + 1))
    whole = along.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("n_rows"), F.round(F.sum("v"), 6).alias("total_variance"),
                      F.round(F.sum(F.col("v") * F.col("v")), 6).alias("squared_variance"), in_order.alias("vs"))
    return whole.withColumn("falling", falls).drop("vs")


@query("modal_similarity")
def modal_similarity(spark, sf):
    df = vectors.modal_similarity(multimodal_rows(spark, sf), windows.SENTIMENT_FEATURES, "prev_day_embedding")
    return profile.describe(df, ["similarity"])


@query("fuse_vectors")
def fuse_vectors(spark, sf):
    df = multimodal_rows(spark, sf).withColumn("numbers", F.array(*windows.SENTIMENT_FEATURES))
    df = vectors.fuse_vectors(df, "numbers", "prev_day_embedding", 8, 64)
    return df.select("dt", F.size("market_vector").alias("size"),
                     F.round(F.aggregate("market_vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


FUSED = 24


def layer_sql(layer: int, source: str, inputs: int, seed: int = 42, lift: bool = False) -> str:
    """A linear layer over (dt, i, x), with the weights of vectors.hashed_layer."""
    def weight(i):
        cell = f"(({layer} * {vectors.LAYER_CELLS} + {i}) * {vectors.LAYER_CELLS} + j + {seed + 1})::BIGINT"
        first = f"({cell} * {vectors.HASH_FACTOR} % {vectors.HASH_PRIME})"
        return f"((2.0::DOUBLE * (({first} * {first} + {cell}) % {vectors.HASH_PRIME}) / {vectors.HASH_PRIME}::DOUBLE - 1) / sqrt({inputs}::DOUBLE))"

    x = f"CASE WHEN v < 0 THEN {vectors.NEGATIVE_SLOPE} * v ELSE v END" if lift else "v"
    return (f"SELECT dt, j AS i, {x} AS x FROM (SELECT dt, j, sum(x * {weight('i')}) + {weight(inputs)} AS v "
            f"FROM {source}, range(0, {FUSED}) t(j) GROUP BY dt, j)")


@query("fuse_vectors_whole", sql("news_vectors index_bars", MEAN, ("d", "SELECT dt, lag(dt) OVER (ORDER BY dt) AS p FROM (SELECT DISTINCT dt FROM news_vectors)"),
       ("g", "SELECT d.dt, d.p, open, close, high, volume FROM d JOIN index_bars USING (dt)"),
       ("a0", """SELECT dt, 0 AS i, open / 1e5::DOUBLE AS x FROM g UNION ALL SELECT dt, 1, close / 1e5::DOUBLE FROM g
  UNION ALL SELECT dt, 2, high / 1e5::DOUBLE FROM g UNION ALL SELECT dt, 3, volume::DOUBLE / 10 FROM g"""),
       ("b0", "SELECT g.dt, t.i, coalesce(m.x, 0) AS x FROM g CROSS JOIN range(0, 64) t(i) LEFT JOIN m ON m.dt = g.p AND m.i = t.i + 1"),
       ("a1", layer_sql(0, "a0", 4, lift=True)), ("b1", layer_sql(1, "b0", 64, lift=True)),
       ("b2", layer_sql(2, "b1", FUSED)), ("b3", layer_sql(3, "b2", FUSED)), ("a2", layer_sql(4, "a1", FUSED)), ("a3", layer_sql(5, "a2", FUSED)),
       ("c", f"SELECT * FROM b3 UNION ALL SELECT dt, i + {FUSED}, x FROM a3"), ("f", layer_sql(6, "c", 2 * FUSED)),
       "SELECT dt, i AS pos, round(x, 6) AS x FROM f"))
def fuse_vectors_whole(spark, sf):
    """All values of the fused vectors: prices and volume with the mean vector of the news date before."""
    dates = rollup.distinct_dates(views.news_vectors(spark, sf))
    df = joins.asof_prev_vector(views.news_vectors(spark, sf), "emb", 64).join(dates, "dt").join(views.index_bars(spark, sf), "dt")
    df = df.withColumn("numbers", F.array(*[F.col(c).cast("double") / 1e5 for c in ("open", "close", "high")], F.col("volume") / F.lit(10.0)))
    df = vectors.fuse_vectors(df, "numbers", "prev_day_embedding", 4, 64, width=FUSED)
    return df.select("dt", F.posexplode("market_vector").alias("pos", "x")).select("dt", F.col("pos").cast("bigint"), F.round("x", 6).alias("x"))


@query("hashed_text_vectors")
def hashed_text_vectors(spark, sf):
    return vectors.hashed_vectors(views.news(spark, sf).select("news_id", "dt", "content"), "content").drop("content")


def letter_share_encoder():
    """Stands in for a text model: shares of the letters a to z over the whole text."""
    def encode(texts):
        out = np.zeros((len(texts), 26))
        for i, t in enumerate(texts):
            codes = np.frombuffer(t.lower().encode("ascii", "ignore"), dtype=np.uint8)
            counts = np.bincount(codes[(codes >= 97) & (codes <= 122)] - 97, minlength=26)
            out[i] = counts / max(1, counts.sum())
        return out
    return encode


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("embed_texts", """WITH n AS (SELECT doc_id, lower(text) AS t FROM documents), """
       + "c AS (SELECT doc_id, " + ", ".join(f"length(t) - length(replace(t, '{x}', '')) AS {x}_" for x in LETTERS) + " FROM n), "
       + "s AS (SELECT *, " + " + ".join(f"{x}_" for x in LETTERS) + " AS total FROM c) SELECT doc_id AS news_id, "
       + ", ".join(f"round(CAST(CAST({x}_ / greatest(total, 1) AS FLOAT) AS DOUBLE), 5) AS {x}" for x in LETTERS) + " FROM s")
def embed_texts(spark, sf):
    docs = views.news(spark, sf).select("news_id", "content")
    df = vectors.embed_texts(docs, "content", letter_share_encoder)
    return df.select("news_id", *[F.round(F.get("emb", F.lit(LETTERS.index(x))).cast("double"), 5).alias(x) for x in LETTERS])


def list_sql(words):
    return ", ".join(f"'{w}'" for w in words)


@query("word_list_scores", f"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM documents),
  c AS (SELECT doc_id, count(*) FILTER (WHERE w IN ({list_sql(vectors.POSITIVE_WORDS)})) AS p,
  count(*) FILTER (WHERE w IN ({list_sql(vectors.NEGATIVE_WORDS)})) AS n FROM w GROUP BY doc_id),
  s AS (SELECT doc_id, (p / (p + n + 1) - n / (p + n + 1)) * (1 - 1 / (p + n + 1)) AS x FROM c)
  SELECT doc_id, CASE WHEN abs(x) < 0.005 THEN 0.0 ELSE round(x, 2) END AS sentiment_score FROM s""")
def word_list_scores(spark, sf):
    df = vectors.word_list_scores(views.documents(spark, sf), "text")
    return df.select("doc_id", "sentiment_score")


def length_scorer():
    """Stands in for a sentiment model: positive share grows with the length of the text."""
    def score(texts):
        pos = np.array([len(t) % 10 / 10 for t in texts])
        return np.column_stack([0.5 * (1 - pos), 0.5 * (1 - pos), pos])
    return score


@query("score_sentiment", ("WITH w AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(lower(text), "
       "'[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), ' ') AS words FROM documents), "
       f"n AS (SELECT doc_id, length(array_to_string(list_filter(words, lambda w: w <> '' AND w NOT IN ({STOPS_SQL})), ' ')) % 10 / 10 AS pos FROM w), "
       "s AS (SELECT doc_id, (pos - 0.5::DOUBLE * (1 - pos)) * (1 - 0.5::DOUBLE * (1 - pos)) AS x FROM n) "
       "SELECT doc_id AS news_id, CASE WHEN abs(x) < 0.005 THEN 0.0 ELSE round(x, 2) END AS sentiment_score FROM s"))
def score_sentiment(spark, sf):
    df = vectors.score_sentiment(views.news(spark, sf).select("news_id", "content"), "content", length_scorer)
    return df.select("news_id", "sentiment_score")


# ---- neighbours and synthetic rows ----


POINTS = (*FEATURE_STEPS[:2], ("f", f"""SELECT *, row_number() {W} AS pos, date_diff('day', DATE '1990-01-01', dt) * 5
  + CAST(substr(ticker, 1, 1) AS INT) - 1 AS id, CASE WHEN gap > 0 THEN 1 ELSE 0 END AS y FROM v"""),
  ("g", "SELECT id, y, gap, daily_return / 100 AS ret, volatility / 100 AS vol FROM f WHERE pos > 7"),
  ("sm", "SELECT y FROM g GROUP BY y ORDER BY count(*) LIMIT 1"), ("mi", "SELECT * FROM g WHERE y = (SELECT y FROM sm)"))


def labelled_points(spark, sf):
    df = views.bars(spark, sf).withColumn("gap", windows.gap_return(BY, ORDER))
    df = windows.baseline_features(df, BY, ORDER)
    day = F.date_diff("dt", F.lit("1990-01-01").cast("date")) * 5 + F.substring("ticker", 1, 1).cast("int") - 1
    return df.select(day.alias("id"), F.col("movement").alias("y"), "gap", (F.col("daily_return") / 100).alias("ret"),
                     (F.col("volatility") / 100).alias("vol"))


@query("smote_neighbours", sql("bars", *POINTS, ("d", """SELECT a.id, b.id AS neighbour_id,
  sqrt((a.gap - b.gap) ** 2 + (a.ret - b.ret) ** 2 + (a.vol - b.vol) ** 2) AS d FROM mi a JOIN mi b ON a.id <> b.id"""),
       """SELECT id, rank, neighbour_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour_id) AS rank
  FROM d) WHERE rank <= 5"""))
def smote_neighbours(spark, sf):
    points = labelled_points(spark, sf)
    small = points.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("y", "n")).scalar()
    minority = points.withColumn("_small", small).where(F.col("y") == F.col("_small"))
    df = neighbours.nearest(minority, ["gap", "ret", "vol"], "id", 5)
    return df.select("id", F.posexplode("near").alias("rank", "n")).select(
        "id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("n.id").alias("neighbour_id"), F.round("n.d", 6).alias("d"))


LAGGED = {"close": "close_lag1", "high": "high_lag1", "volume": "volume_lag1", "ret": "daily_return_lag1", "vol": "volatility_lag1",
          "s": "aggregate_sentiment_score_lag1", "svol": "sentiment_volatility_lag1"}
ALL_POINTS = (
    SCORED, ("a", "SELECT dt, sum(sentiment_score) AS s FROM scored GROUP BY dt"), ("m", "SELECT bars.*, s FROM bars JOIN a USING (dt)"),
    ("r", f"SELECT *, open / lag(close) {W} - 1 AS gap, (close / lag(close) {W} - 1) * 100 AS ret FROM m"),
    ("v", f"SELECT *, {roll_sql('stddev_samp', 'ret', 5)} AS vol, {roll_sql('stddev_samp', 's', 5)} AS svol FROM r"),
    ("f", f"SELECT *, row_number() {W} AS pos, {', '.join(f'lag({c}) {W} AS {n}' for c, n in LAGGED.items())} FROM v"),
    ("g", f"""SELECT date_diff('day', DATE '1990-01-01', dt) * 5 + CAST(substr(ticker, 1, 1) AS INT) - 1 AS id, CASE WHEN gap > 0 THEN 1 ELSE 0 END AS y,
  {', '.join(f'({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}' for c in windows.SENTIMENT_FEATURES)} FROM f WHERE pos > 12"""),
    ("sm", "SELECT y FROM g GROUP BY y ORDER BY count(*) LIMIT 1"), ("mi", "SELECT * FROM g WHERE y = (SELECT y FROM sm)"))


@query("smote_neighbours_all_features", sql("bars news_scores", *ALL_POINTS, ("d", f"""SELECT a.id, b.id AS neighbour_id,
  sqrt({' + '.join(f'(a.{c} - b.{c}) ** 2' for c in windows.SENTIMENT_FEATURES)}) AS d FROM mi a JOIN mi b ON a.id <> b.id"""),
       """SELECT id, rank, neighbour_id, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, neighbour_id) AS rank
  FROM d) WHERE rank <= 5"""))
def smote_neighbours_all_features(spark, sf):
    """Neighbours in all eight scaled features of bars with sentiment."""
    df = joins.join_pre_aggregated(views.bars(spark, sf), scored_news(spark, sf))
    df = windows.baseline_features(df, BY, ORDER, sentiment=True)
    day = F.date_diff("dt", F.lit("1990-01-01").cast("date")) * 5 + F.substring("ticker", 1, 1).cast("int") - 1
    points = durable(scaling.scale(df.withColumn("id", day), windows.SENTIMENT_FEATURES).select("id", F.col("movement").alias("y"), *windows.SENTIMENT_FEATURES))
    small = points.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("y", "n")).scalar()
    minority = points.withColumn("_small", small).where(F.col("y") == F.col("_small"))
    near = neighbours.nearest(minority, windows.SENTIMENT_FEATURES, "id", 5)
    return near.select("id", F.posexplode("near").alias("rank", "n")).select(
        "id", (F.col("rank") + 1).cast("bigint").alias("rank"), F.col("n.id").alias("neighbour_id"), F.round("n.d", 6).alias("d"))


@query("smote_class_sizes", sql("bars", *POINTS, "SELECT y, (SELECT max(n) FROM (SELECT count(*) AS n FROM g GROUP BY y)) AS n FROM g GROUP BY y"))
def smote_class_sizes(spark, sf):
    df = neighbours.oversample(labelled_points(spark, sf), ["gap", "ret", "vol"], "y", "id")
    return df.groupBy("y").agg(F.count(F.lit(1)).alias("n"))


def hash_sql(x, seed=0):
    return f"(((({x}) + {1 + seed}) % 2147483647) * 48271 * 69621 % 2147483647)"


@query("smote", sql("bars", *POINTS, ("nb", """SELECT id, list(neighbour_id ORDER BY d, neighbour_id) AS near FROM (SELECT *,
  row_number() OVER (PARTITION BY id ORDER BY d, neighbour_id) AS k FROM (SELECT a.id, b.id AS neighbour_id,
  sqrt((a.gap - b.gap) ** 2 + (a.ret - b.ret) ** 2 + (a.vol - b.vol) ** 2) AS d FROM mi a JOIN mi b ON a.id <> b.id)) WHERE k <= 5 GROUP BY id"""),
       ("sz", "SELECT max(n) - min(n) AS wanted, min(n) AS small FROM (SELECT count(*) AS n FROM g GROUP BY y)"),
       ("cp", f"""SELECT id, near, wanted // small + CASE WHEN row_number() OVER (ORDER BY {hash_sql('id')}, id) <= wanted % small
  THEN 1 ELSE 0 END AS copies FROM nb, sz"""), ("ex", "SELECT id, near, unnest(range(1, copies + 1)) AS copy FROM cp"),
       ("dr", f"SELECT *, {hash_sql(hash_sql('id') + ' + copy * 7919')} AS draw FROM ex"),
       ("ch", f"SELECT id, copy, near[CAST(draw % 5 AS INT) + 1] AS nid, {hash_sql('draw', 1)} / 2147483647.0::DOUBLE AS u FROM dr"),
       """SELECT id AS base_id, nid AS neighbour_id, copy, round(u, 6) AS segment_share, round(a.gap + u * (b.gap - a.gap), 6) AS gap,
  round(a.ret + u * (b.ret - a.ret), 6) AS ret, round(a.vol + u * (b.vol - a.vol), 6) AS vol, a.y FROM ch
  JOIN mi a USING (id) JOIN mi b ON b.id = ch.nid"""))
def smote(spark, sf):
    df = neighbours.smote(labelled_points(spark, sf), ["gap", "ret", "vol"], "y", "id")
    return rounded(df, "segment_share", "gap", "ret", "vol")


