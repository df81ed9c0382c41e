"""Queries on prompts, answers, classifiers and whole evaluations."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tickerloom.catalog.bars import BY, ORDER, rounded
from tickerloom.catalog.evaluation import CLASS, CONF, ROUND, TRADE
from tickerloom.catalog.news import ARTICLE_STEPS, scored_news
from tickerloom.catalog.registry import query
from tickerloom.functions import prompts
from tickerloom.operators import folds, joins, logistic_grid, metrics, models, scaling, windows
from tickerloom.plans import baseline, multimodal, prompting, views
from tickerloom.plans.views import sql
from tickerloom.session import durable
from tickerloom.sources.writers import prediction_records

# ---- prompts and answers ----

STRIP = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
TAIL = STRIP.format(c="string_split(output, '<<<ANSWER_START>>>')[-1]")
LAST = "lower(regexp_split_to_array(" + STRIP.format(c="{c}") + ", '\\s+')[-1])"


def word_sql(found, text):
    last = LAST.format(c=text)
    return (f"CASE WHEN {found} IN ('up', 'down') THEN {found} WHEN {last} IN ('up', 'down') THEN {last} END")


SHOT_WORD = word_sql(f"lower(regexp_extract({TAIL}, '(?i)(up|down)\\s*$', 1))", TAIL)
ZERO_WORD = word_sql("lower(regexp_extract(output, '(?i)</Answer/>\\s*:\\s*(up|down)', 1))", "output")


@query("parse_answer", sql("answers", ("w", f"SELECT id, {SHOT_WORD} AS shot_word, {ZERO_WORD} AS zero_word FROM answers"),
       """SELECT id, shot_word, zero_word, CASE WHEN shot_word = 'down' THEN 0 ELSE 1 END AS label,
  coalesce(shot_word, 'error') AS status FROM w"""))
def parse_answer(spark, sf):
    w = views.answers(spark, sf).select("id", prompts.parse_answer("output").alias("shot_word"),
                                        prompts.parse_answer("output", shots=0).alias("zero_word"))
    return w.withColumns({"label": prompts.answer_label("shot_word"), "status": prompts.answer_status("shot_word")})


@query("answer_status_counts", sql("answers", ("w", f"SELECT {SHOT_WORD} AS word FROM answers"),
       "SELECT coalesce(word, 'error') AS status, count(*) AS n FROM w GROUP BY 1"))
def answer_status_counts(spark, sf):
    w = views.answers(spark, sf).select(prompts.answer_status(prompts.parse_answer("output")).alias("status"))
    return w.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("strip_echo", sql("answers", "SELECT id, " + STRIP.format(c="output") + " AS output FROM answers"))
def strip_echo(spark, sf):
    a = views.answers(spark, sf).withColumn("prompt", F.concat(F.lit("question "), F.col("id").cast("string")))
    return a.select("id", prompts.strip_echo(F.concat("prompt", "output"), "prompt").alias("output"))


def text_sql(t):
    return "'" + t.replace("'", "''") + "'"


def prompt_sql(shots):
    fields = " ,".join(f"CASE WHEN {c} IS NOT NULL THEN '{n}: ' || CAST(CAST(trunc({c}) AS BIGINT) AS VARCHAR) END"
                       for n, c in (("Open", "open"), ("Close_lag1", "close_lag1"), ("High_lag1", "high_lag1"), ("Volume_lag1", "volume_lag1")))
    return (f"{text_sql(prompts.HEADS[shots])} || '<Numerical Data>: \"' || concat_ws('; ', {fields}) || '\"' || chr(10) || "
            f"'<News Article>: ' || prev_day_news || chr(10) || chr(10) || '{prompts.TAILS[shots]}'")


PREV = (("d", "SELECT dt, lag(dt) OVER (ORDER BY dt) AS p FROM (SELECT DISTINCT dt FROM news)"),
        ("t", "SELECT dt AS p, string_agg(content, ' ' ORDER BY news_id) AS txt FROM news GROUP BY dt"),
        ("n", "SELECT d.dt, coalesce(txt, 'No previous news available') AS prev_day_news FROM d LEFT JOIN t USING (p)"),
        ("b", "SELECT dt, open, lag(close) OVER w AS close_lag1, lag(high) OVER w AS high_lag1, lag(volume) OVER w AS volume_lag1 "
              "FROM index_bars WINDOW w AS (ORDER BY dt)"))


@query("prompt_text", sql("index_bars news", *PREV, "SELECT dt, md5(" + prompt_sql(0) + ") AS zero_shot, md5(" + prompt_sql(1)
                          + ") AS one_shot, md5(" + prompt_sql(2) + ") AS few_shot FROM n JOIN b USING (dt)"))
def prompt_text(spark, sf):
    b = windows.add_lags(views.index_bars(spark, sf), ["close", "high", "volume"], [1], [], ORDER)
    rows = joins.asof_prev_text(views.news(spark, sf), "content", "news_id").join(b, "dt")
    fields = {"Open": "open", "Close_lag1": "close_lag1", "High_lag1": "high_lag1", "Volume_lag1": "volume_lag1"}
    return rows.select("dt", *[F.md5(prompts.build_prompt(fields, "prev_day_news", s)).alias(n)
                               for s, n in ((0, "zero_shot"), (1, "one_shot"), (2, "few_shot"))])


@query("prediction_records", sql("predictions", """SELECT strftime(dt, '%Y-%m-%dT00:00:00') AS "Date", fold AS "Fold",
  round(ret, 4) AS "Daily_Return", round(before, 4) AS "Daily_Return_lag1", y_true AS "Ground_Truth", y_pred AS "Model_Prediction"
  FROM (SELECT *, lag(ret) OVER (ORDER BY dt) AS before FROM predictions) WHERE fold IS NOT NULL"""))
def prediction_records_query(spark, sf):
    p = windows.add_lags(views.predictions(spark, sf), ["ret"], [1], [], ORDER).withColumnRenamed("ret_lag1", "daily_return_lag1")
    return rounded(prediction_records(p.where(F.col("fold").isNotNull())), "Daily_Return", "Daily_Return_lag1", digits=4)


@query("prediction_json", sql("predictions", """SELECT dt, fold, y_true, y_pred FROM predictions WHERE fold IS NOT NULL"""))
def prediction_json(spark, sf):
    lines = views.predictions(spark, sf).where(F.col("fold").isNotNull()).select(
        F.to_json(F.struct(F.date_format("dt", "yyyy-MM-dd").alias("Date"), F.col("fold").alias("Fold"),
                           F.col("y_true").alias("Ground_Truth"), F.col("y_pred").alias("Model_Prediction"))).alias("line"))
    back = lines.select(F.from_json("line", "Date date, Fold int, Ground_Truth int, Model_Prediction int").alias("r"))
    return back.select(F.col("r.Date").alias("dt"), F.col("r.Fold").alias("fold"), F.col("r.Ground_Truth").alias("y_true"),
                       F.col("r.Model_Prediction").alias("y_pred"))


def articles(spark, sf):
    return multimodal.article_table(views.index_bars(spark, sf), views.news(spark, sf), scored_news(spark, sf))


@query("clean_articles", sql("index_bars news news_scores", *ARTICLE_STEPS,
       "SELECT dt, news_id, movement, open, close_lag1, cleaned_content FROM ar"))
def clean_articles(spark, sf):
    return articles(spark, sf).select("dt", "news_id", "movement", "open", "close_lag1", "cleaned_content")


def falling_client():
    """Stands in for a text model: repeats the prompt, then answers by the last return in it."""
    def answer(texts):
        out = []
        for t in texts:
            value = re.findall(r"Daily_Return_lag1: (-?\d+)", t)[-1]
            out.append(t + (" down" if int(value) < 0 else " Up"))
        return out
    return answer


LOG_STEPS = ARTICLE_STEPS + (
    ("i", "SELECT *, row_number() OVER (ORDER BY dt, news_id) - 1 AS i, count(*) OVER () AS n FROM ar"),
    ("g", "SELECT *, CASE WHEN i >= n - 5 * (n // 6) THEN CAST((i - (n - 5 * (n // 6))) // (n // 6) AS INT) + 1 END AS fold FROM i"),
    ("fd", """SELECT dt, fold, arg_min(daily_return, news_id) AS ret, arg_min(daily_return_lag1, news_id) AS daily_return_lag1,
  arg_min(movement, news_id) AS y_true FROM g WHERE fold IS NOT NULL GROUP BY dt, fold"""),
    ("p", "SELECT *, CASE WHEN trunc(daily_return_lag1) < 0 THEN 0 ELSE 1 END AS y_pred FROM fd"))


@query("prompt_predictions", sql("index_bars news news_scores", *LOG_STEPS, """SELECT dt, fold, round(ret, 4) AS ret,
  round(daily_return_lag1, 4) AS daily_return_lag1, y_true, y_pred, CASE WHEN y_pred = 0 THEN 'down' ELSE 'up' END AS status FROM p"""))
def prompt_predictions(spark, sf):
    log = prompting.predict(prompting.prompt_table(articles(spark, sf)), falling_client)
    return rounded(log, "ret", "daily_return_lag1", digits=4)


@query("prompt_fold_report", sql("index_bars news news_scores", *LOG_STEPS, ("b", """SELECT fold, y_true, y_pred, y_pred * ret AS r FROM p
  UNION ALL SELECT NULL, y_true, y_pred, y_pred * ret FROM p"""), ("c", f"SELECT fold, {CONF}, {TRADE} FROM b GROUP BY fold"),
       f"SELECT fold, {CLASS}, win_rate, profit_factor, sharpe FROM c"))
def prompt_fold_report(spark, sf):
    log = prompting.predict(prompting.prompt_table(articles(spark, sf), shots=1), falling_client, shots=1)
    return rounded(metrics.fold_report(log), *ROUND)


@query("training_texts", sql("bars news", ("b", """SELECT ticker, dt, CASE WHEN open / lag(close) OVER w - 1 > 0 THEN 1 ELSE 0 END AS movement,
  lag(close) OVER w AS before FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY dt)"""), """SELECT title, movement FROM news n JOIN b
  ON b.ticker = n.ticker AND b.dt = CAST(n.dt + INTERVAL 1 DAY AS DATE) WHERE before IS NOT NULL AND n.ticker <> '5-LOW'"""))
def training_texts(spark, sf):
    labelled = windows.movement_label(views.bars(spark, sf), BY, ORDER)
    tables = {t: (views.news(spark, sf).where(F.col("ticker") == t), labelled.where(F.col("ticker") == t).drop("ticker"))
              for t in views.TICKERS[:4]}
    return multimodal.training_texts(tables)


# ---- classifiers ----

@query("logistic_folds")
def logistic_folds(spark, sf):
    table = baseline.feature_table(views.index_bars(spark, sf))
    return models.folds_scored(table, windows.BASE_FEATURES, "movement", 5, ["dt", "fold", "ret"])


@query("baseline_report")
def baseline_report(spark, sf):
    return rounded(baseline.evaluate(views.index_bars(spark, sf)), *ROUND)


@query("baseline_balanced_report")
def baseline_balanced_report(spark, sf):
    return rounded(baseline.evaluate(views.index_bars(spark, sf), balanced=True), *ROUND)


@query("sentiment_report")
def sentiment_report(spark, sf):
    return rounded(baseline.evaluate(views.index_bars(spark, sf), scored_news(spark, sf)), *ROUND)


# With a free intercept, the mean probability of the training rows equals the share of ups, whatever the penalty.
GRID_STEPS = (("g", """SELECT dt, open / lag(close) OVER (ORDER BY dt) - 1 AS gap, row_number() OVER (ORDER BY dt) - 8 AS i FROM index_bars"""),
              ("r", "SELECT i, CASE WHEN gap > 0 THEN 1 ELSE 0 END AS y, CAST(floor((count(*) OVER () + 0.0) / 4) AS BIGINT) AS part, count(*) OVER () AS n FROM g WHERE i >= 0"),
              ("s", "SELECT CAST(f AS INT) AS fold, count(*) AS n_train, avg(y) AS share FROM r, range(1, 4) t(f) WHERE i < n - 3 * part + (f - 1) * part GROUP BY f"),
              ("p", "SELECT unnest(['l1', 'l2']) AS penalty"), ("c", "SELECT unnest([0.001, 0.01, 0.1, 1.0]::DOUBLE[]) AS c"))


def grid_fits(spark, sf):
    """(feature table in three folds, fits of the whole grid on the rows before each fold)."""
    table = durable(baseline.feature_table(views.index_bars(spark, sf), k=3))
    wanted = [logistic_grid.Fit(f, penalty, c) for f in range(1, 4) for penalty, c in models.GRID]
    return table, logistic_grid.fit_grid(table, windows.BASE_FEATURES, "movement", wanted)


def on_training_rows(spark, sf, table, fits, sums):
    """One row per fit with `sums` (named columns made from a probability) of its training rows, from one aggregate."""
    cells = []
    for f in fits:
        seen = logistic_grid.before("fold", f.fold)
        p = logistic_grid.probability(f, windows.BASE_FEATURES)
        named = {n: c for n, c in sums(f, p, seen).items()}
        cells.append(F.struct(F.lit(f.fold).alias("fold"), F.lit(f.penalty).alias("penalty"), F.lit(f.c).alias("c"), *[c.alias(n) for n, c in named.items()]))
    return table.agg(F.array(*cells).alias("f")).select(F.inline("f"))


@query("grid_mean_probability", sql("index_bars", *GRID_STEPS, """SELECT fold, penalty, c, n_train, round(share, 5) AS mean_probability FROM s, p, c"""))
def grid_mean_probability(spark, sf):
    table, fits = grid_fits(spark, sf)
    return on_training_rows(spark, sf, table, fits, lambda f, p, seen: {
        "n_train": F.count(F.when(seen, 1)), "mean_probability": F.round(F.avg(F.when(seen, p)), 5)})


@query("grid_optimality", sql("index_bars", *GRID_STEPS, """SELECT fold, penalty, c, n_train, round(n_train * share, 3) AS up_rows, CAST(0 AS DOUBLE) AS intercept_gradient, CAST(6 AS BIGINT) AS optimal_columns FROM s, p, c"""))
def grid_optimality(spark, sf):
    """Gradients of the returned fits, summed anew over the training rows by column expressions."""
    table, fits = grid_fits(spark, sf)

    def sums(f, p, seen):
        off = F.when(seen, p - F.col("movement"))
        good = []
        for i, c in enumerate(windows.BASE_FEATURES):
            g = f.c * F.sum(off * (F.col(c).cast("double") - f.mean[i]) / f.std[i])
            w = f.coef[i]
            if f.penalty == "l2":
                good.append(F.abs(g + w) < 1e-4)
            else:
                good.append(F.abs(g + (1.0 if w > 0 else -1.0)) < 1e-4 if w else F.abs(g) < 1.0001)
        return {"n_train": F.count(F.when(seen, 1)), "up_rows": F.round(F.sum(F.when(seen, F.col("movement"))).cast("double"), 3),
                "intercept_gradient": F.abs(F.round(F.sum(off), 3)), "optimal_columns": sum((x.cast("bigint") for x in good), F.lit(0).cast("bigint"))}

    return on_training_rows(spark, sf, table, fits, sums)


@query("grid_scores")
def grid_scores(spark, sf):
    """F1 of each penalty and strength on each inner fold."""
    table = durable(scaling.scale(baseline.feature_table(views.index_bars(spark, sf), k=3), windows.BASE_FEATURES))
    _, scores = models.grid_search(table, windows.BASE_FEATURES, "movement", "row_id")
    return rounded(scores, "f1")


@query("tuned_report")
def tuned_report(spark, sf):
    return rounded(baseline.evaluate_tuned(views.index_bars(spark, sf)), *ROUND)


SIZE = len(windows.BASE_FEATURES)
ESTIMATORS = {"boosted_trees": lambda n: models.boosted_trees(), "network": lambda n: models.network(SIZE),
              "deep_network": lambda n: models.network(SIZE, models.DEEP_HIDDEN, 100)}


def estimator_folds(kind: str, balanced: bool = False):
    """Five expanding folds of one estimator, on plain or undersampled training rows."""
    def run(spark, sf):
        return rounded(baseline.evaluate(views.index_bars(spark, sf), balanced=balanced, estimator=ESTIMATORS[kind]), *ROUND)
    return run


# Whatever a classifier predicts, its scored rows are those of the folds, with their labels and returns.
FOLD_ROWS = sql("index_bars", ("g", """SELECT dt, open / lag(close) OVER (ORDER BY dt) - 1 AS gap, 100 * (close / lag(close) OVER (ORDER BY dt) - 1) AS ret,
  row_number() OVER (ORDER BY dt) - 8 AS i FROM index_bars"""), ("r", "SELECT *, count(*) OVER () AS n FROM g WHERE i >= 0"),
  ("f", "SELECT *, CAST(floor((n + 0.0) / 6) AS BIGINT) AS part FROM r"),
  """SELECT CAST(floor((i - (n - 5 * part) + 0.0) / part) AS INT) + 1 AS fold, count(*) AS n_rows,
  CAST(sum(CASE WHEN gap > 0 THEN 1 ELSE 0 END) AS BIGINT) AS up_rows, round(sum(ret), 4) AS hold_return, count(*) AS scored
  FROM f WHERE i >= n - 5 * part GROUP BY 1""")


def estimator_rows(estimator=None, balanced: bool = False):
    """Rows, up rows, return of holding, and rows with a probability, per fold."""
    def run(spark, sf):
        table = baseline.feature_table(views.index_bars(spark, sf))
        resample = models.undersampled("movement", "row_id") if balanced else None
        rows = models.folds_scored(table, windows.BASE_FEATURES, "movement", 5, ["dt", "fold", "ret"], estimator, resample)
        fits = (F.col("y_prob").between(0, 1)) & ((F.col("y_prob") > 0.5).cast("int") == F.col("y_pred"))
        return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y_true").cast("bigint").alias("up_rows"),
                                        F.round(F.sum("ret"), 4).alias("hold_return"), F.count(F.when(fits, 1)).alias("scored"))
    return run


query("logistic_fold_rows", FOLD_ROWS)(estimator_rows())
query("logistic_balanced_fold_rows", FOLD_ROWS)(estimator_rows(balanced=True))
for kind, make in ESTIMATORS.items():
    query(f"{kind}_report")(estimator_folds(kind))
    query(f"{kind}_balanced_report")(estimator_folds(kind, balanced=True))
    query(f"{kind}_fold_rows", FOLD_ROWS)(estimator_rows(make))


@query("ticker_fold_report", sql("bars", ("g", """SELECT ticker, dt, open / lag(close) OVER w - 1 AS gap, 100 * (close / lag(close) OVER w - 1) AS ret,
  row_number() OVER w - 8 AS i FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY dt)"""),
  ("r", "SELECT *, count(*) OVER (PARTITION BY ticker) AS n FROM g WHERE i >= 0"), ("f", "SELECT *, CAST(floor((n + 0.0) / 6) AS BIGINT) AS part FROM r"),
  """SELECT ticker, CAST(floor((i - (n - 5 * part) + 0.0) / part) AS INT) + 1 AS fold, count(*) AS n_rows,
  CAST(sum(CASE WHEN gap > 0 THEN 1 ELSE 0 END) AS BIGINT) AS up_rows, round(sum(ret), 4) AS hold_return, count(*) AS scored
  FROM f WHERE i >= n - 5 * part GROUP BY 1, 2"""))
def ticker_fold_report(spark, sf):
    """Rows, up rows, return of holding, and the total of the confusion counts, per ticker and fold."""
    rows = baseline.each_scored(views.bars(spark, sf), views.TICKERS)
    counts = metrics.confusion(rows, ["ticker", "fold"])
    kept = rows.groupBy("ticker", "fold").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("y_true").cast("bigint").alias("up_rows"),
                                              F.round(F.sum("ret"), 4).alias("hold_return"))
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    return kept.join(counts, ["ticker", "fold"]).select("ticker", "fold", "n_rows", "up_rows", "hold_return", total.alias("scored"))


@query("tuned_sentiment_report")
def tuned_sentiment_report(spark, sf):
    return rounded(baseline.evaluate_tuned(views.index_bars(spark, sf), scored_news(spark, sf)), *ROUND)


def market_rows(spark, sf, fusion=False):
    emb = views.news_vectors(spark, sf)
    return multimodal.market_rows(articles(spark, sf), emb, 64, fusion)


@query("multimodal_report")
def multimodal_report(spark, sf):
    return rounded(multimodal.evaluate(*market_rows(spark, sf)), *ROUND)


@query("multimodal_fused_report")
def multimodal_fused_report(spark, sf):
    return rounded(multimodal.evaluate(*market_rows(spark, sf, fusion=True), split="time"), *ROUND)


@query("multimodal_garch_report")
def multimodal_garch_report(spark, sf):
    """Market vectors with five volatility features more."""
    rows = multimodal.article_table(views.index_bars(spark, sf), views.news(spark, sf), scored_news(spark, sf), garch_too=True)
    rows = multimodal.market_rows(rows, views.news_vectors(spark, sf), 64, numbers=multimodal.NUMBERS_WITH_GARCH)
    return rounded(multimodal.evaluate(*rows, split="time"), *ROUND)


@query("multimodal_random_report")
def multimodal_random_report(spark, sf):
    return rounded(multimodal.evaluate(*market_rows(spark, sf), split="random"), *ROUND)


@query("garch_bars")
def garch_bars(spark, sf):
    return multimodal.garch_bars(views.index_bars(spark, sf))

