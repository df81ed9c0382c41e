"""Bars, articles and prediction logs derived from the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tickerloom.functions.numbers import hash_order, ratio
from tickerloom.operators.ordering import row_index
from tickerloom.operators.windows import gap_return, pct_change, rolling_std
from tickerloom.session import spread

# First date of the derived news calendar and its spacing in days.
NEWS_START = "1995-01-01"
NEWS_DATES, NEWS_STEP = 400, 6
TICKERS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and whole texts, spread over the cores for text work."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def roll_up_trades(trades: DataFrame, keys: Sequence, price: str, seq: str) -> DataFrame:
    """Open, close, high and volume per key; all aggregates combine before the shuffle."""
    return trades.groupBy(*keys).agg(
        F.min_by(price, seq).alias("open"), F.max_by(price, seq).alias("close"),
        F.max(price).alias("high"), F.count(F.lit(1)).alias("volume"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("o_orderpriority").alias("ticker"), F.col("o_orderdate").cast("date").alias("dt")]
    return roll_up_trades(table(spark, sf_dir, "orders"), keys, "o_totalprice", "o_orderkey")


def many_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of 200 series."""
    series = F.concat(F.lit("T"), (F.col("o_custkey") % 200).cast("string")).alias("ticker")
    keys = [series, F.col("o_orderdate").cast("date").alias("dt")]
    return roll_up_trades(table(spark, sf_dir, "orders"), keys, "o_totalprice", "o_orderkey")


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.col("o_orderdate").cast("date").alias("dt")]
    return roll_up_trades(table(spark, sf_dir, "orders"), keys, "o_totalprice", "o_orderkey")


def news_date(doc_id: str):
    return F.date_add(F.lit(NEWS_START).cast("date"), ((F.col(doc_id) % NEWS_DATES) * NEWS_STEP).cast("int"))


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tickers = F.array(*[F.lit(t) for t in TICKERS])
    headline = F.regexp_extract("text", r"^[^.!?\n]*", 0)
    return docs.select(
        F.col("doc_id").alias("news_id"), news_date("doc_id").alias("dt"),
        F.get(tickers, (F.col("doc_id") % 5).cast("int")).alias("ticker"),
        headline.alias("title"), F.col("source").alias("tag"), F.col("text").alias("content"))


def news_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector per article, taken in turn from all rows of the embeddings table."""
    vectors = table(spark, sf_dir, "embeddings")
    ids = table(spark, sf_dir, "documents").select("doc_id")
    size = vectors.agg(F.count(F.lit(1))).scalar()
    keyed = ids.withColumn("_size", size).withColumn("vec_id", F.pmod("doc_id", "_size"))
    return (keyed.join(vectors.select("vec_id", "embedding"), "vec_id")
            .select(F.col("doc_id").alias("news_id"), news_date("doc_id").alias("dt"),
                    F.col("embedding").alias("emb")))


def news_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = news_vectors(spark, sf_dir)
    powers = v.select("news_id", "dt", *[
        F.exp(10.0 * F.get("emb", F.lit(i)).cast("double")).alias(n) for i, n in enumerate("abc")])
    total = F.col("a") + F.col("b") + F.col("c")
    return powers.select("news_id", "dt", (F.col("a") / total).alias("neg"), (F.col("b") / total).alias("neu"),
                         (F.col("c") / total).alias("pos"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    kind = (F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral"))
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("id"), F.col("text").alias("sentence"),
                                              kind.alias("sentiment"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = index_bars(spark, sf_dir).withColumns({"_gap": gap_return([], ["dt"]), "ret": 100 * pct_change("close", [], ["dt"])})
    s = row_index(s, "dt").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    size = F.floor(F.col("n") / F.lit(6.0)).cast("bigint")
    first = F.col("n") - 5 * size
    score = F.floor(hash_order("row_id") * 100 / F.lit(2147483647.0)).cast("int")
    return s.select(
        "row_id", "dt",
        F.when(F.col("row_id") >= first, F.floor(ratio(F.col("row_id") - first, size)).cast("int") + 1).alias("fold"),
        F.coalesce((F.col("_gap") > 0).cast("int"), F.lit(0)).alias("y_true"),
        (score / F.lit(100.0)).alias("y_prob"), (score >= 50).cast("int").alias("y_pred"), "ret")


def raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = (F.when(F.col("doc_id") % 4 == 0, " 3 days ago").when(F.col("doc_id") % 4 == 1, " 2021")
            .when(F.col("doc_id") % 4 == 2, " 2021-05-06T10:00:00.5").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("content"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = F.array(*[F.lit(t) for t in (
        "up", "DOWN ", "I think up", "maybe", "x <<<ANSWER_START>>> down", "</Answer/>: Up today")])
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.get(outputs, (F.col("doc_id") % 6).cast("int")).alias("output"))


def fold_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = predictions(spark, sf_dir)
    return p.select("fold", "dt", rolling_std("ret", 21, [], ["dt"]).alias("rolling_volatility"))


# The same views as SQL text, for checking results with another engine.
VIEW_SQL = {
    "bars": """SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS dt,
       min_by(o_totalprice, o_orderkey) AS open, max_by(o_totalprice, o_orderkey) AS close,
       max(o_totalprice) AS high, count(*) AS volume FROM orders GROUP BY 1, 2""",
    "many_bars": """SELECT concat('T', CAST(o_custkey % 200 AS VARCHAR)) AS ticker, CAST(o_orderdate AS DATE) AS dt,
       min_by(o_totalprice, o_orderkey) AS open, max_by(o_totalprice, o_orderkey) AS close,
       max(o_totalprice) AS high, count(*) AS volume FROM orders GROUP BY 1, 2""",
    "index_bars": """SELECT CAST(o_orderdate AS DATE) AS dt,
       min_by(o_totalprice, o_orderkey) AS open, max_by(o_totalprice, o_orderkey) AS close,
       max(o_totalprice) AS high, count(*) AS volume FROM orders GROUP BY 1""",
    "news": """SELECT doc_id AS news_id, CAST(DATE '1995-01-01' + CAST((doc_id % 400) * 6 AS INT) AS DATE) AS dt,
       CASE doc_id % 5 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM'
            WHEN 3 THEN '4-NOT SPECIFIED' ELSE '5-LOW' END AS ticker,
       regexp_extract(text, '^[^.!?\\n]*') AS title, source AS tag, text AS content FROM documents""",
    "news_vectors": """SELECT d.doc_id AS news_id, CAST(DATE '1995-01-01' + CAST((d.doc_id % 400) * 6 AS INT) AS DATE) AS dt,
       e.embedding AS emb FROM documents d JOIN embeddings e
       ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)""",
    "news_scores": """SELECT news_id, dt, a/(a+b+c) AS neg, b/(a+b+c) AS neu, c/(a+b+c) AS pos FROM (
       SELECT news_id, dt, exp(10.0::DOUBLE * CAST(emb[1] AS DOUBLE)) AS a, exp(10.0::DOUBLE * CAST(emb[2] AS DOUBLE)) AS b,
              exp(10.0::DOUBLE * CAST(emb[3] AS DOUBLE)) AS c FROM news_vectors)""",
    "phrases": """SELECT d.doc_id AS id, d.text AS sentence,
       CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'neutral' END AS sentiment
       FROM documents d JOIN labels l ON l.doc_id = d.doc_id""",
    "predictions": """SELECT i AS row_id, dt,
       CASE WHEN i >= n - 5 * sz THEN CAST(floor((i - (n - 5 * sz) + 0.0) / sz) AS INT) + 1 END AS fold,
       y_true, sc / CAST(100 AS DOUBLE) AS y_prob, CASE WHEN sc >= 50 THEN 1 ELSE 0 END AS y_pred, ret
       FROM (SELECT s.*, n, CAST(floor((n + 0.0) / 6) AS BIGINT) AS sz,
              CAST(floor(((CAST(i + 1 AS BIGINT) * 48271 * 69621) % 2147483647) * 100 / 2147483647.0) AS INT) AS sc
       FROM (SELECT dt, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS n,
              CASE WHEN open / lag(close) OVER (ORDER BY dt) - 1 > 0 THEN 1 ELSE 0 END AS y_true,
              100.0 * (close / lag(close) OVER (ORDER BY dt) - 1) AS ret FROM index_bars) s)""",
    "raw_text": """SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' 3 days ago' WHEN 1 THEN ' 2021'
       WHEN 2 THEN ' 2021-05-06T10:00:00.5' ELSE '' END) AS content FROM documents""",
    "answers": """SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'up' WHEN 1 THEN 'DOWN ' WHEN 2 THEN 'I think up'
       WHEN 3 THEN 'maybe' WHEN 4 THEN 'x <<<ANSWER_START>>> down' ELSE '</Answer/>: Up today' END AS output FROM documents""",
    "fold_volatility": """SELECT fold, dt, CASE WHEN count(ret) OVER w = 21 THEN stddev_samp(ret) OVER w END AS rolling_volatility
       FROM predictions WINDOW w AS (ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)""",
}
VIEW_NEEDS = {"news_scores": ["news_vectors"], "predictions": ["index_bars"],
              "fold_volatility": ["index_bars", "predictions"]}


def sql(views: str, *steps: tuple[str, str] | str) -> str:
    """A query over the named views. All steps but the last are (name, select) pairs."""
    names: list[str] = []
    for view in views.split():
        names += [v for v in VIEW_NEEDS.get(view, []) + [view] if v not in names]
    parts = [f"{v} AS ({VIEW_SQL[v]})" for v in names]
    parts += [f"{n} ({body})" if " AS " in n else f"{n} AS ({body})" for n, body in steps[:-1]]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + steps[-1]
