"""Market vectors are made and fitted once for all articles of a date, and prompts reach a client in bounded batches."""

import datetime as dt

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tickerloom.operators import folds, models, vectors
from tickerloom.plans import multimodal

DAYS, A_DAY = 24, 7


@pytest.fixture(scope="module")
def rows(spark):
    data = [(dt.date(2020, 1, 1) + dt.timedelta(d), A_DAY * d + i, "t", "text", (d * 7 + d // 5) % 3 % 2, float(d % 5) - 2, float(d * d % 11))
            for d in range(DAYS) for i in range(1 + d % A_DAY)]
    return spark.createDataFrame(data, "dt date, news_id bigint, title string, cleaned_content string, movement int, daily_return double, a double")


@pytest.mark.parametrize("fusion", [False, True])
def test_one_vector_for_each_date(spark, rows, fusion):
    emb = rows.select("dt", "news_id", F.array(F.sin("news_id"), F.cos("news_id")).cast("array<float>").alias("emb"))
    table, found = multimodal.market_rows(rows, emb, 2, fusion, numbers=["a"])
    assert found.count() == DAYS and "market_vector" not in table.columns and table.count() == rows.count()
    (joined,) = table.join(found, "vector_id").where("dt = '2020-01-03'").select("market_vector").distinct().collect()
    if not fusion:
        a = [r["a"] for r in rows.collect()]
        mean = sum(a) / len(a)
        std = (sum((x - mean) ** 2 for x in a) / len(a)) ** 0.5
        earlier = emb.where("dt = '2020-01-02'").select(F.avg(F.col("emb")[0]), F.avg(F.col("emb")[1])).first()
        assert joined[0] == pytest.approx([(4 - mean) / std, *earlier])


def test_weighted_fits_equal_fits_on_all_rows(spark, rows):
    table = folds.time_series_folds(rows.withColumn("ret", F.col("daily_return")), 2, "dt", "news_id")
    table = table.withColumn("vector_id", F.datediff("dt", F.lit("2020-01-01")).cast("bigint")).cache()
    kinds = table.select("vector_id", F.array("a", "daily_return").alias("v")).distinct()
    got = models.vector_folds_scored(table, kinds, "v", "movement", 2, ["dt", "news_id", "fold", "ret"])
    assert got.columns == ["dt", "news_id", "fold", "ret", "y_true", "y_prob", "y_pred"]
    have = {r["news_id"]: r for r in got.collect()}
    ready = table.withColumn("features", array_to_vector(F.array("a", "daily_return")))
    for f in (1, 2):
        train = folds.train_rows(ready, f)
        want = models.scored(models.logistic(train.count()).fit(train), folds.test_rows(ready, f), "movement", ["news_id"]).collect()
        for w in want:
            g = have.pop(w["news_id"])
            assert (g["y_true"], g["y_pred"]) == (w["y_true"], w["y_pred"]) and g["y_prob"] == pytest.approx(w["y_prob"], abs=1e-4)
    assert not have


def test_large_prompts_come_in_small_batches(spark):
    def client():
        return lambda texts: [str(len(texts)) for _ in texts]

    texts = spark.range(12).repartition(1).select(F.repeat(F.lit("x"), 3 << 20).alias("prompt"))
    sizes = [int(r["output"]) for r in vectors.score_prompts(texts, "prompt", client).select("output").collect()]
    assert len(sizes) == 12 and max(sizes) <= 3
