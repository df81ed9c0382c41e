"""Queries over articles: text cleaning, joins with bars, roll-ups, word counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickerloom.catalog.bars import BY, LEVEL_STEPS, ORDER, rounded
from tickerloom.catalog.registry import query
from tickerloom.functions import dates, text
from tickerloom.functions.sentiment import label_code, score_text, sentiment_score
from tickerloom.operators import columns, joins, profile, rollup, windows
from tickerloom.plans import views
from tickerloom.plans.views import sql
from tickerloom.session import spread

STOPS_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in text.ENGLISH_STOP_WORDS)
WORDS_SQL = "unnest(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'))"
CLEAN_SQL = ("trim(regexp_replace(regexp_replace(regexp_replace({c}, '<[^>\\n]*>', '', 'g'), '[^\\x00-\\x7F]+', ' ', 'g'), "
             "'[ \\t\\n\\r\\x0B\\f\\x1C-\\x1F]+', ' ', 'g'))")
SCORE_SQL = "CASE WHEN abs((pos - neg) * (1 - neu)) < 0.005 THEN 0.0 ELSE round((pos - neg) * (1 - neu), 2) END"
SCORED = ("scored", f"SELECT news_id, dt, {SCORE_SQL} AS sentiment_score FROM news_scores")


def scored_news(spark, sf):
    s = views.news_scores(spark, sf)
    return s.select("news_id", "dt", sentiment_score("neg", "neu", "pos").alias("sentiment_score"))


@query("sentiment_score", sql("news_scores", f"SELECT news_id, dt, {SCORE_SQL} AS sentiment_score, "
                              f"printf('%.2f', {SCORE_SQL}) AS stored FROM news_scores"))
def sentiment_score_query(spark, sf):
    return scored_news(spark, sf).withColumn("stored", score_text("sentiment_score"))


@query("daily_sentiment", sql("news_scores", SCORED, """SELECT dt, round(sum(sentiment_score), 2) AS aggregate_sentiment_score
  FROM scored GROUP BY dt"""))
def daily_sentiment(spark, sf):
    return rollup.daily_sentiment(scored_news(spark, sf), digits=2)


@query("attach_daily_sentiment", sql("news_scores", SCORED, """SELECT news_id, dt,
  round(sum(sentiment_score) OVER (PARTITION BY dt), 2) AS aggregate_sentiment_score FROM scored"""))
def attach_daily_sentiment(spark, sf):
    scores = scored_news(spark, sf)
    out = joins.attach_aggregate(scores.select("news_id", "dt"), rollup.daily_sentiment(scores, digits=2))
    return out.select("news_id", "dt", "aggregate_sentiment_score")


@query("bars_with_sentiment", sql("index_bars news_scores", SCORED, ("a", """SELECT dt, sum(sentiment_score) AS s
  FROM scored GROUP BY dt"""), """SELECT dt, open, close, high, volume, round(s, 6) AS aggregate_sentiment_score
  FROM index_bars JOIN a USING (dt)"""))
def bars_with_sentiment(spark, sf):
    df = joins.join_pre_aggregated(views.index_bars(spark, sf), scored_news(spark, sf))
    return rounded(df, "aggregate_sentiment_score")


@query("join_on_date", sql("index_bars news", """SELECT dt, news_id, ticker, title, open, close
  FROM index_bars JOIN news USING (dt)"""))
def join_on_date(spark, sf):
    df = joins.join_on_date(views.index_bars(spark, sf), views.news(spark, sf))
    return df.select("dt", "news_id", "ticker", "title", "open", "close")


@query("join_on_ticker_date", sql("bars news", "SELECT ticker, dt, news_id, open, close FROM bars JOIN news USING (ticker, dt)"))
def join_on_ticker_date(spark, sf):
    df = joins.join_on_date(views.bars(spark, sf), views.news(spark, sf), ["ticker", "dt"])
    return df.select("ticker", "dt", "news_id", "open", "close")


@query("attach_return", sql("index_bars news", """SELECT news_id, dt, daily_return FROM news JOIN
  (SELECT dt, round((close / lag(close) OVER (ORDER BY dt) - 1) * 100, 4) AS daily_return FROM index_bars) USING (dt)"""))
def attach_return(spark, sf):
    b = views.index_bars(spark, sf)
    b = b.withColumn("daily_return", F.round(windows.pct_change("close", [], ORDER) * 100, 4))
    return joins.attach_return(views.news(spark, sf).select("news_id", "dt"), b).select("news_id", "dt", "daily_return")


@query("offset_join", sql("index_bars news", """SELECT n.news_id, b.dt, b.open FROM news n JOIN index_bars b
  ON b.dt = CAST(n.dt + INTERVAL 1 DAY AS DATE)"""))
def offset_join(spark, sf):
    return joins.offset_join(views.news(spark, sf), views.index_bars(spark, sf)).select("news_id", "dt", "open")


@query("asof_prev_news", sql("news", ("d", "SELECT dt, lag(dt) OVER (ORDER BY dt) AS prev_dt FROM (SELECT DISTINCT dt FROM news)"),
       ("t", "SELECT dt AS prev_dt, string_agg(content, ' ' ORDER BY news_id) AS prev_day_news FROM news GROUP BY dt"),
       """SELECT d.dt, d.prev_dt, coalesce(prev_day_news, 'No previous news available') AS prev_day_news
  FROM d LEFT JOIN t USING (prev_dt)"""))
def asof_prev_news(spark, sf):
    return joins.asof_prev_text(views.news(spark, sf), "content", "news_id")


@query("asof_prev_articles", sql("index_bars news", ("n", "SELECT DISTINCT dt FROM news"),
       """SELECT b.dt, n2.dt AS prev_dt, n2.news_id FROM
  (SELECT x.dt, max(n.dt) AS prev_dt FROM (SELECT dt FROM n) x JOIN n ON n.dt < x.dt GROUP BY x.dt) b
  JOIN news n2 ON n2.dt = b.prev_dt"""))
def asof_prev_articles(spark, sf):
    articles = views.news(spark, sf).select("dt", "news_id")
    return joins.asof_prev_rows(articles, articles).select("dt", "prev_dt", "news_id")


@query("daily_rollup", sql("index_bars news news_scores", SCORED, """SELECT dt, min_by(open, news_id) AS open,
  min_by(close, news_id) AS close, min_by(high, news_id) AS high, CAST(sum(volume) AS BIGINT) AS volume,
  string_agg(title, ', ' ORDER BY news_id) AS title, string_agg(tag, ', ' ORDER BY news_id) AS tag,
  string_agg(content, ', ' ORDER BY news_id) AS content FROM index_bars JOIN news USING (dt) GROUP BY dt"""))
def daily_rollup(spark, sf):
    df = joins.join_on_date(views.index_bars(spark, sf), views.news(spark, sf))
    return rollup.daily_rollup(df, "news_id").select("dt", "open", "close", "high", "volume", "title", "tag", "content")


@query("panel_mean", sql("bars", """SELECT dt, round(avg((close - open) / open) * 100, 6) AS intraday_return FROM bars GROUP BY dt"""))
def panel_mean(spark, sf):
    df = windows.daily_returns(views.bars(spark, sf), BY, ORDER)
    return rounded(rollup.panel_mean(df, "intraday_return"), "intraday_return")


@query("dedupe_articles", sql("news", """SELECT news_id, dt, ticker, title, tag, content FROM
  (SELECT *, row_number() OVER (PARTITION BY title, content ORDER BY news_id) AS r FROM news) WHERE r = 1"""))
def dedupe_articles(spark, sf):
    return rollup.dedupe_articles(views.news(spark, sf), ["title", "content"], "news_id")


@query("distinct_rows", sql("news", "SELECT DISTINCT ticker, tag, content FROM news"))
def distinct_rows(spark, sf):
    return rollup.distinct_rows(views.news(spark, sf).select("ticker", "tag", "content"))


@query("distinct_dates", sql("news", "SELECT DISTINCT dt FROM news"))
def distinct_dates(spark, sf):
    return rollup.distinct_dates(views.news(spark, sf))


@query("value_counts", sql("news", "SELECT ticker, count(*) AS n FROM news GROUP BY ticker"))
def value_counts(spark, sf):
    return profile.value_counts(views.news(spark, sf), ["ticker"])


@query("union_tickers", sql("bars", "SELECT ticker AS stock, dt, close FROM bars"))
def union_tickers(spark, sf):
    """The bars of every ticker, each cut out, named by a constant and united again."""
    b = views.bars(spark, sf)
    return rollup.union_tables([columns.with_constant(columns.filter_ticker(b, t).select("dt", "close"), "stock", t) for t in views.TICKERS])


@query("union_missing_columns", sql("bars news", """SELECT ticker, dt, close, NULL AS tag FROM bars UNION ALL
  SELECT ticker, dt, NULL, tag FROM news"""))
def union_missing_columns(spark, sf):
    b = views.bars(spark, sf).select("ticker", "dt", "close")
    return rollup.union_tables([b, views.news(spark, sf).select("ticker", "dt", "tag")], allow_missing=True)


@query("first_per_date", sql("news", ("s", """SELECT dt, news_id, nullif(regexp_extract(title, '^[^,]*,'), '') AS clause,
  title FROM news"""), """SELECT dt, arg_min(clause, news_id) FILTER (WHERE clause IS NOT NULL) AS clause,
  arg_min(title, news_id) AS title FROM s GROUP BY dt"""))
def first_per_date(spark, sf):
    df = views.news(spark, sf).withColumn("clause", F.nullif(F.regexp_extract("title", "^[^,]*,", 0), F.lit("")))
    return rollup.first_per_date(df, ["dt"], ["clause", "title"], "news_id")


@query("clean_html", f"SELECT page_id, {CLEAN_SQL.format(c='html')} AS cleaned FROM pages")
def clean_html(spark, sf):
    return spread(views.table(spark, sf, "pages").select("page_id", "html")).select("page_id", text.clean_text("html").alias("cleaned"))


@query("clean_text_lower", "SELECT doc_id, " + CLEAN_SQL.format(c="text").replace(
    "'[^\\x00-\\x7F]+', ' ', 'g'), ", "'[^\\x00-\\x7F]+', ' ', 'g').lower(), ") + " AS cleaned FROM documents")
def clean_text_lower(spark, sf):
    return views.documents(spark, sf).select("doc_id", text.clean_text("text", lower=True).alias("cleaned"))


@query("strip_trailing_date", sql("raw_text", f"""SELECT doc_id, regexp_replace(regexp_replace(content,
  '{text.TRAILING_DATE}', ''), '^\\s+|\\s+$', '', 'g') AS content FROM raw_text"""))
def strip_trailing_date(spark, sf):
    return views.raw_text(spark, sf).select("doc_id", text.strip_trailing_date("content").alias("content"))


@query("dedupe_sentences", ("WITH l AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, "
       "'([.!?])[ \\t\\n\\r\\x0B\\f\\x1C-\\x1F]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)) AS parts FROM documents) "
       "SELECT doc_id, array_to_string(list_filter(parts, lambda s, i: list_position(parts, s) = i), ' ') AS content FROM l"))
def dedupe_sentences(spark, sf):
    return views.documents(spark, sf).select("doc_id", text.dedupe_sentences("text").alias("content"))


@query("normalise_text", ("WITH w AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(lower(text), "
       "'[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'), ' ') AS words FROM documents) "
       f"SELECT doc_id, array_to_string(list_filter(words, lambda w: w <> '' AND w NOT IN ({STOPS_SQL})), ' ') AS content FROM w"))
def normalise_text(spark, sf):
    return views.documents(spark, sf).select("doc_id", text.normalise_text("text").alias("content"))


@query("word_counts", f"""WITH w AS (SELECT {WORDS_SQL.format(c='text')} AS word FROM documents)
  SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]+') GROUP BY word""")
def word_counts(spark, sf):
    return profile.word_counts(views.documents(spark, sf), "text")


@query("word_frequency", f"""WITH w AS (SELECT {WORDS_SQL.format(c='text')} AS word FROM documents)
  SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]+') GROUP BY word ORDER BY n DESC, word LIMIT 10""")
def word_frequency(spark, sf):
    return profile.word_frequency(views.documents(spark, sf), "text", 10)


@query("word_frequency_no_stop", f"""WITH w AS (SELECT {WORDS_SQL.format(c='text')} AS word FROM documents)
  SELECT word, count(*) AS n FROM w WHERE regexp_full_match(word, '[a-z]+') AND word NOT IN ({STOPS_SQL})
  GROUP BY word ORDER BY n DESC, word LIMIT 10""")
def word_frequency_no_stop(spark, sf):
    return profile.word_frequency(views.documents(spark, sf), "text", 10, drop_stop_words=True)


@query("high_volatility_words", sql("bars news", *LEVEL_STEPS, ("h", "SELECT ticker, dt FROM l WHERE volatility_level = 'High'"),
       ("w", f"SELECT {WORDS_SQL.format(c='content')} AS word FROM news JOIN h USING (ticker, dt)"), f"""SELECT word, count(*) AS n FROM w
  WHERE regexp_full_match(word, '[a-z]+') AND word NOT IN ({STOPS_SQL}) GROUP BY word ORDER BY n DESC, word LIMIT 10"""))
def high_volatility_words(spark, sf):
    levels = windows.rolling_volatility(views.bars(spark, sf), BY, ORDER)
    days = columns.regime(levels, "High").select("ticker", "dt")
    return profile.word_frequency(views.news(spark, sf).join(days, ["ticker", "dt"]), "content", 10, drop_stop_words=True)


@query("token_length_stats", """SELECT CAST(min(n) AS INT) AS min_tokens, CAST(max(n) AS INT) AS max_tokens,
  round(avg(n), 6) AS mean_tokens FROM (SELECT len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS n FROM documents)""")
def token_length_stats(spark, sf):
    return rounded(profile.token_length_stats(views.documents(spark, sf), "text"), "mean_tokens")


@query("label_codes", sql("phrases", """SELECT id, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1
  WHEN 'positive' THEN 2 END AS label FROM phrases"""))
def label_codes(spark, sf):
    return views.phrases(spark, sf).select("id", label_code("sentiment").alias("label"))


@query("class_weights", sql("phrases", ("c", "SELECT sentiment, count(*) AS n FROM phrases GROUP BY 1"),
       """SELECT sentiment, n, round((SELECT sum(n) FROM c)::DOUBLE / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c"""))
def class_weights(spark, sf):
    return rounded(profile.class_weights(views.phrases(spark, sf), "sentiment"), "weight")


@query("non_empty_text", sql("answers", """SELECT * FROM (SELECT id, regexp_extract(output, '(up|down)', 1) AS word FROM answers)
  WHERE word IS NOT NULL AND word <> ''"""))
def non_empty_text(spark, sf):
    words = views.answers(spark, sf).select("id", F.regexp_extract("output", "(up|down)", 1).alias("word"))
    return columns.non_empty_text(words, "word")


@query("date_parsing", """SELECT event_id, CAST(ts AS DATE) AS iso, CAST(ts AS DATE) AS day_first, CAST(ts AS DATE) AS day_part,
  strftime(ts, '%H:%M:%S') AS time_part, strftime(ts, '%Y-%m-%d') AS day_text, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp,
  CAST(date_trunc('year', ts) AS DATE) AS year_start, CAST(NULL AS DATE) AS bad FROM events""")
def date_parsing(spark, sf):
    e = views.table(spark, sf, "events")
    return e.select(
        "event_id", dates.to_date(F.date_format("ts", "yyyy-MM-dd")).alias("iso"),
        dates.to_date(F.date_format("ts", "dd/MM/yyyy"), day_first=True).alias("day_first"),
        dates.date_part(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("day_part"),
        dates.time_part(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("time_part"),
        dates.iso_day("ts").alias("day_text"), dates.iso_stamp("ts").alias("stamp"),
        dates.year_start("ts").cast("date").alias("year_start"), dates.to_date("event_type").alias("bad"))


@query("next_business_days", sql("index_bars", """SELECT dt, day FROM (SELECT b.dt, CAST(b.dt + to_days(CAST(k AS INT)) AS DATE) AS day,
  row_number() OVER (PARTITION BY b.dt ORDER BY k) AS r FROM index_bars b, range(1, 12) t(k)
  WHERE dayofweek(b.dt + to_days(CAST(k AS INT))) NOT IN (0, 6)) WHERE r <= 5"""))
def next_business_days(spark, sf):
    return views.index_bars(spark, sf).select("dt", F.explode(dates.next_business_days("dt", 5)).alias("day"))


@query("events_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS encoded FROM events""")
def events_json(spark, sf):
    e = views.table(spark, sf, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.select("event_id", "p.k", F.to_json("p").alias("encoded"))


SENTIMENT_STEPS = (
    SCORED, ("a", "SELECT dt, sum(sentiment_score) AS s FROM scored GROUP BY dt"),
    ("m", "SELECT * FROM index_bars JOIN a USING (dt)"),
    ("r", """SELECT *, open / lag(close) OVER w - 1 AS gap, (close / lag(close) OVER w - 1) * 100 AS ret FROM m
  WINDOW w AS (ORDER BY dt)"""),
    ("v", """SELECT *, CASE WHEN count(ret) OVER w = 5 THEN stddev_samp(ret) OVER w END AS vol,
  CASE WHEN count(s) OVER w = 5 THEN stddev_samp(s) OVER w END AS svol FROM r
  WINDOW w AS (ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""),
    ("sf", """SELECT * FROM (SELECT dt, open, ret AS daily_return, row_number() OVER w AS pos,
  CASE WHEN gap > 0 THEN 1 ELSE 0 END AS movement, lag(close) OVER w AS close_lag1, lag(high) OVER w AS high_lag1,
  lag(volume) OVER w AS volume_lag1, lag(ret) OVER w AS daily_return_lag1, lag(vol) OVER w AS volatility_lag1,
  lag(s) OVER w AS aggregate_sentiment_score_lag1, lag(svol) OVER w AS sentiment_volatility_lag1 FROM v
  WINDOW w AS (ORDER BY dt)) WHERE pos > 12"""))
ARTICLE_STEPS = SENTIMENT_STEPS + (
    ("cl", "SELECT dt, news_id, array_to_string(list_filter(parts, lambda s, i: list_position(parts, s) = i), ' ') AS cleaned_content "
     "FROM (SELECT dt, news_id, list_transform(string_split(regexp_replace(" + CLEAN_SQL.format(c="content") +
     ", '([.!?])[ \\t\\n\\r\\x0B\\f\\x1C-\\x1F]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)) AS parts FROM news)"),
    ("ar", "SELECT * FROM sf JOIN cl USING (dt) WHERE cleaned_content <> ''"))


@query("sentiment_baseline_features", sql("index_bars news_scores", *SENTIMENT_STEPS, """SELECT dt, movement, close_lag1, high_lag1,
  volume_lag1, round(daily_return_lag1, 4) AS daily_return_lag1, round(volatility_lag1, 4) AS volatility_lag1,
  round(aggregate_sentiment_score_lag1, 6) AS aggregate_sentiment_score_lag1,
  round(sentiment_volatility_lag1, 6) AS sentiment_volatility_lag1 FROM sf"""))
def sentiment_baseline_features(spark, sf):
    df = joins.join_pre_aggregated(views.index_bars(spark, sf), scored_news(spark, sf))
    df = windows.baseline_features(df, [], ORDER, sentiment=True)
    df = df.select("dt", "movement", "close_lag1", "high_lag1", "volume_lag1", "daily_return_lag1", "volatility_lag1",
                   "aggregate_sentiment_score_lag1", "sentiment_volatility_lag1")
    df = rounded(df, "daily_return_lag1", "volatility_lag1", digits=4)
    return rounded(df, "aggregate_sentiment_score_lag1", "sentiment_volatility_lag1")

