"""Series, distributions, summaries, rankings."""

from __future__ import annotations

from posttide import testviews as v
from posttide.checks.shape import finish
from posttide.operators import ranking, series, summary

_SERIES_RUN = 2

T_TWEETS = """
t_tweets AS (
  SELECT CAST(event_id AS VARCHAR) AS tweet_id,
         'user_' || CAST(user_id AS VARCHAR) AS username,
         'User ' || CAST(user_id % 20 AS VARCHAR) AS display_name,
         date_trunc('second', ts) AS created_at,
         event_type || ' ' || props AS content,
         'https://x.com/user_' || CAST(user_id AS VARCHAR) AS url,
         lower(event_type) AS cleaned_text,
         CASE WHEN event_type IN ('purchase','signup') THEN 'positive'
              WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment_label,
         CASE WHEN event_type IN ('purchase','signup') THEN value / 500.0
              WHEN event_type = 'error' THEN -value / 500.0 ELSE 0.0 END AS sentiment_score,
         0.5 + value / 1000.0 AS sentiment_confidence,
         CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS like_count,
         CAST(event_id % 7 AS BIGINT) AS retweet_count
  FROM events)"""

T_LINKS = """
t_links AS (
  SELECT CAST(1 AS BIGINT) AS run_id, CAST(event_id AS VARCHAR) AS tweet_id,
         date_trunc('second', ts) AS ingested_at FROM events
  UNION ALL
  SELECT 2, CAST(event_id AS VARCHAR), date_trunc('second', ts) FROM events
  WHERE event_type = 'purchase'
  UNION ALL
  SELECT 3, CAST(event_id AS VARCHAR), date_trunc('second', ts) FROM events
  WHERE event_type IN ('purchase', 'view', 'click'))"""

_POSTS = f"""WITH {T_TWEETS}, {T_LINKS},
posts AS (SELECT l.run_id, t.* FROM t_tweets t JOIN t_links l ON l.tweet_id = t.tweet_id)"""


def _trend(granularity: str, run_id: int | None):
    def query(spark, sf_dir):
        return finish(
            series.trend(v.tweets(spark, sf_dir), v.links(spark, sf_dir), granularity, run_id)
        )

    return query


def _trend_sql(unit: str, where: str) -> str:
    return f"""{_POSTS},
    s AS (
      SELECT run_id, date_trunc('{unit}', created_at) AS period, count(*) AS total_tweets,
             avg(sentiment_score) AS average_sentiment,
             count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_count,
             count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_count,
             count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_count
      FROM posts {where} GROUP BY 1, 2),
    spans AS (SELECT run_id, min(period) AS lo, max(period) AS hi FROM s GROUP BY 1),
    cal AS (SELECT run_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 {unit})) AS TIMESTAMP) AS period
            FROM spans),
    f AS (
      SELECT c.run_id, c.period, coalesce(s.total_tweets, 0) AS total_tweets,
             coalesce(s.average_sentiment, 0.0) AS average_sentiment,
             coalesce(s.positive_count, 0) AS positive_count,
             coalesce(s.negative_count, 0) AS negative_count,
             coalesce(s.neutral_count, 0) AS neutral_count
      FROM cal c LEFT JOIN s ON s.run_id = c.run_id AND s.period = c.period)
    SELECT run_id, CAST(period AS TIMESTAMP) AS period, total_tweets,
           round(average_sentiment, 12) AS average_sentiment,
           positive_count, negative_count, neutral_count,
           round(avg(average_sentiment) OVER (PARTITION BY run_id ORDER BY period
                 ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 12) AS rolling_average
    FROM f"""


def _bare_series(spark, sf_dir):
    return finish(
        series.sentiment_series(v.tweets(spark, sf_dir), v.links(spark, sf_dir), "hourly")
    )


def _distribution(spark, sf_dir):
    counts = summary.sentiment_distribution(v.tweets(spark, sf_dir), v.links(spark, sf_dir))
    return finish(summary.distribution_frame(counts))


def _summary_all(spark, sf_dir):
    return finish(summary.run_summary(v.tweets(spark, sf_dir), v.links(spark, sf_dir)))


def _summary_one(run_id: int):
    def query(spark, sf_dir):
        return finish(
            summary.run_summary(v.tweets(spark, sf_dir), v.links(spark, sf_dir), run_id)
        )

    return query


def _summary_base(spark, sf_dir):
    return finish(
        summary.summary_stats(v.tweets(spark, sf_dir), v.links(spark, sf_dir), _SERIES_RUN)
    )


def _sources_one(spark, sf_dir):
    top = ranking.source_breakdown(v.tweets(spark, sf_dir), v.links(spark, sf_dir), 1, 15)
    return finish(ranking.source_breakdown_frame(top))


def _sources_all(spark, sf_dir):
    return finish(ranking.source_breakdown(v.tweets(spark, sf_dir), v.links(spark, sf_dir)))


def _chart_feed(spark, sf_dir):
    top = ranking.source_breakdown(v.tweets(spark, sf_dir), v.links(spark, sf_dir), 1, 20)
    return finish(ranking.source_chart_feed(top))


def _recent_one(spark, sf_dir):
    return finish(
        ranking.recent_posts(v.tweets(spark, sf_dir), v.links(spark, sf_dir), _SERIES_RUN)
    )


def _recent_all(spark, sf_dir):
    return finish(ranking.recent_posts(v.tweets(spark, sf_dir), v.links(spark, sf_dir)))


_SUMMARY_COLUMNS = """count(*) AS total_tweets,
       round(coalesce(avg(sentiment_score), 0.0), 12) AS average_sentiment,
       round(coalesce(avg(sentiment_confidence), 0.0), 12) AS average_confidence,
       min(created_at) AS earliest_tweet, max(created_at) AS latest_tweet,
       round(coalesce(100.0 * count(*) FILTER (WHERE sentiment_label = 'positive')
             / nullif(count(*), 0), 0.0), 12) AS positive_percentage,
       round(coalesce(100.0 * count(*) FILTER (WHERE sentiment_label = 'negative')
             / nullif(count(*), 0), 0.0), 12) AS negative_percentage,
       round(coalesce(100.0 * count(*) FILTER (WHERE sentiment_label = 'neutral')
             / nullif(count(*), 0), 0.0), 12) AS neutral_percentage"""

_DOMINANT = """best AS (
  SELECT run_id, sentiment_label AS dominant_sentiment,
         row_number() OVER (PARTITION BY run_id ORDER BY count(*) DESC, sentiment_label) AS rn
  FROM posts GROUP BY run_id, sentiment_label)"""


def _summary_one_sql(run_id: int) -> str:
    return f"""{_POSTS}, {_DOMINANT}
    SELECT {_SUMMARY_COLUMNS},
           coalesce((SELECT dominant_sentiment FROM best WHERE rn = 1 AND run_id = {run_id}),
                    'neutral') AS dominant_sentiment
    FROM posts WHERE run_id = {run_id}"""


_SOURCES = """sources AS (
  SELECT run_id, display_name, username, count(*) AS tweet_count,
         avg(sentiment_score) AS average_sentiment,
         avg(sentiment_confidence) AS average_confidence,
         avg(like_count + retweet_count) AS average_engagement,
         min(created_at) AS first_seen, max(created_at) AS last_seen
  FROM posts GROUP BY run_id, display_name, username),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id
  ORDER BY tweet_count DESC, average_sentiment DESC, display_name, username) AS rn FROM sources)"""

_SOURCE_COLUMNS = """run_id, display_name, username, tweet_count,
  round(average_sentiment, 12) AS average_sentiment,
  round(average_confidence, 12) AS average_confidence,
  round(average_engagement, 12) AS average_engagement, first_seen, last_seen"""

_RECENT_COLUMNS = """run_id, tweet_id, created_at, username, display_name, content, url,
  cleaned_text, sentiment_label, round(sentiment_score, 12) AS sentiment_score,
  round(sentiment_confidence, 12) AS sentiment_confidence, like_count, retweet_count"""

_RECENT = """SELECT *, row_number() OVER (PARTITION BY run_id
  ORDER BY created_at DESC, tweet_id) AS rn FROM posts"""


def sources_sql(run_id: int, limit: int) -> str:
    return f"""{_POSTS}, {_SOURCES}
      SELECT {_SOURCE_COLUMNS} FROM ranked WHERE run_id = {run_id} AND rn <= {limit}"""


def recent_sql(run_id: int, limit: int) -> str:
    return f"""{_POSTS}, r AS ({_RECENT})
      SELECT {_RECENT_COLUMNS} FROM r WHERE run_id = {run_id} AND rn <= {limit}"""


def late_rows_sql() -> str:
    """The hourly series without posts whose hour the first part's watermark had closed."""
    first = "created_at < TIMESTAMP '2024-01-21' AND CAST(tweet_id AS BIGINT) % 4 <> 0"
    return _trend_sql("hour", f"""WHERE run_id = 1 AND (({first})
      OR date_trunc('hour', created_at) + INTERVAL 1 HOUR
         > (SELECT max(created_at) - INTERVAL 1 HOUR FROM t_tweets WHERE {first}))""")


QUERIES = {
    "ts_hourly_gapfill_rolling": _trend("hourly", _SERIES_RUN),
    "ts_hourly_all_runs": _trend("hourly", None),
    "ts_daily_all_runs": _trend("daily", None),
    "ts_hourly_buckets": _bare_series,
    "sentiment_distribution": _distribution,
    "summary_stats": _summary_all,
    "summary_stats_one_run": _summary_one(_SERIES_RUN),
    "summary_stats_empty_run": _summary_one(99),
    "summary_base_row": _summary_base,
    "source_breakdown_topk": _sources_one,
    "source_breakdown_all_runs": _sources_all,
    "source_chart_feed": _chart_feed,
    "recent_tweets": _recent_one,
    "recent_tweets_all_runs": _recent_all,
}

SQL = {
    "ts_hourly_gapfill_rolling": _trend_sql("hour", f"WHERE run_id = {_SERIES_RUN}"),
    "ts_hourly_all_runs": _trend_sql("hour", ""),
    "ts_daily_all_runs": _trend_sql("day", ""),
    "ts_hourly_buckets": f"""{_POSTS}
      SELECT run_id, date_trunc('hour', created_at) AS period, count(*) AS total_tweets,
             round(avg(sentiment_score), 12) AS average_sentiment,
             count(*) FILTER (WHERE sentiment_label = 'positive') AS positive_count,
             count(*) FILTER (WHERE sentiment_label = 'negative') AS negative_count,
             count(*) FILTER (WHERE sentiment_label = 'neutral') AS neutral_count
      FROM posts GROUP BY 1, 2""",
    "sentiment_distribution": f"""{_POSTS},
      d AS (SELECT run_id, sentiment_label AS label, count(*) AS count FROM posts GROUP BY 1, 2)
      SELECT run_id, label, count,
             round(100.0 * count / sum(count) OVER (PARTITION BY run_id), 12) AS percentage
      FROM d""",
    "summary_stats": f"""{_POSTS}, {_DOMINANT},
      s AS (SELECT run_id, {_SUMMARY_COLUMNS} FROM posts GROUP BY run_id)
      SELECT s.*, b.dominant_sentiment FROM s JOIN best b ON b.run_id = s.run_id AND b.rn = 1""",
    "summary_stats_one_run": _summary_one_sql(_SERIES_RUN),
    "summary_stats_empty_run": _summary_one_sql(99),
    "summary_base_row": f"""{_POSTS}
      SELECT count(*) AS total_tweets, round(avg(sentiment_score), 12) AS average_sentiment,
             round(avg(sentiment_confidence), 12) AS average_confidence,
             min(created_at) AS earliest_tweet, max(created_at) AS latest_tweet
      FROM posts WHERE run_id = {_SERIES_RUN}""",
    "source_breakdown_topk": sources_sql(1, 15),
    "source_breakdown_all_runs": f"""{_POSTS}, {_SOURCES}
      SELECT {_SOURCE_COLUMNS} FROM ranked WHERE rn <= 15""",
    "source_chart_feed": f"""{_POSTS}, {_SOURCES}
      SELECT {_SOURCE_COLUMNS}, coalesce(nullif(display_name, ''), username) AS source_label
      FROM ranked WHERE run_id = 1 AND rn <= 10""",
    "recent_tweets": recent_sql(_SERIES_RUN, 100),
    "recent_tweets_all_runs": f"""{_POSTS}, r AS ({_RECENT})
      SELECT {_RECENT_COLUMNS} FROM r WHERE rn <= 100""",
}
