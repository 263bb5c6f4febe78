"""Landed records, search filters, fan-out, fallback."""

from __future__ import annotations

import math
from datetime import date, datetime, timezone

from pyspark.sql import functions as F

from posttide import testviews as v
from posttide.checks.shape import finish
from posttide.checks.text import sql_feed_text, sql_fold
from posttide.operators import search
from posttide.params import SearchParams, source_query_column, tags_column
from posttide.session import working_folder
from posttide.sources import posts as landed

_NOW = datetime(2024, 1, 20, 12, 0, tzinfo=timezone.utc)
_SEARCH = SearchParams("the", ("SRC3", "#EN"), date(2024, 1, 3), date(2024, 1, 25), 100)
_TOPICS = SearchParams("The", ("#and", "on", "AND"), date(2024, 1, 2), date(2024, 1, 28), 300)

# Characters of descriptions in one landed feed file, about.
_FILE_CHARS = 2_000_000

_POST_SQL = """p AS (
  SELECT CAST(doc_id AS VARCHAR) AS tweet_id,
         TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(doc_id % 720 AS INTEGER)) AS created_at,
         source AS username, text || ' #' || source || ' #' || lang AS content,
         sha1(text) AS text_id, doc_id AS item_idx
  FROM documents)"""


def _posts(spark, sf_dir):
    hour = F.expr("make_dt_interval(0, CAST(doc_id % 720 AS INT))")
    docs = v.texts(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return docs.select(
        F.col("doc_id").cast("string").alias("tweet_id"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + hour).alias("created_at"),
        F.col("source").alias("username"),
        F.concat(F.col("text"), F.lit(" #"), "source", F.lit(" #"), "lang").alias("content"),
        F.sha1("text").alias("text_id"),
        F.col("doc_id").alias("item_idx"),
    )


def _search_filter(spark, sf_dir):
    posts = _posts(spark, sf_dir)
    wanted = search.matches_search(F.col("content"), F.col("created_at"), _SEARCH)
    return finish(posts.filter(wanted).select("tweet_id", "created_at", "username"))


def _date_window(spark, sf_dir):
    posts = v.tweets(spark, sf_dir)
    inside = search.in_date_window(F.col("created_at"), date(2024, 1, 5), date(2024, 1, 9))
    return finish(posts.filter(inside).select("tweet_id", "created_at"))


def _recent_window(spark, sf_dir):
    posts = v.tweets(spark, sf_dir)
    params = SearchParams("x", (), date(2024, 1, 15), date(2024, 1, 20))
    inside = search.in_recent_window(F.col("created_at"), params, _NOW)
    return finish(posts.filter(inside).select("tweet_id", "created_at"))


def _fanout(spark, sf_dir):
    tagged = search.topic_fanout(_posts(spark, sf_dir), _TOPICS)
    return tagged.select("tweet_id", "query_idx", "query")


def _first_seen(spark, sf_dir):
    posts = _posts(spark, sf_dir).withColumn("tweet_id", F.col("text_id")).drop("text_id")
    kept = search.first_seen(posts, _TOPICS)
    return finish(kept.select("tweet_id", "created_at", "item_idx", "query_idx", "query"))


def _first_seen_all(spark, sf_dir):
    """The same without a binding cap: every distinct text that matches a topic."""
    params = SearchParams(_TOPICS.keyword, _TOPICS.hashtags, max_results=2_000_000_000)
    posts = _posts(spark, sf_dir).withColumn("tweet_id", F.col("text_id")).drop("text_id")
    return search.first_seen(posts, params).select("tweet_id", "item_idx", "query")


def _runs_by_user_day(spark, sf_dir):
    rows = v.tweets(spark, sf_dir)
    run_id = F.concat_ws("@", "username", F.date_format("created_at", "yyyyMMdd"))
    rows = rows.select(run_id.alias("run_id"), "tweet_id", "sentiment_label")
    return (
        rows.filter(F.col("sentiment_label") == "positive"),
        rows.filter(F.col("sentiment_label") != "positive"),
    )


def _fallback(spark, sf_dir):
    primary, spare = _runs_by_user_day(spark, sf_dir)
    return search.first_nonempty(primary, spare, "auto", "twscrape")


def _provenance(spark, sf_dir):
    """Every user has a run each day of the month, also on days without posts."""
    primary, spare = _runs_by_user_day(spark, sf_dir)
    chosen = search.first_nonempty(primary, spare, "auto", "twscrape")
    users = v.tweets(spark, sf_dir).select("username").distinct()
    days = F.sequence(
        F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date")
    )
    runs = users.select("username", F.explode(days).alias("day")).select(
        F.concat_ws("@", "username", F.date_format("day", "yyyyMMdd")).alias("run_id"),
        F.lit("auto").alias("requested_backend"),
        F.lit("twscrape").alias("resolved_backend"),
    )
    return search.batch_provenance(runs, chosen)


def _search_keys(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    tags = F.array(F.col("lang"), F.concat(F.lit(" #"), "source"), F.lit("  "))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    key = source_query_column(
        F.concat(F.lit(" "), "source", F.lit(" ")),
        tags,
        day,
        F.lit(None).cast("date"),
        F.col("n_chars"),
    )
    return docs.select(
        "doc_id", key.alias("source_query"), F.array_join(tags_column(tags), " ").alias("tags")
    )


def _pages(spark, sf_dir):
    """One search page per conversation; two-turn conversations failed to load."""
    turns = v.table(spark, sf_dir, "conversations")
    tweet = F.struct(
        "turn",
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.col("text"),
        F.lit("2024-02-03T04:05:06Z").alias("created_at"),
        F.when(F.col("role") == "user", F.lit("")).otherwise(F.lit("en")).alias("lang"),
        F.col("role").alias("author_id"),
        F.struct(
            F.length("text").cast("bigint").alias("like_count"),
            F.lit(None).cast("bigint").alias("retweet_count"),
        ).alias("public_metrics"),
    )
    pages = turns.groupBy(F.col("conv_id").cast("string").alias("page_key")).agg(
        F.sort_array(F.collect_list(tweet)).alias("data")
    )
    user = "struct('user' AS id, concat('{0}', page_key) AS username, 'The User' AS name)"
    return pages.select(
        "page_key",
        "data",
        F.expr(
            f"named_struct('users', array({user.format('old')}, {user.format('u')}))"
        ).alias("includes"),
        F.when(
            F.size("data") == 2,
            F.expr("array(named_struct('detail', '', 'message', concat('page ', page_key)))"),
        ).alias("errors"),
    )


def _api_posts(spark, sf_dir):
    posts = landed.posts_from_pages(_pages(spark, sf_dir))
    author = F.get_json_object("raw_payload", "$.author.name")
    return finish(posts.withColumn("author", author).drop("raw_payload"))


def _api_rejected(spark, sf_dir):
    return landed.rejected_pages(_pages(spark, sf_dir))


def _scraped_posts(spark, sf_dir):
    kind = F.col("event_type")
    user = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    rows = v.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("date"),
        F.when(kind == "view", "").when(kind == "click", None).otherwise(F.col("props")).alias(
            "rawContent"
        ),
        F.when(kind != "signup", F.concat(F.lit("r "), kind)).alias("renderedContent"),
        F.when(kind != "error", F.concat(F.lit("https://x.com/"), user)).alias("url"),
        F.when(kind != "view", F.col("user_id")).alias("likeCount"),
        F.lit(None).cast("bigint").alias("retweetCount"),
        F.when(kind == "click", "").otherwise(F.lit("en")).alias("lang"),
        F.when(
            kind != "error", F.struct(user.alias("username"), F.upper(user).alias("displayname"))
        ).alias("user"),
    )
    posts = landed.posts_from_scraped(rows)
    return finish(posts.withColumn("payload_id", F.get_json_object("raw_payload", "$.id")).drop(
        "raw_payload"
    ))


def _items(spark, sf_dir):
    """One feed item per page; the page itself is the description."""
    day = F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0")
    date_text = F.concat(F.lit("Wed, "), day, F.lit(" May 2026 03:49:16 "))
    host = F.regexp_extract("url", "https?://([^/]+)", 1)
    return v.table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("item_idx"),
        F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"),
        F.col("url").alias("link"),
        F.when(F.contains("url", F.lit("https")), F.concat(F.lit("g-"), "url")).alias("guid"),
        F.when(F.contains("url", F.lit("/fr/")), F.lit("last week"))
        .when(F.contains("url", F.lit("/de/")), F.lit(None))
        .when(F.contains("url", F.lit("/es/")), F.concat(date_text, F.lit("-0500")))
        .otherwise(F.concat(date_text, F.lit("GMT")))
        .alias("pubDate"),
        F.struct(
            F.when(~F.contains("url", F.lit("page=")), host).alias("_VALUE"),
            F.col("url").alias("_url"),
        ).alias("source"),
        F.col("html").alias("description"),
    )


def _feed_posts(spark, sf_dir):
    posts = landed.posts_from_feed(_items(spark, sf_dir), _NOW, "q")
    kind = F.get_json_object("raw_payload", "$.source_type")
    return finish(posts.withColumn("source_type", kind).drop("raw_payload"))


def _feed_quarantine(spark, sf_dir):
    bad = landed.quarantined_items(_items(spark, sf_dir))
    return bad.select("item_idx", "title", "published_at")


def _landed_pages(spark, sf_dir):
    """The pages as files, an array of pages each, read back."""
    folder = working_folder(spark, "pages")
    one = F.to_json(F.struct("data", "includes", "errors"))
    grouped = _pages(spark, sf_dir).groupBy((F.xxhash64("page_key") % 20).alias("file"))
    files = grouped.agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("value"))
    files.write.partitionBy("file").text(folder)
    pages = landed.read_api_pages(spark, f"{folder}/*/*")
    posts = landed.posts_from_pages(pages)
    author = F.get_json_object("raw_payload", "$.author.name")
    return finish(posts.withColumn("author", author).drop("raw_payload", "page_key"))


def _landed_feed(spark, sf_dir):
    """The feed items as files of one channel each, read back."""
    folder = working_folder(spark, "feeds")

    def escaped(c):
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(plain), F.lit(entity))
        return c

    def tag(name, c):
        return F.coalesce(F.concat(F.lit(f"<{name}>"), escaped(c), F.lit(f"</{name}>")), F.lit(""))

    source = F.concat(
        F.lit('<source url="'), escaped(F.col("source._url")), F.lit('">'),
        escaped(F.coalesce("source._VALUE", F.lit(""))), F.lit("</source>"),
    )
    item = F.concat(
        F.lit("<item>"), *[tag(c, F.col(c)) for c in ("title", "link", "guid", "pubDate", "description")], source,
        F.lit("</item>"),
    )
    items = _items(spark, sf_dir)
    # Files are of bounded size, and each is put together by one task: there are more of them, not larger ones.
    n_files = max(10, math.ceil((items.agg(F.sum(F.length("description"))).first()[0] or 0) / _FILE_CHARS))
    file = F.pmod(F.xxhash64("item_idx", "link"), F.lit(n_files)).cast("int")
    placed = items.select(file.alias("file"), item.alias("item")).repartition(n_files, "file")
    grouped = placed.groupBy("file")
    channel = F.concat(
        F.lit("<rss><channel>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>")
    )
    # One line for a file: a feed's own line breaks are white space to the cleaning.
    files = grouped.agg(F.regexp_replace(channel, "[\\r\\n]", " ").alias("value"))
    files.write.partitionBy("file").text(folder)
    posts = landed.posts_from_feed(landed.read_feed_items(spark, f"{folder}/*/*"), _NOW, "q")
    kind = F.get_json_object("raw_payload", "$.source_type")
    return finish(posts.withColumn("source_type", kind).drop("raw_payload", "item_idx", "page_key"))


QUERIES = {
    "landed_pages": _landed_pages,
    "landed_feed": _landed_feed,
    "search_filter": _search_filter,
    "date_window": _date_window,
    "recent_window": _recent_window,
    "topic_fanout": _fanout,
    "topic_first_seen": _first_seen,
    "topic_first_seen_uncapped": _first_seen_all,
    "source_fallback": _fallback,
    "source_fallback_provenance": _provenance,
    "search_keys": _search_keys,
    "api_page_posts": _api_posts,
    "api_page_rejects": _api_rejected,
    "scraped_posts": _scraped_posts,
    "feed_posts": _feed_posts,
    "feed_quarantine": _feed_quarantine,
}

# The variants of _TOPICS, written out: (index, text, condition on lower(content)).
_HAS = {w: f"contains(lower(content), '{w}')" for w in ("the", "and", "on")}
_VARIANTS = [
    ("The and on AND", f"{_HAS['the']} AND {_HAS['and']} AND {_HAS['on']}"),
    ("The and", f"{_HAS['the']} AND {_HAS['and']}"),
    ("The on", f"{_HAS['the']} AND {_HAS['on']}"),
    ("and on AND", f"{_HAS['and']} AND {_HAS['on']}"),
    ("The OR and OR on OR AND", f"{_HAS['the']} OR {_HAS['and']} OR {_HAS['on']}"),
    ("The", _HAS["the"]),
    ("and", _HAS["and"]),
    ("on", _HAS["on"]),
]
_TAGGED = "tagged AS (" + " UNION ALL ".join(
    f"SELECT *, CAST({i} AS INTEGER) AS query_idx, '{text}' AS query FROM p WHERE {cond}"
    for i, (text, cond) in enumerate(_VARIANTS)
) + ")"
_FIRST = """first AS (SELECT *, row_number() OVER (PARTITION BY text_id
  ORDER BY query_idx, item_idx) AS rn FROM tagged {where})"""

_RUNS_SQL = """e AS (
  SELECT 'user_' || user_id || '@' || strftime(ts, '%Y%m%d') AS run_id,
         CAST(event_id AS VARCHAR) AS tweet_id,
         CASE WHEN event_type IN ('purchase','signup') THEN 'positive'
              WHEN event_type = 'error' THEN 'negative' ELSE 'neutral' END AS sentiment_label
  FROM events),
chosen AS (
  SELECT *, sentiment_label <> 'positive' AS spare FROM e
  WHERE sentiment_label = 'positive' OR run_id NOT IN (
    SELECT run_id FROM e WHERE sentiment_label = 'positive'))"""

_ITEMS_SQL = f"""items AS (
  SELECT page_id AS item_idx, url,
         {sql_feed_text("regexp_extract(html, '<title>(.*?)</title>', 1)")} AS title,
         {sql_feed_text('html')} AS description,
         CASE WHEN contains(url, 'https') THEN {sql_feed_text("'g-' || url")} ELSE '' END AS guid,
         {sql_feed_text('url')} AS link,
         CASE WHEN NOT contains(url, 'page=')
              THEN regexp_extract(url, 'https?://([^/]+)', 1) ELSE 'Google News' END AS source,
         CASE WHEN contains(url, '/fr/') THEN 'last week' WHEN contains(url, '/de/') THEN ''
              ELSE 'dated' END AS published,
         TIMESTAMP '2026-05-01 03:49:16' + to_days(CAST(page_id % 28 AS INTEGER))
           + CASE WHEN contains(url, '/es/') THEN INTERVAL 5 HOUR ELSE INTERVAL 0 HOUR END AS dated
  FROM pages)"""

SQL = {
    "search_filter": rf"""WITH {_POST_SQL}
      SELECT tweet_id, created_at, username FROM p
      WHERE contains(lower(content), 'the')
        AND regexp_matches(lower(content), '#src3([^\p{{L}}\p{{N}}_]|$)')
        AND regexp_matches(lower(content), '#en([^\p{{L}}\p{{N}}_]|$)')
        AND CAST(created_at AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25'""",
    "date_window": """SELECT CAST(event_id AS VARCHAR) AS tweet_id,
        date_trunc('second', ts) AS created_at FROM events
      WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-09'""",
    "recent_window": """SELECT CAST(event_id AS VARCHAR) AS tweet_id,
        date_trunc('second', ts) AS created_at FROM events
      WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00'""",
    "topic_fanout": f"WITH {_POST_SQL}, {_TAGGED} SELECT tweet_id, query_idx, query FROM tagged",
    "topic_first_seen": f"""WITH {_POST_SQL}, {_TAGGED}, {_FIRST.format(
        where="WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-28'")}
      SELECT text_id AS tweet_id, created_at, item_idx, query_idx, query FROM first
      WHERE rn = 1 ORDER BY query_idx, item_idx LIMIT 300""",
    "topic_first_seen_uncapped": f"""WITH {_POST_SQL}, {_TAGGED}, {_FIRST.format(where="")}
      SELECT text_id AS tweet_id, item_idx, query FROM first WHERE rn = 1""",
    "source_fallback": f"""WITH {_RUNS_SQL}
      SELECT run_id, tweet_id, sentiment_label, 'auto' AS requested_backend,
             'twscrape' AS resolved_backend,
             CASE WHEN spare THEN 'news_rss' ELSE 'twscrape' END AS served_backend,
             spare AS fallback_used FROM chosen""",
    "source_fallback_provenance": f"""WITH {_RUNS_SQL},
      runs AS (
        SELECT 'user_' || u.user_id || '@' || strftime(d.day, '%Y%m%d') AS run_id
        FROM (SELECT DISTINCT user_id FROM events) u,
             (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30',
                                            INTERVAL 1 DAY)) AS day) d),
      n AS (SELECT run_id, count(*) AS collected, bool_or(spare) AS spare FROM chosen GROUP BY 1)
      SELECT runs.run_id, 'auto' AS requested_backend, 'twscrape' AS resolved_backend,
             CASE WHEN coalesce(spare, true) THEN 'news_rss' ELSE 'twscrape' END AS served_backend,
             coalesce(spare, true) AS fallback_used, coalesce(collected, 0) AS collected
      FROM runs LEFT JOIN n ON n.run_id = runs.run_id""",
    "search_keys": """SELECT doc_id,
        'keyword=' || source || ';hashtags=#' || lang || ',#' || source || ';start='
          || strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d')
          || ';end=;limit=' || n_chars AS source_query,
        '#' || lang || ' #' || source AS tags FROM documents""",
    "api_page_posts": """
      SELECT CAST(conv_id AS VARCHAR) AS page_key,
             CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS item_idx,
             conv_id || '-' || turn AS tweet_id, TIMESTAMP '2024-02-03 04:05:06' AS created_at,
             CASE WHEN role = 'user' THEN 'u' || conv_id ELSE 'unknown' END AS username,
             CASE WHEN role = 'user' THEN 'The User' ELSE 'unknown' END AS display_name,
             text AS content,
             CASE WHEN role = 'user' THEN 'https://x.com/u' || conv_id || '/status/' || conv_id
                  || '-' || turn ELSE '' END AS url,
             CAST(length(text) AS BIGINT) AS like_count, CAST(0 AS BIGINT) AS retweet_count,
             CASE WHEN role = 'user' THEN 'unknown' ELSE 'en' END AS lang,
             CASE WHEN role = 'user' THEN 'The User' END AS author
      FROM conversations
      WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) <> 2)""",
    "api_page_rejects": """
      SELECT CAST(conv_id AS VARCHAR) AS page_key,
             'X API request failed: page ' || conv_id AS message
      FROM conversations GROUP BY conv_id HAVING count(*) = 2""",
    "scraped_posts": """
      SELECT CAST(event_id AS VARCHAR) AS tweet_id, date_trunc('second', ts) AS created_at,
             CASE WHEN event_type = 'error' THEN 'unknown' ELSE 'u' || user_id END AS username,
             CASE WHEN event_type = 'error' THEN 'unknown' ELSE 'U' || user_id END AS display_name,
             CASE WHEN event_type IN ('view', 'click') THEN 'r ' || event_type
                  ELSE props END AS content,
             CASE WHEN event_type = 'error' THEN '' ELSE 'https://x.com/u' || user_id END AS url,
             CASE WHEN event_type = 'view' THEN 0 ELSE user_id END AS like_count,
             CAST(0 AS BIGINT) AS retweet_count,
             CASE WHEN event_type = 'click' THEN 'unknown' ELSE 'en' END AS lang,
             CAST(event_id AS VARCHAR) AS payload_id
      FROM events""",
    "feed_posts": f"""WITH {_ITEMS_SQL}
      SELECT item_idx, sha1(CASE WHEN guid <> '' THEN guid ELSE link END) AS tweet_id,
             CASE WHEN published = '' THEN TIMESTAMP '2024-01-20 12:00:00' ELSE dated END
               AS created_at,
             coalesce(nullif(trim(regexp_replace({sql_fold('source')}, '[^a-z0-9_]+', '_', 'g'),
                      '_'), ''), 'google_news') AS username,
             source AS display_name,
             CASE WHEN description <> '' AND {sql_fold('description')} <> {sql_fold('title')}
                  THEN title || '. ' || description ELSE title END AS content,
             link AS url, CAST(0 AS BIGINT) AS like_count, CAST(0 AS BIGINT) AS retweet_count,
             'en' AS lang, 'google_news_rss' AS source_type
      FROM items WHERE title <> '' AND published <> 'last week'""",
    "feed_quarantine": f"""WITH {_ITEMS_SQL}
      SELECT item_idx, title, published AS published_at
      FROM items WHERE title <> '' AND published = 'last week'""",
}
SQL["landed_pages"] = f"SELECT * EXCLUDE (page_key) FROM ({SQL['api_page_posts']})"
SQL["landed_feed"] = f"SELECT * EXCLUDE (item_idx) FROM ({SQL['feed_posts']})"
