"""Landed API pages, scraped posts and feed items, all read into one post schema."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from posttide import schemas
from posttide.functions import text as t

UNKNOWN = "unknown"


def _count(c: Column) -> Column:
    return F.coalesce(c, F.lit(0)).cast("bigint")


def _post(df: DataFrame, **columns: Column) -> DataFrame:
    """Project to the post schema, keeping the arrival-order columns in front."""
    arrival = [c for c in ("run_id", "page_key", "item_idx") if c in df.columns]
    return df.select(
        *arrival,
        *[columns[f.name].cast(f.dataType).alias(f.name) for f in schemas.RAW_POST.fields],
    )


def read_api_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per landed search page; ``page_key`` (the file) gives arrival order."""
    pages = spark.read.schema(schemas.API_PAGE).option("multiLine", True).json(path)
    return pages.withColumn("page_key", F.col("_metadata.file_path"))


def has_errors() -> Column:
    return F.coalesce(F.size("errors") > 0, F.lit(False))


def rejected_pages(pages: DataFrame) -> DataFrame:
    """Pages that carry errors, with their message; none of their data counts."""
    detail = F.transform(
        "errors",
        lambda e: F.coalesce(
            F.nullif(e["detail"], F.lit("")), F.nullif(e["message"], F.lit("")), F.to_json(e)
        ),
    )
    return pages.filter(has_errors()).select(
        "page_key",
        F.concat(F.lit("X API request failed: "), F.array_join(detail, "; ")).alias("message"),
    )


def _unreadable(date: Column) -> Column:
    """A date is there but is no date."""
    return date.isNotNull() & F.try_to_timestamp(date).isNull()


def _page_items(pages: DataFrame) -> DataFrame:
    return pages.filter(~has_errors()).select(
        *[c for c in ("run_id", "page_key") if c in pages.columns],
        F.posexplode("data").alias("item_idx", "tweet"),
        F.col("includes.users").alias("users"),
    )


def quarantined_tweets(pages: DataFrame) -> DataFrame:
    """Items of error-free pages whose date cannot be read."""
    return _page_items(pages).filter(_unreadable(F.col("tweet.created_at"))).drop("users")


def quarantined_scraped(scraped: DataFrame) -> DataFrame:
    """Scraped posts whose date cannot be read."""
    return scraped.filter(_unreadable(F.col("date")))


def posts_from_pages(pages: DataFrame) -> DataFrame:
    """Posts of error-free pages; items with an unreadable date are left to the quarantine.

    Authors are listed in the page itself, so they are looked up inside the row
    (the last entry of an id wins) and nothing is joined.
    """
    items = _page_items(pages).filter(~_unreadable(F.col("tweet.created_at")))
    same_id = F.filter(
        "users", lambda u: u["id"].isNotNull() & (u["id"] == F.col("tweet.author_id"))
    )
    items = items.withColumn("author", F.try_element_at(same_id, F.lit(-1)))
    username = F.coalesce("author.username", F.lit(UNKNOWN))
    tweet_id = F.coalesce("tweet.id", F.lit(""))
    url = F.concat(F.lit("https://x.com/"), username, F.lit("/status/"), tweet_id)
    return _post(
        items,
        tweet_id=tweet_id,
        created_at=F.try_to_timestamp("tweet.created_at"),
        username=username,
        display_name=F.coalesce("author.name", F.lit(UNKNOWN)),
        content=F.coalesce("tweet.text", F.lit("")),
        url=F.when(username != UNKNOWN, url).otherwise(F.lit("")),
        like_count=_count(F.col("tweet.public_metrics.like_count")),
        retweet_count=_count(F.col("tweet.public_metrics.retweet_count")),
        lang=t.or_default(F.col("tweet.lang"), UNKNOWN),
        raw_payload=F.to_json(F.struct("tweet", "author")),
    )


def read_scraped_posts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines written by a scraper."""
    return spark.read.schema(schemas.SCRAPED_POST).json(path)


def posts_from_scraped(scraped: DataFrame) -> DataFrame:
    """Scraped posts but those with an unreadable date."""
    scraped = scraped.filter(~_unreadable(F.col("date")))
    content = F.coalesce(
        F.nullif("rawContent", F.lit("")), F.col("renderedContent"), F.lit("")
    )
    payload = F.to_json(F.struct(*[f.name for f in schemas.SCRAPED_POST.fields]))
    return _post(
        scraped,
        tweet_id=F.coalesce("id", F.lit("")),
        created_at=F.try_to_timestamp("date"),
        username=F.coalesce("user.username", F.lit(UNKNOWN)),
        display_name=F.coalesce("user.displayname", F.lit(UNKNOWN)),
        content=content,
        url=F.coalesce("url", F.lit("")),
        like_count=_count(F.col("likeCount")),
        retweet_count=_count(F.col("retweetCount")),
        lang=t.or_default(F.col("lang"), UNKNOWN),
        raw_payload=payload,
    )


def read_feed_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of the channels of landed RSS files, numbered in order; a malformed file is an error."""
    channel = T.StructType([T.StructField("item", T.ArrayType(schemas.FEED_ITEM))])
    channels = (
        spark.read.format("xml")
        .option("rowTag", "channel")
        .option("mode", "FAILFAST")
        .schema(channel)
        .load(path)
        .withColumn("page_key", F.col("_metadata.file_path"))
    )
    items = channels.select("page_key", F.posexplode("item").alias("item_idx", "item"))
    return items.select("item.*", "page_key", "item_idx")


def _cleaned_items(items: DataFrame) -> DataFrame:
    """Items with clean text fields and a parsed date; those without a title go."""
    source = F.col("source._VALUE")
    keep = [c for c in ("run_id", "page_key", "item_idx", "query") if c in items.columns]
    cleaned = items.select(
        *keep,
        *[
            t.clean_feed_text(c).alias(name)
            for name, c in (
                ("title", F.col("title")),
                ("link", F.col("link")),
                ("guid", F.col("guid")),
                ("source", source),
                ("description", F.col("description")),
                ("published_at", F.col("pubDate")),
            )
        ],
    ).filter(F.col("title") != "")
    return cleaned.withColumn("_parsed", t.parse_rfc822(F.col("published_at")))


def quarantined_items(items: DataFrame) -> DataFrame:
    """Items whose date cannot be read; they are kept apart instead of failing the batch."""
    return _cleaned_items(items).filter((F.col("published_at") != "") & F.col("_parsed").isNull())


def posts_from_feed(items: DataFrame, now: datetime, query: str = "") -> DataFrame:
    """Posts of feed items; an item without a date is dated ``now``."""
    cleaned = _cleaned_items(items).filter(
        (F.col("published_at") == "") | F.col("_parsed").isNotNull()
    )
    if "query" not in cleaned.columns:
        cleaned = cleaned.withColumn("query", F.lit(query))
    cleaned = cleaned.withColumn("source", t.or_default(F.col("source"), "Google News"))
    post = {
        "tweet_id": t.sha1_id(F.col("guid"), F.col("link"), F.col("title")),
        "created_at": F.coalesce("_parsed", F.lit(now).cast("timestamp")),
        "username": t.slug(F.col("source")),
        "display_name": F.col("source"),
        "content": t.title_and_description(F.col("title"), F.col("description")),
        "url": F.col("link"),
        "lang": F.lit("en"),
    }
    stamp = F.date_format(post["created_at"], "yyyy-MM-dd'T'HH:mm:ssXXX")
    payload = F.to_json(
        F.struct(
            *[
                (stamp if name == "created_at" else c).alias(name)
                for name, c in post.items()
            ],
            F.lit("google_news_rss").alias("source_type"),
            *["query", "title", "description", "guid", "link", "source", "published_at"],
        )
    )
    zero = F.lit(0)
    return _post(cleaned, **post, like_count=zero, retweet_count=zero, raw_payload=payload)
