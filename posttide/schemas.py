"""StructTypes of the entities and stored tables."""

from __future__ import annotations

from pyspark.sql import types as T


STRING, BIGINT, DOUBLE = T.StringType(), T.LongType(), T.DoubleType()
BOOLEAN, TIMESTAMP = T.BooleanType(), T.TimestampType()
STRINGS = T.ArrayType(STRING)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


RAW_POST = _struct(
    tweet_id=STRING,
    created_at=TIMESTAMP,
    username=STRING,
    display_name=STRING,
    content=STRING,
    url=STRING,
    like_count=BIGINT,
    retweet_count=BIGINT,
    lang=STRING,
    raw_payload=STRING,
)

TWEETS = _struct(
    tweet_id=STRING,
    username=STRING,
    display_name=STRING,
    created_at=TIMESTAMP,
    content=STRING,
    url=STRING,
    cleaned_text=STRING,
    tokens=STRINGS,
    sentiment_label=STRING,
    sentiment_score=DOUBLE,
    sentiment_confidence=DOUBLE,
    like_count=BIGINT,
    retweet_count=BIGINT,
    lang=STRING,
    raw_payload=STRING,
    updated_at=TIMESTAMP,
)

LINKS = _struct(run_id=BIGINT, tweet_id=STRING, ingested_at=TIMESTAMP)

RUNS = _struct(
    id=BIGINT,
    source_query=STRING,
    model_name=STRING,
    status=STRING,
    error_message=STRING,
    total_collected=BIGINT,
    total_stored=BIGINT,
    requested_backend=STRING,
    resolved_backend=STRING,
    served_backend=STRING,
    fallback_used=BOOLEAN,
    raw_export_path=STRING,
    processed_export_path=STRING,
    started_at=TIMESTAMP,
    completed_at=TIMESTAMP,
)

# One row per status change of a run; the state of a run is folded from them.
RUN_EVENTS = _struct(
    run_id=BIGINT,
    event=STRING,
    event_seq=BIGINT,
    event_at=TIMESTAMP,
    source_query=STRING,
    model_name=STRING,
    requested_backend=STRING,
    resolved_backend=STRING,
    served_backend=STRING,
    fallback_used=BOOLEAN,
    total_collected=BIGINT,
    total_stored=BIGINT,
    raw_export_path=STRING,
    processed_export_path=STRING,
    error_message=STRING,
)

API_PAGE = _struct(
    data=T.ArrayType(
        _struct(
            id=STRING,
            text=STRING,
            created_at=STRING,
            lang=STRING,
            author_id=STRING,
            public_metrics=_struct(like_count=BIGINT, retweet_count=BIGINT),
        )
    ),
    includes=_struct(users=T.ArrayType(_struct(id=STRING, username=STRING, name=STRING))),
    meta=_struct(next_token=STRING),
    errors=T.ArrayType(_struct(detail=STRING, message=STRING)),
)

SCRAPED_POST = _struct(
    id=STRING,
    date=STRING,
    rawContent=STRING,
    renderedContent=STRING,
    url=STRING,
    likeCount=BIGINT,
    retweetCount=BIGINT,
    lang=STRING,
    user=_struct(username=STRING, displayname=STRING),
)

FEED_ITEM = _struct(
    title=STRING,
    link=STRING,
    guid=STRING,
    pubDate=STRING,
    source=_struct(_VALUE=STRING, _url=STRING),
    description=STRING,
)

TRAINING_FRAME = _struct(
    text=STRING,
    label=STRING,
    sample_weight=DOUBLE,
    source_path=STRING,
    source_kind=STRING,
)

# Columns later versions added to stored tables, with their defaults.
ADDED_COLUMNS = {
    "tweets": {"url": ("string", "")},
    "ingestion_runs": {
        "requested_backend": ("string", "unknown"),
        "resolved_backend": ("string", "unknown"),
        "served_backend": ("string", "unknown"),
        "fallback_used": ("boolean", False),
        "raw_export_path": ("string", None),
        "processed_export_path": ("string", None),
    },
}

NOT_NULL = {
    "tweets": [
        "username", "display_name", "created_at", "content", "url", "cleaned_text",
        "tokens", "sentiment_label", "sentiment_score", "sentiment_confidence",
        "like_count", "retweet_count", "lang", "raw_payload", "updated_at",
    ],
    "ingestion_runs": [
        "source_query", "model_name", "requested_backend", "resolved_backend",
        "served_backend", "fallback_used", "status", "total_collected", "total_stored",
        "started_at",
    ],
    "ingestion_run_tweets": ["run_id", "tweet_id", "ingested_at"],
}
