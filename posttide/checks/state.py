"""Upsert, links, run log, audits, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from posttide import testviews as v
from posttide.checks.analytics import T_LINKS, T_TWEETS
from posttide.checks.shape import finish
from posttide.functions import text as t
from posttide.operators import state
from posttide.session import working_folder
from posttide.sinks import exports


def _batches(spark, sf_dir):
    """Existing rows and an overlapping batch, both keyed by user: many copies per key."""
    rows = v.events(spark, sf_dir).select(
        F.concat_ws("-", "user_id", F.dayofmonth("ts")).alias("tweet_id"),
        F.col("event_type").alias("label"),
        F.col("value"),
        F.col("event_id").alias("ordinal"),
    )
    first = rows.filter(F.col("label").isin("view", "click", "error"))
    second = rows.filter(F.col("label").isin("error", "purchase", "signup"))
    return first, second


def _upsert(spark, sf_dir):
    first, second = _batches(spark, sf_dir)
    stored = state.upsert(first.limit(0), first)
    return finish(state.upsert(stored, second))


def _link_ignore(spark, sf_dir):
    links = v.links(spark, sf_dir)
    existing = links.filter(F.col("run_id") == 2)
    again = links.select(F.lit(2).cast("bigint").alias("run_id"), "tweet_id", "ingested_at")
    return finish(state.insert_or_ignore(existing, again, ["run_id", "tweet_id"]))


def _run_events(spark, sf_dir):
    """Orders as runs: every one opened, F completed, P failed.

    Line items of unknown orders would be events of runs never opened; the
    customers' keys below zero stand for them.
    """
    orders = v.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    started = F.col("o_orderdate").cast("timestamp")
    none = F.lit(None).cast("string")

    def event(rows, kind, seq, hours, **fields):
        base = {
            "run_id": key,
            "event": F.lit(kind),
            "event_seq": F.lit(seq).cast("bigint"),
            "event_at": started + F.expr(f"INTERVAL {hours} HOUR"),
            **{
                name: none
                for name in (
                    "source_query", "model_name", "requested_backend", "resolved_backend",
                    "served_backend", "raw_export_path", "processed_export_path",
                    "error_message",
                )
            },
            "fallback_used": F.lit(None).cast("boolean"),
            "total_collected": F.lit(None).cast("bigint"),
            "total_stored": F.lit(None).cast("bigint"),
        }
        base.update(fields)
        return rows.select(*[c.alias(name) for name, c in base.items()])

    opened = event(
        orders, "open", 1, 0,
        source_query=F.concat(F.lit("keyword="), F.col("o_orderpriority")),
        model_name=F.lit("vader"),
        requested_backend=F.lit("auto"),
        resolved_backend=F.lit("x_api"),
    )
    done = event(
        orders.filter(F.col("o_orderstatus") == "F"), "complete", 2, 2,
        total_collected=F.col("o_custkey"),
        total_stored=F.col("o_custkey") - 1,
        served_backend=F.lit("news_rss"),
        fallback_used=F.lit(True),
        raw_export_path=F.concat(F.lit("raw/"), key.cast("string")),
    )
    failed = event(
        orders.filter(F.col("o_orderstatus") == "P"), "fail", 2, 3,
        error_message=F.concat(F.lit("no source for "), F.col("o_orderpriority")),
    )
    unknown = event(orders, "complete", 2, 1, run_id=-key - 1, served_backend=F.lit("x_api"))
    return opened.unionByName(done).unionByName(failed).unionByName(unknown)


def _run_table(spark, sf_dir):
    return finish(state.run_history(state.fold_runs(_run_events(spark, sf_dir))))


def _recent_runs(spark, sf_dir):
    runs = state.fold_runs(_run_events(spark, sf_dir))
    return finish(state.run_history(state.recent_runs(runs, 25)))


def _run_details(spark, sf_dir):
    return finish(state.run_details(state.fold_runs(_run_events(spark, sf_dir)), 7))


def _fk_audit(spark, sf_dir):
    """Links whose post is an error event, when those posts are gone."""
    tweets = v.tweets(spark, sf_dir).filter(F.col("sentiment_label") != "negative")
    missing = state.orphans(v.links(spark, sf_dir), "tweet_id", tweets, "tweet_id")
    return missing.select("run_id", "tweet_id")


def _pk_audit(spark, sf_dir):
    first, second = _batches(spark, sf_dir)
    return state.key_violations(first.unionByName(second), ["tweet_id"])


def _null_audit(spark, sf_dir):
    tweets = v.tweets(spark, sf_dir)
    holed = tweets.withColumns(
        {
            "url": F.when(F.col("sentiment_label") != "negative", F.col("url")),
            "sentiment_score": F.when(
                F.col("sentiment_label") != "neutral", F.col("sentiment_score")
            ),
        }
    )
    return state.null_violations(holed, "tweets")


def _conform(spark, sf_dir):
    old = v.tweets(spark, sf_dir).select("tweet_id", "username")
    return state.conform(old, "tweets")


def _cascade(spark, sf_dir):
    tweets = v.tweets(spark, sf_dir).select("tweet_id", "sentiment_label")
    gone = tweets.filter(F.col("sentiment_label") == "positive")
    _, links = state.delete_cascade(
        tweets, v.links(spark, sf_dir), "tweet_id", "tweet_id", gone
    )
    return links.groupBy("run_id").agg(F.count(F.lit(1)).alias("links"))


def _export_names(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    at = F.lit("2024-03-04 05:06:07").cast("timestamp")
    return docs.select("doc_id", exports.export_name(F.col("text"), at).alias("name"))


def _export_rows(spark, sf_dir):
    tweets = v.tweets(spark, sf_dir).withColumns(
        {
            "tokens": F.split("content", " "),
            "sentiment_metadata": F.to_json(F.struct(F.lit("x").alias("reason"))),
        }
    )
    return finish(exports.processed_rows(tweets))


def _read_back(spark, sf_dir):
    """A processed export, as files, read back."""
    tweets = v.tweets(spark, sf_dir).withColumns(
        {"tokens": F.split("content", " "), "sentiment_metadata": F.lit("{}")}
    )
    path = exports.export_processed(tweets, f"{working_folder(spark, 'exports')}/posts.csv")
    rows = exports.read_export(spark, path, limit=2_000_000_000)
    return rows.select("tweet_id", "created_at", "username", "content", "tokens", "sentiment_label")


def _raw_export(spark, sf_dir):
    """Payloads of two shapes, as one table."""
    rows = v.table(spark, sf_dir, "events")
    sold = F.to_json(F.struct("event_id", "user_id"))
    other = F.to_json(F.struct("event_id", F.col("event_type").alias("kind")))
    payload = F.when(F.col("event_type") == "purchase", sold).otherwise(other)
    return exports.payload_rows(rows.select(payload.alias("raw_payload")))


def _payload_union(spark, sf_dir):
    rows = v.table(spark, sf_dir, "events")
    sold = rows.filter("event_type = 'purchase'").select("event_id", "user_id")
    other = rows.filter("event_type <> 'purchase'").select("event_type", "event_id")
    return exports.union_payloads([sold, other])


def _utc_text(spark, sf_dir):
    rows = v.events(spark, sf_dir)
    return rows.select("event_id", t.utc_text(F.col("ts")).alias("created_at"))


QUERIES = {
    "export_read_back": _read_back,
    "raw_export_rows": _raw_export,
    "payload_union": _payload_union,
    "utc_text": _utc_text,
    "upsert_latest": _upsert,
    "link_insert_ignore": _link_ignore,
    "run_log": _run_table,
    "run_history": _recent_runs,
    "run_details": _run_details,
    "fk_audit": _fk_audit,
    "pk_audit": _pk_audit,
    "null_audit": _null_audit,
    "schema_conform": _conform,
    "cascade_delete": _cascade,
    "export_names": _export_names,
    "export_rows": _export_rows,
}

_RUNS = """runs AS (
  SELECT o_orderkey AS id, 'keyword=' || o_orderpriority AS source_query,
         'vader' AS model_name,
         CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed'
              ELSE 'running' END AS status,
         CASE WHEN o_orderstatus = 'P' THEN 'no source for ' || o_orderpriority END
           AS error_message,
         CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 0 END AS total_collected,
         CASE WHEN o_orderstatus = 'F' THEN o_custkey - 1 ELSE 0 END AS total_stored,
         'auto' AS requested_backend, 'x_api' AS resolved_backend,
         CASE WHEN o_orderstatus = 'F' THEN 'news_rss' ELSE 'unknown' END AS served_backend,
         o_orderstatus = 'F' AS fallback_used,
         CASE WHEN o_orderstatus = 'F' THEN 'raw/' || o_orderkey END AS raw_export_path,
         CAST(NULL AS VARCHAR) AS processed_export_path, o_orderdate AS started_at,
         CASE o_orderstatus WHEN 'F' THEN o_orderdate + INTERVAL 2 HOUR
              WHEN 'P' THEN o_orderdate + INTERVAL 3 HOUR END AS completed_at
  FROM orders)"""

_KEYED = """k AS (
  SELECT user_id || '-' || day(ts) AS tweet_id, event_type AS label, value,
         event_id AS ordinal FROM events)"""

SQL = {
    "raw_export_rows": """SELECT CAST(event_id AS VARCHAR) AS event_id,
        CASE WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) END AS user_id,
        CASE WHEN event_type <> 'purchase' THEN event_type END AS kind FROM events""",
    "payload_union": """SELECT event_id,
        CASE WHEN event_type = 'purchase' THEN user_id END AS user_id,
        CASE WHEN event_type <> 'purchase' THEN event_type END AS event_type FROM events""",
    "utc_text": """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at
      FROM events""",
    "upsert_latest": f"""WITH {_KEYED},
      both_batches AS (
        SELECT *, 1 AS batch FROM k WHERE label IN ('view', 'click', 'error')
        UNION ALL SELECT *, 2 FROM k WHERE label IN ('error', 'purchase', 'signup')),
      r AS (SELECT *, row_number() OVER (PARTITION BY tweet_id
                                         ORDER BY batch DESC, ordinal DESC) AS rn
            FROM both_batches)
      SELECT tweet_id, label, value, ordinal FROM r WHERE rn = 1""",
    "link_insert_ignore": f"""WITH {T_LINKS}
      SELECT CAST(2 AS BIGINT) AS run_id, tweet_id, min(ingested_at) AS ingested_at
      FROM t_links WHERE tweet_id NOT IN (SELECT tweet_id FROM t_links WHERE run_id = 2)
      GROUP BY tweet_id""",
    "run_log": f"WITH {_RUNS} SELECT * FROM runs",
    "run_history": f"WITH {_RUNS} SELECT * FROM runs ORDER BY id DESC LIMIT 25",
    "run_details": f"WITH {_RUNS} SELECT * FROM runs WHERE id = 7",
    "fk_audit": f"""WITH {T_TWEETS}, {T_LINKS}
      SELECT run_id, tweet_id FROM t_links WHERE tweet_id NOT IN (
        SELECT tweet_id FROM t_tweets WHERE sentiment_label <> 'negative')""",
    "pk_audit": f"""WITH {_KEYED}
      SELECT tweet_id, sum(CASE WHEN label = 'error' THEN 2 ELSE 1 END)::BIGINT AS copies
      FROM k GROUP BY tweet_id
      HAVING sum(CASE WHEN label = 'error' THEN 2 ELSE 1 END) > 1""",
    "null_audit": f"""WITH {T_TWEETS}
      SELECT 'url' AS column, count(*) AS violations FROM t_tweets
      WHERE sentiment_label = 'negative'
      UNION ALL SELECT 'sentiment_score', count(*) FROM t_tweets
      WHERE sentiment_label = 'neutral'""",
    "schema_conform": f"WITH {T_TWEETS} SELECT tweet_id, username, '' AS url FROM t_tweets",
    "cascade_delete": f"""WITH {T_TWEETS}, {T_LINKS}
      SELECT run_id, count(*) AS links FROM t_links WHERE tweet_id NOT IN (
        SELECT tweet_id FROM t_tweets WHERE sentiment_label = 'positive')
      GROUP BY run_id""",
    "export_names": """SELECT doc_id,
        coalesce(nullif(left(lower(trim(regexp_replace(text, '[^a-zA-Z0-9]+', '_', 'g'), '_')),
                             80), ''), 'tweets') || '_20240304T050607Z.csv' AS name
      FROM documents""",
    "export_read_back": f"""WITH {T_TWEETS}
      SELECT tweet_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, username, content,
             '["' || array_to_string(list_transform(string_split(content, ' '),
                     lambda w: replace(w, '"', '\\"')), '","') || '"]' AS tokens, sentiment_label
      FROM t_tweets""",
    "export_rows": f"""WITH {T_TWEETS}
      SELECT tweet_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, username,
             display_name, content, cleaned_text,
             '["' || array_to_string(list_transform(string_split(content, ' '),
                     lambda w: replace(w, '"', '\\"')), '","') || '"]' AS tokens,
             sentiment_label, round(sentiment_score, 12) AS sentiment_score,
             round(sentiment_confidence, 12) AS sentiment_confidence,
             '{{"reason":"x"}}' AS sentiment_metadata
      FROM t_tweets""",
}
