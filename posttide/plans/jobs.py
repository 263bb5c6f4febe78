"""Jobs: ingest one search, train a model, report on a run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posttide.ml import classifier as cl
from posttide.operators import ranking, search, series, state, summary
from posttide.params import SearchParams, resolve_source
from posttide.plans.scorers import Scorer, analyze
from posttide.session import bucketed, cut_lineage
from posttide.sinks import exports
from posttide.sinks.store import PostStore, utc_now
from posttide.sources.labeled import training_corpus, training_paths


@dataclass(frozen=True)
class RunResult:
    run_id: int
    source_query: str
    model_name: str
    collected_count: int
    stored_count: int
    requested_backend: str
    resolved_backend: str
    served_backend: str
    fallback_used: bool
    raw_export_path: str | None
    processed_export_path: str | None


def ingest(
    store: PostStore,
    params: SearchParams,
    readers: dict[str, Callable[[], DataFrame]],
    scorer: Scorer,
    model_name: str,
    requested: str = "auto",
    available: tuple[str, ...] = (),
    raw_dir: str | None = None,
    processed_dir: str | None = None,
    now: datetime | None = None,
) -> RunResult:
    """Read, search, analyze, store, link and export one search, and log the run.

    ``readers`` gives the landed posts of each source in the post schema. A
    failure after the run was opened is logged with the run and raised.
    """
    params.validate()
    asked, resolved = resolve_source(requested, available)
    run_id = store.open_run(params.source_query, model_name, asked, resolved)
    try:
        batch = search.fetch_batch(readers, asked, resolved)
        chosen = search.chosen_posts(batch.posts, params, batch.served_backend, now or utc_now())
        # Ids are distinct by now, so the ordinal only names a row. It is given once and written,
        # in buckets, so that scores come to the posts and posts need not move.
        posts = bucketed(chosen.withColumn("ordinal", F.monotonically_increasing_id()), "ordinal")
        analyzed = cut_lineage(analyze(posts, scorer))
        collected = posts.count()
        stored = store.upsert_tweets(analyzed, f"run-{run_id}")
        store.link_tweets(run_id, analyzed.select("tweet_id"))
        spark, at = store.spark, utc_now()
        raw = processed = None
        if raw_dir:
            path = exports.export_path(spark, raw_dir, params.source_query, at)
            raw = exports.export_raw(posts, path)
        if processed_dir:
            path = exports.export_path(spark, processed_dir, params.source_query, at)
            processed = exports.export_processed(analyzed, path)
        store.complete_run(
            run_id, collected, stored, batch.served_backend, batch.fallback_used, raw, processed
        )
    except Exception as exc:
        store.fail_run(run_id, str(exc))
        raise
    return RunResult(
        run_id, params.source_query, model_name, collected, stored, asked, resolved,
        batch.served_backend, batch.fallback_used, raw, processed,
    )


def train_job(
    spark: SparkSession,
    model_path: str,
    explicit: str | None = None,
    configured: str | None = None,
    processed_dir: str | None = None,
) -> cl.SentimentClassifier:
    """Gather all usable labeled files, train, save."""
    files = training_paths(spark, explicit, configured, processed_dir)
    model = cl.train_from_frame(cut_lineage(training_corpus(spark, files)))
    model.save(model_path)
    return model


def run_report(
    store: PostStore, run_id: int, granularity: str = "hourly", model_path: str | None = None
) -> dict[str, DataFrame]:
    """Everything shown for one run, as lazy frames; empty when the run is unknown."""
    spark = store.spark
    runs = store.runs()
    details = state.run_details(runs, run_id)
    found = details.select("processed_export_path").first()
    if found is None:
        return {}
    tweets, links = store.tweets(), store.links()
    sources = ranking.source_breakdown_frame(
        ranking.source_breakdown(tweets, links, run_id, limit=20)
    )
    report = {
        "details": details,
        "summary": summary.run_summary(tweets, links, run_id),
        "series": series.trend(tweets, links, granularity, run_id).orderBy("period"),
        "distribution": summary.distribution_frame(
            summary.sentiment_distribution(tweets, links, run_id)
        ),
        "sources": sources,
        "source_chart": ranking.source_chart_feed(sources),
        "recent": ranking.recent_posts(tweets, links, run_id, limit=100),
        "history": state.run_history(state.recent_runs(runs, 25)),
        "export_preview": exports.read_export(spark, found["processed_export_path"]),
    }
    if model_path is not None:
        report["candidates"] = cl.candidate_scores(cl.load_metadata(spark, model_path), spark)
    return report
