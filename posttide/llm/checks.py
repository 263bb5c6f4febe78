"""The operators of this subpackage as named queries over the driver's tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from posttide.llm import (
    html_text,
    line_dedup,
    mixing,
    ngram_join,
    packing,
    periodic,
    quality,
    search,
    sharding,
    suffixes,
    token_files,
    toxicity,
    whitening,
)
from posttide.llm.common import scratch, table


def _html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def _mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).drop("source")


def _quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels", "doc_id", "quality")).drop("score")


def _sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents", "doc_id", "text"))


def _packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _token_files(spark, sf_dir):
    folder = scratch(spark, "tokens")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    token_files.write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_tokens(spark, folder)


def _toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxic_score").alias("score"),
        F.col("toxic").alias("predicted"),
    )


def _search(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search.top_k(vectors, F.col("vec_id") % 20 == 0)


def _suffixes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return suffixes.deduplicate(docs).drop("text", "kept")


def _ngram_join(spark, sf_dir):
    return ngram_join.link(table(spark, sf_dir, "documents", "doc_id", "text"))


def _whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _periodic(spark, sf_dir):
    return periodic.find_runs(table(spark, sf_dir, "documents", "doc_id", "text")).drop("collapsed")


def _line_dedup(spark, sf_dir):
    return line_dedup.deduplicate(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")


QUERIES = {
    "op1_html_text": _html_text,
    "op2_packing": _packing,
    "op3_mixing": _mixing,
    "op4_toxicity": _toxicity,
    "op5_ngram_join": _ngram_join,
    "op6_search": _search,
    "op7_token_files": _token_files,
    "op8_quality": _quality,
    "op9_suffixes": _suffixes,
    "op10_sharding": _sharding,
    "op11_whitening": _whitening,
    "op12_periodic_runs": _periodic,
    "op13_line_dedup": _line_dedup,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op6_search": """
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(
    list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM parts q JOIN parts d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id
),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op13_line_dedup": """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM documents
),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
owners AS (
  SELECT key, min(doc_id) AS low FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)
),
judged AS (
  SELECT k.doc_id, k.line, k.line_no, o.low IS NOT NULL AND o.low <> k.doc_id AS gone
  FROM keyed k LEFT JOIN owners o ON k.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count_if(gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""",
}
