"""Labeled rows, corpus merge and its totals, from ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posttide import testviews as v
from posttide.checks.shape import finish
from posttide.checks.text import sql_key
from posttide.operators import corpus
from posttide.session import working_folder, written
from posttide.sources.labeled import labeled_frames, training_paths


def labeled(spark, sf_dir, source: str) -> DataFrame:
    """Labeled documents as a manual or a processed table."""
    docs = v.texts(spark, sf_dir, "documents", "doc_id", "text", "lang", "source", "n_chars")
    rows = docs.join(v.table(spark, sf_dir, "labels"), "doc_id")
    label = (
        F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "mixed")
        .when(F.col("toxic") == 1, "neg")
        .when(F.col("quality") == 1, " Positive ")
        .otherwise("NEU")
    )
    if source == "manual":
        return rows.filter(F.col("lang") != "en").select("doc_id", "text", label.alias("label"))
    confidence = F.when(F.col("source") == "src3", F.lit("nan")).otherwise(
        ((F.col("n_chars") % 120) / 100.0).cast("string")
    )
    return rows.select(
        "doc_id",
        F.replace("text", F.lit(" "), F.lit("  ")).alias("cleaned_text"),
        label.alias("sentiment_label"),
        confidence.alias("sentiment_confidence"),
        F.when(F.col("source") != "src5", (F.col("doc_id") % 41 - 20) / 16.0).alias(
            "sentiment_score"
        ),
    )


def frames(spark, sf_dir) -> list[DataFrame]:
    order = ["_file", "doc_id"]
    manual = labeled(spark, sf_dir, "manual").withColumn("_file", F.lit(0))
    processed = labeled(spark, sf_dir, "processed").withColumn("_file", F.lit(1))
    return [
        corpus.training_frame(manual, F.lit("manual.csv"), order),
        corpus.training_frame(processed, F.lit("export.csv"), order),
    ]


def merged(spark, sf_dir) -> DataFrame:
    return corpus.merge_frames(frames(spark, sf_dir))


def _frame(spark, sf_dir):
    rows = corpus.union_frames(frames(spark, sf_dir))
    return finish(rows.withColumn("doc_id", F.col("_order.doc_id")).drop("_order"), 9)


def _corpus(spark, sf_dir):
    rows = merged(spark, sf_dir)
    return finish(
        rows.withColumns(
            {
                "source_paths": F.array_join("source_paths", ","),
                "source_kinds": F.array_join("source_kinds", ","),
            }
        ),
        9,
    )


def _totals(spark, sf_dir):
    """Totals of the corpus, and the names of its sources."""
    rows = written(merged(spark, sf_dir))
    found = written(corpus.sources(rows))
    names = found.agg(
        *[
            F.array_join(F.sort_array(F.collect_list(F.when(F.col("what") == what, F.col("name")))), ",").alias(f"{what}s")
            for what in ("source_path", "source_kind")
        ]
    )
    totals = corpus.provenance(rows, found).drop("source_paths", "source_kinds")
    return totals.crossJoin(F.broadcast(names))  # one row on each side


def _sources(spark, sf_dir):
    return corpus.sources(merged(spark, sf_dir))


def _labeled_files(spark, sf_dir):
    """The labeled tables as CSV files, a folder of parts each, next to unusable ones, read back."""
    base = working_folder(spark, "labeled")
    manual, processed = (labeled(spark, sf_dir, kind) for kind in ("manual", "processed"))
    shapes = {
        "manual.csv": manual.select("text", "label"),
        "export_a.csv": processed.filter("doc_id % 2 = 0").drop("doc_id"),
        "export_b.csv": processed.filter("doc_id % 2 = 1").drop("doc_id"),
        "other_columns.csv": manual.select("doc_id", F.col("text").alias("body")),
    }
    for name, rows in shapes.items():
        rows.write.option("header", True).option("escape", '"').csv(f"{base}/{name}")
    spark.createDataFrame([], "value string").coalesce(1).write.text(f"{base}/empty.csv")
    files = training_paths(spark, None, f"{base}/manual.csv", base)
    rows = corpus.union_frames(labeled_frames(spark, files))
    name = F.regexp_extract("source_path", "([^/]+)$", 1)
    return finish(rows.select("text", "label", "sample_weight", name.alias("source"), "source_kind"), 9)


QUERIES = {
    "training_frame": _frame,
    "training_corpus": _corpus,
    "corpus_provenance": _totals,
    "corpus_sources": _sources,
    "labeled_rows": _labeled_files,
    "corpus_label_counts": lambda spark, sf_dir: corpus.label_counts(merged(spark, sf_dir)),
    "corpus_weight_summary": lambda spark, sf_dir: finish(
        corpus.weight_summary(merged(spark, sf_dir)), 9
    ),
}

_BASE = """
base AS (
  SELECT d.doc_id, d.text, d.lang,
         CASE WHEN toxic = 1 AND quality = 0 THEN NULL WHEN toxic = 1 THEN 'negative'
              WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label,
         CASE WHEN source = 'src3' THEN 0.5 ELSE least((n_chars % 120) / 100.0, 1.0) END AS c,
         CASE WHEN source = 'src5' THEN 0.0
              ELSE least(abs((d.doc_id % 41 - 20) / 16.0), 1.0) END AS s
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
frame AS (
  SELECT 0 AS file, doc_id, text, label, CAST(3.0 AS DOUBLE) AS w,
         'manual.csv' AS source_path, 'manual_labels' AS source_kind
  FROM base WHERE lang <> 'en' AND label IS NOT NULL
  UNION ALL
  SELECT 1, doc_id, replace(text, ' ', '  '), label,
         least(greatest((0.4 + 0.9 * c) * CASE WHEN label = 'neutral' THEN 0.85 ELSE 1.1 END
               * (0.75 + 0.5 * s), 0.25), 3.0)::DOUBLE, 'export.csv', 'processed_export'
  FROM base WHERE label IS NOT NULL)"""

_STRIP = r"regexp_replace(text, '^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$', '', 'g')"

_MERGED = f"""{_BASE},
k AS (SELECT file, doc_id, {_STRIP} AS text, label, w, source_path, source_kind,
             {sql_key('text')} AS key FROM frame),
g AS (SELECT key, label, sum(CAST(w AS DECIMAL(24, 12))) AS w, count(*) AS support,
             string_agg(DISTINCT source_path, ',' ORDER BY source_path) AS source_paths,
             string_agg(DISTINCT source_kind, ',' ORDER BY source_kind) AS source_kinds
      FROM k WHERE key <> '' GROUP BY key, label),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY w DESC, support DESC, label) AS rn
      FROM g),
r AS (SELECT key, text, row_number() OVER (PARTITION BY key
             ORDER BY length(text) DESC, file, doc_id) AS rn FROM k),
merged AS (
  SELECT r.text, b.label, CAST(b.w AS DOUBLE) AS sample_weight, b.support,
         b.source_paths, b.source_kinds
  FROM b JOIN r ON r.key = b.key AND r.rn = 1 WHERE b.rn = 1)"""

SQL = {
    "training_frame": f"""WITH {_BASE}
      SELECT doc_id, {_STRIP} AS text, label, round(w, 9) AS sample_weight, source_path,
             source_kind FROM frame""",
    "training_corpus": f"""WITH {_MERGED}
      SELECT text, label, round(sample_weight, 9) AS sample_weight, support, source_paths,
             source_kinds FROM merged""",
    "corpus_provenance": f"""WITH {_MERGED}
      SELECT count(*) AS deduplicated_examples, CAST(sum(support) AS BIGINT) AS support_sum,
             (SELECT string_agg(DISTINCT p, ',' ORDER BY p) FROM
               (SELECT unnest(string_split(source_paths, ',')) AS p FROM merged)) AS source_paths,
             (SELECT string_agg(DISTINCT p, ',' ORDER BY p) FROM
               (SELECT unnest(string_split(source_kinds, ',')) AS p FROM merged)) AS source_kinds
      FROM merged""",
    "corpus_sources": f"""WITH {_MERGED}
      SELECT what, name, count(*) AS rows FROM (
        SELECT 'source_path' AS what, unnest(string_split(source_paths, ',')) AS name FROM merged
        UNION ALL SELECT 'source_kind', unnest(string_split(source_kinds, ',')) FROM merged)
      GROUP BY what, name""",
    "labeled_rows": f"""WITH {_BASE}
      SELECT {_STRIP} AS text, label, round(w, 9) AS sample_weight,
             CASE WHEN file = 0 THEN 'manual.csv' WHEN doc_id % 2 = 0 THEN 'export_a.csv'
                  ELSE 'export_b.csv' END AS source, source_kind
      FROM frame WHERE {_STRIP} <> ''""",
    "corpus_label_counts": f"WITH {_MERGED} SELECT label, count(*) AS n FROM merged GROUP BY label",
    "corpus_weight_summary": f"""WITH {_MERGED}
      SELECT round(min(sample_weight), 9) AS min, round(max(sample_weight), 9) AS max,
             round(avg(sample_weight), 9) AS mean FROM merged""",
}
