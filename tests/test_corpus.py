"""What a corpus says of its sources."""

from __future__ import annotations

from posttide.checks import corpus


def test_provenance_names_its_sources(spark, tmp_path):
    texts = [(i, f"text {i}", "de" if i < 2 else "en", f"src{i}", 100) for i in range(4)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 0, 1) for i in range(4)], "doc_id long, toxic int, quality int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    row = corpus.QUERIES["corpus_provenance"](spark, str(tmp_path)).first()
    assert (row["deduplicated_examples"], row["support_sum"]) == (4, 6)
    assert row["source_paths"] == "export.csv,manual.csv"
    assert row["source_kinds"] == "manual_labels,processed_export"
