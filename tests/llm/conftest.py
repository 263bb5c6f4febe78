from __future__ import annotations

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source); other columns as asked."""

    def make(rows, **extra):
        full = [
            (r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *extra.values()) for r in rows
        ]
        schema = T.StructType(DOCS.fields + [T.StructField(k, T.StringType()) for k in extra])
        return spark.createDataFrame(full, schema)

    return make
