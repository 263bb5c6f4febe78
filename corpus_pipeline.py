"""Raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir). ``docs`` has the columns of ``documents``, and so
has what every stage but the last returns. Stages are written as Parquet and read again, so a lost
executor or a failed stage never costs the stages before it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posttide.llm import mixing, ngram_join, packing, suffixes, toxicity
from posttide.llm.common import stored, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scan rejects go; all others stay as they are."""
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.75, the one with the smallest id stays."""
    return ngram_join.first_of_each(docs)


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars``, where there is one, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text covered by strings of 200 bytes that occur twice goes; no document goes."""
    return _with_length(suffixes.without_repeats(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row for each time a document is taken, the last one cut at its word."""
    return _with_length(mixing.mixed_documents(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_copies", one_of_near_copies),
    ("repeats", remove_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Models, connected components and packing rounds are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
