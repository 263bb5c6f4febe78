"""Stored tables, read column-pruned and spread over the available cores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows only when the input has fewer splits than there are cores.

    Text work is bound by CPU; a small file in one split would keep it on one
    core. Inputs of many splits pass through unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A stored table, optionally cut to the columns that are needed."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows
