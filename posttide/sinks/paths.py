"""Folder listings through Hadoop's file system API, for any storage Spark can read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Entry:
    path: str
    name: str
    modified: int
    is_dir: bool


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = _fs(spark, path)
    return fs.exists(hadoop_path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    fs, hadoop_path = _fs(spark, path)
    fs.delete(hadoop_path, True)


def entries(spark: SparkSession, folder: str) -> list[Entry]:
    """Direct children of a folder; none when it does not exist."""
    fs, hadoop_path = _fs(spark, folder)
    if not fs.exists(hadoop_path):
        return []
    return [
        Entry(
            status.getPath().toString(),
            status.getPath().getName(),
            status.getModificationTime(),
            status.isDirectory(),
        )
        for status in fs.listStatus(hadoop_path)
    ]


def resolve(spark: SparkSession, path: str) -> str:
    """Fully qualified form of ``path``."""
    fs, hadoop_path = _fs(spark, path)
    return hadoop_path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()
