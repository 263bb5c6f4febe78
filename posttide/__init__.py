"""Sentiment analytics over short social posts and headlines, as Spark jobs."""
