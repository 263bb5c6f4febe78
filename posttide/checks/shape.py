"""Output shape shared by the checked queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finish(df: DataFrame, digits: int = 12) -> DataFrame:
    """Round doubles and drop the zone of timestamps, so both engines agree on types."""
    changed = {}
    for field in df.schema.fields:
        if isinstance(field.dataType, T.DoubleType):
            changed[field.name] = F.round(F.col(field.name), digits)
        elif isinstance(field.dataType, T.TimestampType):
            changed[field.name] = F.col(field.name).cast("timestamp_ntz")
    return df.withColumns(changed) if changed else df
