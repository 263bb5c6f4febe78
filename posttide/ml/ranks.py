"""Exact positions in a group without bringing the group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from posttide.session import lookup_side

# Slices of each group. Their number is fixed, so that a row's slice, and with it the order, depends
# on the row alone and not on how many others there are.
_SLICES = 1024


def with_position(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    spread: list[str],
    name: str,
    groups: int,
) -> DataFrame:
    """Add the 0-based position of each row in its group.

    Rows are cut into hash slices; a row's position is its rank in its slice plus the
    sizes of the slices before it. The order is therefore by slice first, which is
    arbitrary but fixed by the ``spread`` columns. ``groups`` is the (known) number
    of groups.
    """
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*spread), F.lit(_SLICES)))
    keys = [*group, "_slice"]
    before = W.partitionBy(*group).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = sliced.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    offsets = sizes.select(
        *keys, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset")
    )
    ranked = sliced.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    placed = ranked.join(lookup_side(offsets, _SLICES * groups), keys)
    return placed.withColumn(name, F.col("_offset") + F.col("_rank") - 1).drop(
        "_slice", "_rank", "_offset"
    )
