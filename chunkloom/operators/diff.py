"""Differences of two versions, by chunk and by cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _kind(before: Column, after: Column) -> Column:
    return F.when(before.isNull(), "added").when(after.isNull(), "deleted").otherwise("modified")


def chunk_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], digest: str = "chunk_hash") -> DataFrame:
    """keys, change, old_hash, new_hash of chunks that differ.

    The extent should be among the keys: a chunk never matches one of another extent, so a resized edge is a deletion
    and an addition. Chunks that hold fill have no rows, so data written over fill is added and the other way deleted.
    """
    a, b = old.select(*keys, F.col(digest).alias("old_hash")), new.select(*keys, F.col(digest).alias("new_hash"))
    both = a.join(b, list(keys), "full").where(~F.col("old_hash").eqNullSafe(F.col("new_hash")))
    return both.withColumn("change", _kind(F.col("old_hash"), F.col("new_hash"))).select(*keys, "change", "old_hash", "new_hash")


def cell_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, change, old_val, new_val of cells that differ."""
    a = old.select(*keys, F.col("val").alias("old_val"), F.lit(1).alias("_a"))
    b = new.select(*keys, F.col("val").alias("new_val"), F.lit(1).alias("_b"))
    both = a.join(b, list(keys), "full").where(F.col("_a").isNull() | F.col("_b").isNull() | ~F.col("old_val").eqNullSafe(F.col("new_val")))
    return both.withColumn("change", _kind(F.col("_a"), F.col("_b"))).select(*keys, "change", "old_val", "new_val")
