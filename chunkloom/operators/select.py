"""Selections that data decides: boolean masks and ranks, without one task seeing all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.operators.chunks import div

#: Coordinates in a stretch of the axis; ranks are taken within stretches, and only their counts are summed across.
STRETCH = 65_536


def ranked(cells: DataFrame, d: str = "d0", rank: str = "o0") -> DataFrame:
    """cells with the rank (from 0) of their coordinate, which must be distinct and not negative."""
    at = cells.withColumn("_s", div(F.col(d), STRETCH))
    counts = at.groupBy("_s").agg(F.count("*").alias("_n"))
    before = counts.select("_s", F.coalesce(F.sum("_n").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_s").orderBy(d)) - 1
    return at.join(before, "_s").withColumn(rank, (F.col("_before") + inner).cast("long")).drop("_s", "_before")


def masked(cells: DataFrame, mask: DataFrame, d: str = "d0") -> DataFrame:
    """o0, val of the cells whose coordinate has a true mask (d0, on), packed together."""
    return ranked(cells.join(mask.where("on").select(d), d, "left_semi"), d).select("o0", "val")
