"""Edits of arrays as plans over cells (d0, ..., val): overlays, resizing, shifting, casting and new chunk grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.operators.chunks import chunk_cells, chunk_of, names


def _axes(cells: DataFrame) -> int:
    return sum(1 for c in cells.columns if c[0] == "d" and c[1:].isdigit())


def last_writes(edits: DataFrame, order: Sequence[str]) -> DataFrame:
    """d0, ..., val of the last edit of each cell, in the given order."""
    return edits.groupBy(*names("d", _axes(edits))).agg(F.max_by("val", F.struct(*order)).alias("val"))


def overlay(base: DataFrame, staged: DataFrame) -> DataFrame:
    """base with the cells that staged holds replaced; staged cells outside base are not added."""
    d = names("d", _axes(base))
    return base.join(staged.select(*d, F.col("val").alias("_new"), F.lit(True).alias("_set")), d, "left").select(*d, F.when(F.col("_set"), F.col("_new")).otherwise(F.col("val")).alias("val"))


def merge(base: DataFrame, staged: DataFrame) -> DataFrame:
    """The union of two sparse arrays, staged cells winning."""
    d = names("d", _axes(base))
    both = base.select(*d, F.lit(0).alias("_o"), "val").unionByName(staged.select(*d, F.lit(1).alias("_o"), "val"))
    return both.groupBy(*d).agg(F.max_by("val", "_o").alias("val"))


def set_whole_chunks(base: DataFrame, staged: DataFrame, chunks: Sequence[int], whole: Column) -> DataFrame:
    """Like overlay where `whole` (a predicate on c0, ...) tells which chunks staged covers: those are never read from base."""
    n = _axes(base)
    at = {f"c{k}": chunk_of(F.col(f"d{k}"), chunks[k]) for k in range(n)}
    rest = overlay(base.withColumns(at).where(~whole).select(*names("d", n), "val"), staged)
    return rest.unionByName(staged.withColumns(at).where(whole).select(*names("d", n), "val"))


def set_where(base: DataFrame, selected: Column, value: Column) -> DataFrame:
    """One value for all selected cells."""
    return base.withColumn("val", F.when(selected, value).otherwise(F.col("val")))


def resize(cells: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Stored cells of the array at its new shape: cells beyond it go; new ones hold fill, so they need no rows."""
    inside = F.lit(True)
    for k, n in enumerate(shape):
        inside = inside & (F.col(f"d{k}") < n)
    return cells.where(inside)


def append_rows(cells: DataFrame, rows: DataFrame, at: int) -> DataFrame:
    """rows (d0 from 0) put behind the first `at` rows."""
    return cells.unionByName(rows.withColumn("d0", F.col("d0") + at))


def insert_rows(cells: DataFrame, rows: DataFrame, before: int, count: int) -> DataFrame:
    """count rows (d0 from 0) put before position `before`; what follows moves up."""
    moved = cells.withColumn("d0", F.when(F.col("d0") >= before, F.col("d0") + count).otherwise(F.col("d0")))
    return moved.unionByName(rows.withColumn("d0", F.col("d0") + before))


def delete_rows(cells: DataFrame, start: int, stop: int) -> DataFrame:
    """Positions start to stop - 1 taken out; what follows moves down."""
    kept = cells.where(~F.col("d0").between(start, stop - 1))
    return kept.withColumn("d0", F.when(F.col("d0") >= stop, F.col("d0") - (stop - start)).otherwise(F.col("d0")))


def axis_union(old: DataFrame, new: DataFrame, label: str = "label") -> DataFrame:
    """Labels of both with their place (d0) in sorted order: the axis onto which both arrays are scattered.

    The window runs over distinct labels, which are an axis and not data.
    """
    every = old.select(label).union(new.select(label)).distinct()
    return every.withColumn("d0", (F.row_number().over(Window.orderBy(label)) - 1).cast("long"))


def scatter(cells: DataFrame, axis: DataFrame, label: str = "label", d: str = "d0") -> DataFrame:
    """cells that carry a label, at its place on the axis."""
    return cells.drop(d).join(axis.withColumnRenamed("d0", d), label).drop(label)


def astype(cells: DataFrame, kind: str) -> DataFrame:
    """Values cast to a Spark type; a value that does not fit raises under ANSI rules."""
    return cells.withColumn("val", F.col("val").cast(kind))


def refill(cells: DataFrame, old, new) -> DataFrame:
    """Cells equal to the old fill value get the new one, whether they were stored or not."""
    kind = dict(cells.dtypes)["val"]
    return cells.withColumn("val", F.when(F.col("val").eqNullSafe(F.lit(old).cast(kind)), F.lit(new).cast(kind)).otherwise(F.col("val")))


def rechunk(cells: DataFrame, shape: Sequence[int], chunks: Sequence[int], fill=0) -> DataFrame:
    """Chunk rows on a new grid."""
    return chunk_cells(cells, shape, chunks, fill)


def changes(base: DataFrame, staged: DataFrame, c: Sequence[str]) -> DataFrame:
    """Chunk rows that are not fill, with origin: staged, or base where nothing is staged."""
    rest = base.join(staged.select(*c), list(c), "left_anti")
    return rest.withColumn("origin", F.lit("base")).unionByName(staged.withColumn("origin", F.lit("staged")))
