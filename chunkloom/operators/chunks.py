"""Cells to chunks and back, chunk grids, digests and deduplication.

An array of n axes is a frame of cells (d0, ..., val). Its chunks are rows (c0, ..., extent, cells), cells being in
row-major order and trimmed at the array's edges; a chunk that is missing holds the fill value everywhere.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.functions.hashing import exact_digest, portable_digest


def filler(fill, kind: str) -> Column:
    """A fill value as a column of a Spark type; dicts are of structs, and other types than JSON's are given as text."""
    return F.from_json(F.lit(json.dumps(fill)), kind) if isinstance(fill, dict) else F.lit(fill).cast(kind)


def names(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{k}" for k in range(n)]


def div(a: Column, b: int | Column) -> Column:
    """Whole quotient of a non-negative integer."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, b)


def chunk_of(d: Column, size: int) -> Column:
    """Number of the chunk that holds a coordinate."""
    return div(d, size).cast("long")


def extent_of(shape: Sequence[int], chunks: Sequence[int]) -> Column:
    """Extent of the chunk c0, c1, ...: the chunk shape, cut at the array's edge."""
    return F.array(*[F.least(F.lit(c), F.lit(n) - F.col(f"c{k}") * c).cast("int") for k, (n, c) in enumerate(zip(shape, chunks, strict=True))])


def _place(shape: Sequence[int], chunks: Sequence[int]) -> Column:
    """Row-major place of cell d0, d1, ... within its chunk's extent."""
    at = F.lit(0).cast("long")
    for k, (n, c) in enumerate(zip(shape, chunks, strict=True)):
        wide = F.least(F.lit(c), F.lit(n) - F.col(f"c{k}") * c)
        at = at * wide + (F.col(f"d{k}") - F.col(f"c{k}") * c)
    return at.cast("int")


def chunk_cells(cells: DataFrame, shape: Sequence[int], chunks: Sequence[int], fill=0, keep_fill: bool = False) -> DataFrame:
    """Rows c0, ..., extent, cells of an array's chunks, from its cells; cells that are not given hold fill.

    Only chunks with a given cell come up. One whose cells all hold fill is left out unless keep_fill is set. A chunk has
    a bounded number of cells, so a group of the aggregate is bounded too, and is put in order once: the cost of a chunk
    grows as its cells and their sort. Coordinates must be within the shape, once each.
    """
    n, kind = len(shape), dict(cells.dtypes)["val"]
    c = names("c", n)
    placed = cells.withColumns({f"c{k}": chunk_of(F.col(f"d{k}"), chunks[k]) for k in range(n)})
    grouped = placed.groupBy(*c).agg(F.collect_list(F.struct(_place(shape, chunks).alias("p"), F.struct(F.col("val").alias("v")).alias("x"))).alias("given"))
    extent = extent_of(shape, chunks)
    size = F.aggregate(extent, F.lit(1), lambda a, x: a * x)
    blank = F.struct(filler(fill, kind).alias("v"))
    missing = F.array_except(F.sequence(F.lit(0), size - 1), F.transform("given", lambda x: x["p"]))
    filled = F.when(F.size("given") == size, F.col("given")).otherwise(F.concat("given", F.transform(missing, lambda p: F.struct(p.alias("p"), blank.alias("x")))))
    full = F.transform(F.sort_array(filled), lambda x: x["x"]["v"])
    out = grouped.select(*c, extent.alias("extent"), full.alias("cells"))
    return out if keep_fill else out.where(F.exists("cells", lambda x: ~x.eqNullSafe(filler(fill, kind))))


def assemble(chunks_df: DataFrame, chunks: Sequence[int]) -> DataFrame:
    """Cells d0, ..., val of chunk rows."""
    n = len(chunks)
    flat = chunks_df.select(*names("c", n), "extent", F.posexplode("cells").alias("p", "val"))
    rest, coords = F.col("p").cast("long"), []
    for k in reversed(range(n)):
        wide = F.element_at("extent", k + 1)
        coords.append((F.col(f"c{k}") * chunks[k] + rest % wide).cast("long").alias(f"d{k}"))
        rest = div(rest, wide)
    return flat.select(*reversed(coords), "val")


def grid(spark: SparkSession, shape: Sequence[int], chunks: Sequence[int], only: Column | None = None) -> DataFrame:
    """c0, ..., extent of all chunks of an array, or of those that `only` takes; made from one range, without a product."""
    counts = [-(-n // c) for n, c in zip(shape, chunks, strict=True)]
    rest, coords = F.col("id"), {}
    for k in reversed(range(len(shape))):
        coords[f"c{k}"] = rest % counts[k] if counts[k] else rest
        rest = div(rest, max(1, counts[k]))
    out = spark.range(reduce(lambda a, b: a * b, counts, 1)).select(*[coords[f"c{k}"].cast("long").alias(f"c{k}") for k in range(len(shape))])
    return (out if only is None else out.where(only)).withColumn("extent", extent_of(shape, chunks))


def dense_cells(cells: DataFrame, shape: Sequence[int], fill=0) -> DataFrame:
    """All cells of an array, those that are not given with fill. For shapes that one means to have in full."""
    n, kind = len(shape), dict(cells.dtypes)["val"]
    every = grid(cells.sparkSession, shape, [1] * n).select(*[F.col(f"c{k}").alias(f"d{k}") for k in range(n)])
    return every.join(cells.withColumn("_in", F.lit(True)), names("d", n), "left").select(*names("d", n), F.when(F.col("_in"), F.col("val")).otherwise(filler(fill, kind)).alias("val"))


def hash_chunks(chunks_df: DataFrame, exact: bool = False) -> DataFrame:
    """Chunk rows with chunk_hash: over raw bytes, or over text that other engines can reproduce."""
    kind = dict(chunks_df.dtypes)["cells"].removeprefix("array<").removesuffix(">")
    digest = exact_digest if exact else portable_digest
    return chunks_df.withColumn("chunk_hash", digest(F.col("cells"), F.col("extent"), kind))


def dedup(found: DataFrame, by: str = "chunk_hash", order: Sequence[str] = ("origin",)) -> DataFrame:
    """The first row of each digest in the given order, which must be total for the result to be certain."""
    return found.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("_n = 1").drop("_n")


def unknown(found: DataFrame, known: DataFrame, by: str = "chunk_hash") -> DataFrame:
    """Rows whose digest is not known yet."""
    return found.join(known.select(by), by, "left_anti")


def reused(found: DataFrame, known: DataFrame, by: str = "chunk_hash") -> DataFrame:
    """Rows whose digest is known."""
    return found.join(known.select(by), by, "left_semi")


def hits_by_chunk(cells: DataFrame, shape: Sequence[int], chunks: Sequence[int]) -> DataFrame:
    """c0, ..., hits (distinct cells) and whole (whether they are all of the chunk) for the cells of a selection."""
    n = len(shape)
    c = names("c", n)
    placed = cells.select(*names("d", n)).distinct().withColumns({f"c{k}": chunk_of(F.col(f"d{k}"), chunks[k]) for k in range(n)})
    size = F.aggregate(extent_of(shape, chunks), F.lit(1), lambda a, x: a * x)
    return placed.groupBy(*c).agg(F.count("*").alias("hits")).withColumn("whole", F.col("hits") == size)
