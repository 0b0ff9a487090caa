"""Rewriting of history over manifests (version, chunk place, chunk_hash) and the pool of chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def live_chunks(manifest: DataFrame, kept: DataFrame, v: str = "v") -> DataFrame:
    """Digests that kept versions refer to."""
    return manifest.join(kept.select(v), v, "left_semi").select("chunk_hash").distinct()


def reclaimed(manifest: DataFrame, kept: DataFrame, v: str = "v") -> DataFrame:
    """Digests that no kept version refers to any more."""
    return manifest.select("chunk_hash").distinct().join(live_chunks(manifest, kept, v), "chunk_hash", "left_anti")


def sweep(pool: DataFrame, live: DataFrame) -> DataFrame:
    """The pool without chunks that nothing refers to."""
    return pool.join(live, "chunk_hash", "left_semi")


def storage(manifest: DataFrame, size: Column) -> DataFrame:
    """refs, unique chunks, logical and stored cells over all versions; each digest's size counts once as stored."""
    one = manifest.groupBy("chunk_hash").agg(F.count("*").alias("refs"), F.max(size).alias("n"))
    return one.agg(F.sum("refs").alias("refs"), F.count("*").alias("chunks"), F.sum(F.col("refs") * F.col("n")).alias("logical_cells"), F.sum("n").alias("stored_cells"))


def replay(cells: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All versions' cells (v, d0, ..., val) with a change made to every version at once, as one plan."""
    return change(cells)


def check_digests(chunks_df: DataFrame, digest: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Chunks whose stored digest is not that of their cells: stored and found."""
    again = digest(chunks_df.withColumnRenamed("chunk_hash", "stored"))
    return again.where(F.col("stored") != F.col("chunk_hash")).withColumnRenamed("chunk_hash", "found")
