"""Transaction mixes for benchmarks, made from a seed: how many rows a version changes, inserts, deletes and appends.

The mixes follow the prose of the published workloads: real changes in every transaction, mostly to recent rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.operators import mutate
from chunkloom.sources.store import VersionStore

#: Exponent by which changes favour recent rows: a position is n * u ** (1 / RECENT) for u even in (0, 1).
RECENT = 20


@dataclass(frozen=True)
class Mix:
    """Rows at the start, and what each transaction does."""

    rows: int
    changes: int
    inserts: int
    deletes: int
    appends: int


MIXES = {
    "large_fraction_changes_sparse": Mix(5000, 1000, 10, 10, 10),
    "small_fraction_changes_sparse": Mix(5000, 10, 10, 10, 10),
    "large_fraction_constant_sparse": Mix(5000, 1000, 0, 0, 0),
    "mostly_appends_sparse": Mix(1000, 10, 10, 10, 1000),
    "mostly_appends_dense": Mix(900, 10, 0, 0, 30),
}


def _draws(spark: SparkSession, count: int, n: int, seed: int) -> DataFrame:
    """count positions below n, most of them late, each once (so perhaps a few less)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) + 1) / float(1 << 30)
    return spark.range(count).select(F.least(F.floor(n * F.pow(u, 1.0 / RECENT)), F.lit(n - 1)).cast("long").alias("d0")).distinct()


def start(spark: SparkSession, mix: Mix, seed: int) -> DataFrame:
    """d0, val of the first version."""
    return spark.range(mix.rows).select(F.col("id").alias("d0"), (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1000)) / 1000).alias("val"))


def transaction(cells: DataFrame, mix: Mix, n: int, seed: int) -> tuple[DataFrame, int]:
    """The next version's cells and their number."""
    spark = cells.sparkSession
    value = (F.pmod(F.xxhash64(F.lit(seed), "d0"), F.lit(1000)) / 1000).alias("val")
    out = mutate.overlay(cells, _draws(spark, mix.changes, n, seed).select("d0", value))
    if mix.deletes:
        out, n = mutate.delete_rows(out, n // 2, n // 2 + mix.deletes), n - mix.deletes
    if mix.inserts:
        out = mutate.insert_rows(out, spark.range(mix.inserts).select(F.col("id").alias("d0")).select("d0", value), n // 3, mix.inserts)
        n += mix.inserts
    if mix.appends:
        out, n = mutate.append_rows(out, spark.range(mix.appends).select(F.col("id").alias("d0")).select("d0", value), n), n + mix.appends
    return out, n


def run(store: VersionStore, name: str, transactions: int, chunk: int = 4096, seed: int = 1) -> None:
    """Commit the first version of a mix and so many transactions, each from what the store holds."""
    mix = MIXES[name]
    with store.stage("t0") as s:
        s.put(name, start(store.spark, mix, seed), (mix.rows,), chunks=(chunk,))
    for i in range(1, transactions + 1):
        last = store[0][name]
        cells, n = transaction(last.cells(), mix, len(last), seed + i)
        with store.stage(f"t{i}") as s:
            s.put(name, cells, (n,))
