"""Sharding: a keyed Feistel permutation over global row numbers, so that a shuffle needs no sort by random keys.

Row r of n goes to place p = permute(r), shard p mod k and slot p div k. Anyone who knows n, k and the seed can
compute where a row went, and which row lies at a shard and slot, without a lookup. Shards differ by one row at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import numbered

ROUNDS = 8
_U = np.uint64


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit finaliser (multiply and shift), used as the round function."""
    with np.errstate(over="ignore"):
        x = (x + _U(key)) * _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(32)
        x *= _U(0xD6E8FEB86659FD93)
        return x ^ (x >> _U(29))


def _keys(seed: int) -> list[int]:
    return [int(_mix(np.array([seed & (2**64 - 1)], dtype=_U), i + 1)[0]) for i in range(ROUNDS)]


def _bits(n: int) -> tuple[int, int]:
    width = max(2, int(n - 1).bit_length())
    return width - width // 2, width // 2


def _forward(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    a, b = _bits(n)  # widths of the two halves, which swap every round
    left, right, wide, low = x >> _U(b), x & _U((1 << b) - 1), a, b
    for key in keys:
        left, right = right, left ^ (_mix(right, key) & _U((1 << wide) - 1))
        wide, low = low, wide
    return (left << _U(low)) | right


def _backward(x: np.ndarray, n: int, keys: list[int]) -> np.ndarray:
    a, b = _bits(n)
    left, right, wide, low = x >> _U(b), x & _U((1 << b) - 1), a, b
    for key in reversed(keys):
        left, right = right ^ (_mix(left, key) & _U((1 << low) - 1)), left
        wide, low = low, wide
    return (left << _U(b)) | right


def _walk(step, rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Cycle walking: repeat the step on values that fell outside 0..n-1; the domain is under 2n, or 4 for tiny n."""
    keys, out = _keys(seed), step(np.asarray(rows).astype(_U), n, _keys(seed))
    while (outside := np.flatnonzero(out >= _U(n))).size:
        out[outside] = step(out[outside], n, keys)
    return out.astype(np.int64)


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of the given row numbers (0..n-1) in a seeded permutation of n rows."""
    return _walk(_forward, rows, n, seed)


def unpermute(places: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Row numbers at the given places."""
    return _walk(_backward, places, n, seed)


def locate(rows: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of each row number."""
    places = permute(rows, n, seed)
    return places % shards, places // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """Row numbers at the given shards and slots."""
    return unpermute(np.asarray(slot) * shards + np.asarray(shard), n, seed)


def assign(df: DataFrame, order: list[str], shards: int, seed: int) -> DataFrame:
    """df with row_number (in the given order), shard and slot; df should hold no large columns.

    Null order values come first; rows equal in every order column are interchangeable. An empty table stays empty.
    """
    rows, n = numbered(df, order, "rows")

    @F.pandas_udf("long")
    def place(r):
        import pandas as pd

        return pd.Series(permute(r.to_numpy(), n, seed))

    if not n:
        return rows.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    placed = rows.withColumn("_place", place("row_number"))
    return placed.withColumns({"shard": (F.col("_place") % shards).cast("int"), "slot": F.expr(f"_place div {shards}")}).drop("_place")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 20240607, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document.

    size is UTF-8 bytes plus 1. Null and empty texts have size 1 and checksum 0. The law is `rows`: shard counts are
    at most one apart. Rows are numbered by id, then checksum, then size, so ties between repeated rows don't matter.
    Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = assign(slim, ["doc_id", "text_crc32", "size"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, seed: int = 20240607, id_col: str = "doc_id") -> None:
    """Write one folder for each shard, rows in slot order. Ids must be unique: rows are matched to places by id."""
    placed = assign(docs.select(F.col(id_col).alias("_id")), ["_id"], shards, seed).select("_id", F.col("shard").alias("_shard"), "slot")
    out = docs.join(placed, F.col(id_col).eqNullSafe(F.col("_id"))).drop("_id")
    out.repartition(shards, "_shard").sortWithinPartitions("_shard", "slot").write.partitionBy("_shard").parquet(path)


__all__ = ["assign", "locate", "permute", "row_at", "shard_documents", "unpermute", "write_shards"]
