"""Sums over each text's words of numbers from a table that is too large to send to every task.

A scan numbers words. Frequent ones have numbers beforehand, and whatever is to be known of them travels with the scan: a
word is frequent if it has a given share of all words, so there are at most as many as the share's inverse. All others
are left to a join. Texts are taken in blocks, and within a block each distinct word becomes one row: its 64-bit hash,
the block, and the texts of the block that hold it, once an occurrence. Rows meet the table by hash, so no key has more
rows than there are blocks; then they meet by block, and are added up for each text.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import settle

#: A word is frequent if it has this share of all words.
SHARE = 1 / 1_000_000
#: A block ends with the text that brings it to so many characters, or so many distinct words that are not frequent.
BLOCK_CHARS, BLOCK_WORDS = 32_000_000, 600_000
#: Texts of a block, at most; a text's number is its block's times this, and its place.
TEXTS = 1 << 20

SCHEMA = "h long, block long, texts array<int>"


class Numbers(dict):
    """Words to numbers: 0 is kept for the caller, then the frequent words in their order, then others as they come."""

    def __init__(self, frequent: list[bytes]):
        super().__init__(zip(frequent, range(1, len(frequent) + 1), strict=True))
        self.first, self.added = len(frequent) + 1, []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.first + len(self.added)
        self.added.append(word)
        return n

    def forget(self) -> None:
        """Drop the words that are not frequent."""
        for w in self.added:
            del self[w]
        self.added = []


class Blocks:
    """The blocks of one task, one after another."""

    def __init__(self, frequent: list[bytes]):
        self.numbers = Numbers(frequent)
        self.block, self.texts, self.chars, self.rare, self.where = TaskContext.get().partitionId() << 19, 0, 0, [], []

    def add(self, ids: np.ndarray, sizes: np.ndarray, chars: int) -> np.ndarray:
        """Take texts in, given the numbers of all their words and how many each has; the texts' own numbers."""
        n = len(sizes)
        uid = np.arange(self.texts, self.texts + n) + self.block * TEXTS
        at = np.flatnonzero(ids >= self.numbers.first)
        self.rare.append((ids[at] - self.numbers.first).astype(np.int32))
        self.where.append((np.repeat(np.arange(self.texts, self.texts + n, dtype=np.int32), sizes))[at])
        self.texts, self.chars = self.texts + n, self.chars + chars
        return uid

    @property
    def full(self) -> bool:
        return self.chars >= BLOCK_CHARS or len(self.numbers.added) >= BLOCK_WORDS or self.texts >= TEXTS // 2

    def rows(self):
        """h, block, texts of the block's words as Arrow arrays; the next block begins."""
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        words = self.numbers.added
        rare = np.concatenate([*self.rare, np.empty(0, np.int32)])
        where = np.concatenate([*self.where, np.empty(0, np.int32)])[np.argsort(rare, kind="stable")]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(rare, minlength=len(words)))]).astype(np.int32)
        hashes = np.fromiter((xxh64_intdigest(w, 42) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)
        out = pa.array(hashes), pa.array(np.full(len(words), self.block)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(where))
        self.numbers.forget()
        self.block, self.texts, self.chars, self.rare, self.where = self.block + 1, 0, 0, [], []
        return out


def sums(rare: DataFrame, table: DataFrame, width: int, used: list[DataFrame] | None = None) -> DataFrame:
    """uid, sums (so many) for texts with rows in rare, of x in table (h, x: array of so many numbers); words without x add nothing.

    Of the tables settled meanwhile, those that the result reads are put into used.
    """

    def add(parts):
        import pyarrow as pa

        uids, totals, held = [], [], 0

        def packed():
            uid, back = np.unique(np.concatenate(uids), return_inverse=True)
            x = np.concatenate(totals)
            return uid, np.stack([np.bincount(back, weights=x[:, k], minlength=len(uid)) for k in range(width)], axis=1)

        for part in parts:
            texts = part.column("texts")
            many = np.diff(texts.offsets.to_numpy())
            uid = np.repeat(part.column("block").to_numpy() * TEXTS, many) + texts.flatten().to_numpy()
            x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(part), width)
            uids.append(uid)
            totals.append(np.repeat(x, many, axis=0))
            held += len(uid)
            if held > 1_000_000:
                u, t = packed()
                uids, totals, held = [u], [t], 0
        if uids:
            u, t = packed()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, width * len(u) + 1, width, dtype=np.int32)), pa.array(t.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(u), lists], ["uid", "sums"])

    met = settle(rare.join(table.select("h", "x"), "h").select("block", "texts", "x"), "met")
    if used is not None:
        used.append(met)
    return met.repartition("block").mapInArrow(add, "uid long, sums array<double>")


def hashed(word: str):
    """The hash of a string column, as in `Blocks`."""
    return F.xxhash64(word)
