"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's words lie in seeded random document order, cut into shards and each shard into equal blocks. Blocks are the
seats: sources get theirs by highest quotient target / (2s + 1), the target counted in the source's own blocks (shorter
where it has few words), then each source's shards share its seats in the same way. Within a shard every block is taken quota div blocks times, and a seeded permutation picks those taken once more.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chunkloom.llm._common import batches, plain, settle
from chunkloom.llm.sharding import permute

BLOCK_WORDS = 64
#: Shards have about so many words; on large inputs more, so that there are at most MOST_SHARDS besides one a source.
SHARD_WORDS, MOST_SHARDS = 250_000, 20_000
WEIGHTS = (3, 1, 2)


def apportion(weights: list[float], seats: int, most: list[int]) -> list[int]:
    """Highest quotients weight / (2s + 1), with at most most[i] seats each; ties go to the earlier entry.

    Starts from the rounded shares and moves single seats, which ends at the same allocation as handing out one by one.
    """
    total = float(sum(weights))
    seats = min(seats, sum(m for w, m in zip(weights, most, strict=True) if w > 0))
    if total <= 0 or seats <= 0:
        return [0] * len(weights)
    got = [min(m, int(w * seats / total + 0.5)) if w > 0 else 0 for w, m in zip(weights, most, strict=True)]
    spare = seats - sum(got)
    gain = [(-w / (2 * s + 1), i) for i, (w, s, m) in enumerate(zip(weights, got, most, strict=True)) if w > 0 and s < m]
    heapq.heapify(gain)
    while spare > 0:
        _, i = heapq.heappop(gain)
        got[i] += 1
        spare -= 1
        if got[i] < most[i]:
            heapq.heappush(gain, (-weights[i] / (2 * got[i] + 1), i))
    loss = [(w / (2 * s - 1), -i) for i, (w, s) in enumerate(zip(weights, got, strict=True)) if s > 0]
    heapq.heapify(loss)
    while spare < 0:
        _, i = heapq.heappop(loss)
        got[-i] -= 1
        spare += 1
        if got[-i] > 0:
            heapq.heappush(loss, (weights[-i] / (2 * got[-i] - 1), i))
    return got


def targets(sizes: list[int], weights: list[float], share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted of each source: share of all words by weight, none over most times its size; excess goes on by weight."""
    out, left = [0.0] * len(sizes), share * sum(sizes)
    free = [i for i, w in enumerate(weights) if w > 0]
    while free:
        per = left / sum(weights[i] for i in free)
        full = [i for i in free if per * weights[i] > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size (words between ASCII white space; 0 for null) and the text's checksum."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("crc"), F.col(text_col).cast("string").alias("text"))

    def count(parts):
        import pyarrow as pa

        for part in parts:
            sizes = [len(t.encode().split()) for _, texts in batches(part.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), part.column("crc"), pa.array(sizes, pa.int64())], ["doc_id", "source", "crc", "size"])

    return slim.mapInArrow(count, "doc_id long, source string, crc long, size long")


def _times(begin: np.ndarray, size: np.ndarray, unit: np.ndarray, units: dict[int, tuple[int, int, int]], seed: int):
    """For each document: how often each block that it overlaps is taken, and the overlap. Returns row, words, times."""
    blocks = np.array([units[int(u)][1] for u in unit], dtype=np.int64)
    words = np.array([units[int(u)][0] for u in unit], dtype=np.int64)
    quota = np.array([units[int(u)][2] for u in unit], dtype=np.int64)
    live = np.flatnonzero(size > 0)
    # block j holds the words from floor(j * words / blocks) on
    first = ((begin[live] + 1) * blocks[live] - 1) // words[live]
    last = ((begin[live] + size[live]) * blocks[live] - 1) // words[live]
    n = last - first + 1
    row = np.repeat(live, n)
    block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    low = np.maximum(block * words[row] // blocks[row], begin[row])
    high = np.minimum((block + 1) * words[row] // blocks[row], begin[row] + size[row])
    times = quota[row] // blocks[row]
    more = quota[row] % blocks[row]
    for u in np.unique(unit[row]):
        at = np.flatnonzero((unit[row] == u) & (more > 0))
        if at.size:
            times[at] += permute(block[at], units[int(u)][1], seed * 1_000_003 + int(u)) < more[at]
    return row, low - begin[row], np.maximum(high - low, 0), times


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = 20240607, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken, ranges, crc for every document.

    ranges lists (pass, from, to) in words of the text: what each pass over the source takes. Sources rank by code
    point, null last, and their weights repeat in that order. Documents without words are kept with taken 0. Repeated
    rows count separately. Only one row a source, and a bounded number of shard rows, reach the driver.
    """
    spark = docs.sparkSession
    counted = settle(word_counts(docs, id_col, text_col, source_col), "sizes")
    totals = {r["source"]: r["size"] for r in counted.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted((s for s in totals if s is not None)) + [None] * (None in totals)
    sizes = [totals[s] for s in names]
    ranked = [float(weights[i % len(weights)]) for i in range(len(names))]
    wanted = targets(sizes, ranked, share, most)
    shard_words = max(SHARD_WORDS, -(-sum(sizes) // MOST_SHARDS))
    about = spark.createDataFrame([(i, s, z, t, max(1, -(-z // shard_words))) for i, (s, z, t) in enumerate(zip(names, sizes, wanted, strict=True))], "source_no int, _source string, source_size long, target double, shards long")
    placed = (
        counted.join(F.broadcast(about), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        .withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "crc", "size"))
        .withColumn("shard", F.pmod(F.col("key"), F.col("shards")))
    )
    by_shard: dict[int, list[tuple[int, int]]] = {}
    for r in placed.groupBy("source_no", "shard").agg(F.sum("size").alias("size")).collect():
        by_shard.setdefault(r["source_no"], []).append((r["shard"], r["size"]))
    blocks = {i: [max(1, -(-z // block_words)) if z else 0 for _, z in sorted(x)] for i, x in by_shard.items()}
    held = [sum(blocks.get(i, [])) for i in range(len(names))]
    votes = [t * b / z if z else 0.0 for t, b, z in zip(wanted, held, sizes, strict=True)]  # targets in blocks, which small sources have shorter
    seats = apportion(votes, round(sum(votes)), [int(most * b) for b in held])
    units, keys = {}, []
    for i, x in sorted(by_shard.items()):
        quota = apportion([float(b) for b in blocks[i]], seats[i], [int(most * b) for b in blocks[i]])
        for (shard, z), b, q in zip(sorted(x), blocks[i], quota, strict=True):
            units[len(keys)] = (z, b, q)
            keys.append((i, shard, len(keys)))
    numbers = spark.createDataFrame(keys, "source_no int, shard long, unit int")
    run = Window.partitionBy("source_no", "shard").orderBy("key", "doc_id", "size", "crc").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("begin", F.coalesce(F.sum("size").over(run), F.lit(0))).join(F.broadcast(numbers), ["source_no", "shard"])
    ranges = T.ArrayType(T.StructType([T.StructField("pass", T.IntegerType()), T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))
    head = "doc_id long, source string, size long, source_size long, target double, crc long"
    schema = T.StructType([*T._parse_datatype_string(head).fields, T.StructField("taken", T.LongType()), T.StructField("ranges", ranges)])

    def take(parts):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for part in parts:
            begin, size, unit = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("begin", "size", "unit"))
            row, at, words, times = _times(begin, size, unit, units, seed)
            taken = np.zeros(len(size), dtype=np.int64)
            np.add.at(taken, row, words * times)
            spans: list[list[dict]] = [[] for _ in range(len(size))]
            for r, a, w, t in zip(row.tolist(), at.tolist(), words.tolist(), times.tolist(), strict=True):
                for p in range(1, t + 1):
                    if w:
                        mine = spans[r]
                        old = next((x for x in reversed(mine[-4:]) if x["pass"] == p), None)
                        if old is not None and old["to"] == a:
                            old["to"] = a + w
                        else:
                            mine.append({"pass": p, "from": a, "to": a + w})
            cols = [part.column(c) for c in ("doc_id", "source", "size", "source_size", "target", "crc")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(taken), pa.array(spans, to_arrow_type(ranges))], schema=pa.schema([*zip(("doc_id", "source", "size", "source_size", "target", "crc"), (c.type for c in cols), strict=True), ("taken", pa.int64()), ("ranges", to_arrow_type(ranges))]))

    slim = laid.select("doc_id", "source", "size", "source_size", "target", "crc", "begin", "unit")
    return slim.mapInArrow(take, schema)


def materialise(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: docs' columns, one row for each pass that takes words of a document, with those words as text.

    A pass that takes a whole document keeps its text as it is; pieces of one are joined by a line break. n_chars, where
    docs has it, follows the new text. Rows with equal ids are told apart by checksum, so repeated rows stay separate.
    Texts without words, null ones and an empty table give no row; columns may have any names.
    """
    laid, name = plain(docs)
    own = name(text_col)
    turn = Window.partitionBy("_id", "_crc").orderBy(F.lit(0))  # rows equal in both are interchangeable
    left = laid.withColumns({"_id": F.col(name(id_col)).cast("long"), "_crc": F.crc32(F.coalesce(F.col(own), F.lit("")).cast("binary"))}).withColumn("_turn", F.row_number().over(turn))
    right = (
        mixed.select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), "ranges", F.col("size").alias("_size"), "taken")
        .withColumn("_turn", F.row_number().over(turn)).where("taken > 0")
        .select(F.col("_id").alias("_id2"), F.col("_crc").alias("_crc2"), F.col("_turn").alias("_turn2"), "_size", F.col("ranges").alias("_ranges"))
    )
    both = left.join(right, left["_id"].eqNullSafe(right["_id2"]) & (left["_crc"] == right["_crc2"]) & (left["_turn"] == right["_turn2"]))
    passes = F.array_distinct(F.transform("_ranges", lambda x: x["pass"]))
    each = both.withColumn("_pass", F.explode(passes)).withColumn("_mine", F.filter("_ranges", lambda x: x["pass"] == F.col("_pass")))

    @F.pandas_udf("string")
    def cut(text, size, mine):
        import re

        import pandas as pd

        word = re.compile(rb"[^\x20\x09-\x0D]+")
        out = []
        for t, n, spans in zip(text, size, mine, strict=True):
            if len(spans) == 1 and spans[0]["from"] == 0 and spans[0]["to"] == n:
                out.append(t)
                continue
            raw = t.encode()
            at = [m.span() for m in word.finditer(raw)]
            out.append("\n".join(raw[at[s["from"]][0] : at[s["to"] - 1][1]].decode() for s in spans))
        return pd.Series(out)

    made = {own: F.col("_new")}
    if "n_chars" in docs.columns and text_col != "n_chars":
        made[name("n_chars")] = F.char_length("_new").cast("long")
    text = each.withColumn("_new", cut(F.col(own).cast("string"), F.col("_size"), F.col("_mine")))
    return text.select(*[made.get(c, F.col(c)).alias(c) for c in laid.columns]).toDF(*docs.columns)
