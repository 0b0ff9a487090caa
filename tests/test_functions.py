"""Scalar functions against Python, and which chunks may share a digest."""

import hashlib
import struct

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.functions import scalars as S
from chunkloom.functions.hashing import chunk_bytes
from chunkloom.operators import chunks as C
from chunkloom.operators import mutate, select


def test_ranges(spark):
    rows = [(a, b, s) for a in range(0, 7) for b in range(0, 12) for s in (1, 2, 3, 5)]
    df = spark.createDataFrame(rows, "a long, b long, s long")
    out = df.select("a", "b", "s", S.range_length(F.col("a"), F.col("b"), F.col("s")).alias("n"), S.range_end(F.col("a"), F.col("b"), F.col("s")).alias("e"), S.ceil_div(F.col("b"), F.col("s")).alias("c"), S.next_on_grid(F.col("a") + F.col("b"), F.col("a"), F.col("s")).alias("y")).collect()
    for r in out:
        assert r["n"] == len(range(r["a"], r["b"], r["s"]))
        assert len(range(r["a"], r["e"], r["s"])) == r["b"] and (r["b"] == 0 or len(range(r["a"], r["e"] - 1, r["s"])) == r["b"] - 1)
        assert r["c"] == -(-r["b"] // r["s"])
        assert r["y"] == min(y for y in range(r["a"], 99, r["s"]) if y >= r["a"] + r["b"])


def test_paths_and_types(spark):
    df = spark.createDataFrame([("a/b/c",), ("a",), ("ab/c",)], "p string")
    out = df.select(S.parent_path(F.col("p")), S.under(F.col("p"), "a"), S.move_prefix(F.col("p"), "a", "z")).collect()
    assert [tuple(r) for r in out] == [("a/b", True, "z/b/c"), ("", True, "z"), ("ab", False, "ab/c")]
    assert S.compatible("string", "varchar(3)") and not S.compatible("int", "bigint")
    assert S.show_index((slice(1, None, 2), ..., 3, [1, 2])) == "1::2, ..., 3, [1, 2]"


def test_digest_layout():
    assert chunk_bytes([1, 2], [2], "bigint") == np.array([1, 2], "<i8").tobytes() + b"(2,)"
    assert chunk_bytes(["ab", ""], [2], "string") == struct.pack("<Q", 2) + b"ab" + struct.pack("<Q", 0) + b"(2,)"


@given(st.lists(st.floats(width=64), min_size=1, max_size=6), st.lists(st.floats(width=64), min_size=1, max_size=6))
def test_digests_go_by_bits(a, b):
    same = np.array(a).tobytes() == np.array(b).tobytes()
    assert (chunk_bytes(a, [len(a)], "double") == chunk_bytes(b, [len(b)], "double")) == same


def test_digests_tell_shapes_and_zeros_apart():
    made = [chunk_bytes(c, e, "double") for c, e in (([0.0] * 6, [6]), ([0.0] * 6, [2, 3]), ([0.0] * 6, [3, 2]), ([-0.0] + [0.0] * 5, [6]))]
    assert len({hashlib.sha256(x).digest() for x in made}) == 4


def test_exact_digest_in_spark(spark):
    df = spark.createDataFrame([(0, 1.5), (1, -0.0)], "d0 long, val double")
    got = C.hash_chunks(C.chunk_cells(df, (2,), (2,), keep_fill=True), exact=True).first()["chunk_hash"]
    assert got == hashlib.sha256(np.array([1.5, -0.0]).tobytes() + b"(2,)").hexdigest()


def test_chunks_round_trip_and_fill(spark):
    a = np.arange(35).reshape(5, 7) % 4
    df = spark.createDataFrame([(int(i), int(j), int(v)) for (i, j), v in np.ndenumerate(a)], "d0 long, d1 long, val bigint")
    rows = C.chunk_cells(df, (5, 7), (2, 3), keep_fill=True)
    assert rows.count() == 9 and {(r["d0"], r["d1"]): r["val"] for r in C.assemble(rows, (2, 3)).collect()} == {(i, j): int(v) for (i, j), v in np.ndenumerate(a)}
    assert C.chunk_cells(mutate.set_where(df, F.col("d0") < 2, F.lit(0)), (5, 7), (2, 3)).where("c0 = 0").count() == 0
    assert C.grid(spark, (5, 7), (2, 3)).count() == 9 and C.grid(spark, (0, 7), (2, 3)).count() == 0


def test_ranks_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(select, "STRETCH", 4)
    df = spark.createDataFrame([(d, d) for d in range(1, 40, 3)], "d0 long, val long")
    assert sorted((r["d0"], r["o0"]) for r in select.ranked(df).collect()) == [(d, i) for i, d in enumerate(range(1, 40, 3))]
