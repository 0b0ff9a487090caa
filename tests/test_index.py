"""The index compiler against NumPy, and its errors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.plans.index import Picks, Point, Selection, Span, compile_index, product_index


def positions(axis):
    return [axis.at] if isinstance(axis, Point) else list(axis.at) if isinstance(axis, Picks) else list(range(axis.start, axis.stop, axis.step))


def apply(selection, array):
    out = array
    for k, a in reversed(list(enumerate(selection.axes))):
        out = np.take(out, a.at if isinstance(a, Point) else np.array(positions(a), dtype=int), axis=k)
    return out


@st.composite
def arrays_and_indices(draw):
    shape = tuple(draw(st.lists(st.integers(1, 9), min_size=1, max_size=3)))
    lists, index = 0, []
    for n in shape[: draw(st.integers(0, len(shape)))]:
        kind = draw(st.sampled_from(["int", "slice", "list", "mask"] if not lists else ["int", "slice"]))
        if kind == "int":
            index.append(draw(st.integers(-n, n - 1)))
        elif kind == "slice":
            ends = st.none() | st.integers(-n - 2, n + 2)
            index.append(slice(draw(ends), draw(ends), draw(st.none() | st.integers(1, 4))))
        else:
            lists += 1
            index.append(draw(st.lists(st.booleans(), min_size=n, max_size=n) if kind == "mask" else st.lists(st.integers(-n, n - 1), max_size=6)))
    if draw(st.booleans()):
        index.insert(draw(st.integers(0, len(index))) if len(index) == len(shape) else len(index), Ellipsis)
    return shape, tuple(index)


@given(arrays_and_indices())
@settings(max_examples=400, deadline=None)
def test_matches_numpy(case):
    shape, index = case
    array = np.arange(np.prod(shape)).reshape(shape)
    np_index = tuple(np.array(i, dtype=bool if i and isinstance(i[0], bool) else int) if isinstance(i, list) else i for i in index)
    want = array[np_index]
    found = compile_index(index, shape, tuple(2 for _ in shape))
    if sum(isinstance(i, (list, int)) for i in index) > 1 and any(isinstance(i, list) for i in index):
        assert sorted(apply(found, array).ravel().tolist()) == sorted(want.ravel().tolist())  # NumPy moves such axes around
    else:
        assert found.result_shape == want.shape
        assert (apply(found, array) == want).all()


def test_even_lists_become_slices():
    assert compile_index([2, 4, 6], (10,)).axes == (Span(2, 7, 2),)
    assert compile_index([True, False, True, False], (4,)).axes == (Span(0, 3, 2),)
    assert compile_index([3, 1], (10,)).axes == (Picks((3, 1)),)


def test_whole_chunks(spark):
    """Chunks that a stepped slice, a list or a position takes whole, against sets."""
    rng = np.random.default_rng(3)
    for n, size in ((12, 1), (13, 4), (9, 8), (10, 5), (7, 3)):
        for axis in (Span(0, n, 2), Span(1, n, 3), Span(n - 1, n, 2), Picks(tuple(rng.permutation(n)[: n - 2].tolist())), Picks((n - 1, 0, n - 1)), Point(n - 1), Point(2)):
            chunks = [i for i in range(-(-n // size)) if set(range(i * size, min(n, i * size + size))) <= set(positions(axis))]
            taken = Selection((axis,), (n,), (size,)).whole()
            assert [r["c0"] for r in spark.range(-(-n // size)).withColumnRenamed("id", "c0").where(taken).collect()] == chunks


OUTSIDE = {7: "beyond the end", -8: "before the start"}


@pytest.mark.parametrize("at", OUTSIDE, ids=OUTSIDE.get)
@pytest.mark.parametrize("wrap", [int, lambda i: [0, i], lambda i: np.array([i])], ids=["number", "list", "array"])
def test_positions_outside_an_axis(at, wrap):
    with pytest.raises(IndexError, match="out of bounds"):
        compile_index((slice(2), wrap(at)), (3, 7), (2, 3))


def test_what_is_no_index():
    for index in ("name", b"name", True, 1.5):
        with pytest.raises(IndexError):
            compile_index(index, (6,))
    for index in ((..., 1, ...), (1, 2, 3), (slice(None), 0, ..., 0)):
        with pytest.raises(IndexError):
            compile_index(index, (6, 5))
    with pytest.raises(IndexError, match="6 elements"):
        compile_index(([True, False],), (6,))
    with pytest.raises(ValueError):
        compile_index(slice(1, 5, 0), (6,))


def test_what_is_not_supported():
    for index in (slice(5, 1, -2), None, (0, None), [[0], [1]], np.zeros((2, 2), dtype=int)):
        with pytest.raises(NotImplementedError):
            compile_index(index, (6, 5))
    with pytest.raises(NotImplementedError):
        compile_index(([0, 2], [1, 4]), (6, 5))


def test_shapes_and_chunks_must_agree():
    for shape, chunks in (((6, 5), (2,)), ((6, -5), (2, 2)), ((6, 5), (2, 0)), ((6,), (-1,))):
        with pytest.raises(ValueError):
            compile_index((), shape, chunks)


def test_product_of_lists():
    array = np.arange(30).reshape(5, 6)
    assert (apply(product_index(([4, 0], [1, 1, 5]), (5, 6)), array) == array[np.ix_([4, 0], [1, 1, 5])]).all()


def test_chunk_predicate_reaches_the_reader(spark, tmp_path):
    from pyspark.sql import functions as F

    spark.range(100).select(F.col("id").alias("c0"), F.col("id").alias("chunk_hash")).write.parquet(str(tmp_path / "m"))
    plan = spark.read.parquet(str(tmp_path / "m")).where(compile_index(slice(300, 800), (10_000,), (256,)).touched())._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c0), GreaterThanOrEqual(c0,1), LessThanOrEqual(c0,3)]" in plan
