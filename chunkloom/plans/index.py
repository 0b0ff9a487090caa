"""Compiles an array index into Column predicates, on cells and on the chunks that hold them.

A predicate on a cell's coordinate says nothing to the Parquet reader about chunk columns, so both are emitted; the
second prunes row groups. Lists of positions in even steps become slices, whose predicates are ranges.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Positions that are looked up by a broadcast, and chunk numbers that are listed one by one; beyond, a plain join and a range.
BROADCAST_PICKS, LISTED_CHUNKS = 100_000, 500


@dataclass(frozen=True)
class Point:
    """One position; the axis is dropped."""

    at: int


@dataclass(frozen=True)
class Span:
    """start, start + step, ... below stop; step is at least 1."""

    start: int
    stop: int
    step: int = 1

    def __len__(self) -> int:
        return len(range(self.start, self.stop, self.step))


@dataclass(frozen=True)
class Picks:
    """Positions in any order, perhaps repeated."""

    at: tuple[int, ...]

    def __len__(self) -> int:
        return len(self.at)


def _is_list(x: Any) -> bool:
    return hasattr(x, "__len__") and not isinstance(x, (str, bytes, tuple)) or hasattr(x, "ndim") and getattr(x, "ndim", 0) > 0


def _axis(i: Any, size: int) -> Point | Span | Picks:
    if i is None:
        raise NotImplementedError("an index cannot add an axis")
    if isinstance(i, slice):
        step = 1 if i.step is None else operator.index(i.step)
        if step == 0:
            raise ValueError("slice step cannot be zero")
        if step < 0:
            raise NotImplementedError("slice step must be positive")
        start, stop, step = slice(i.start, i.stop, step).indices(size)
        return Span(start, max(start, stop), step)
    if _is_list(i):
        values = list(i.tolist() if hasattr(i, "tolist") else i)
        if any(_is_list(v) for v in values):
            raise NotImplementedError("array index must be 1-dimensional")
        if values and all(isinstance(v, bool) for v in values):
            if len(values) != size:
                raise IndexError(f"boolean index did not match indexed array; it has {len(values)} of {size} elements")
            values = [k for k, v in enumerate(values) if v]
        return _simplified([_position(v, size) for v in values])
    if isinstance(i, bool) or isinstance(i, (str, bytes)) or not hasattr(i, "__index__"):
        raise IndexError("only integers, slices, ellipsis, and integer or boolean arrays are valid indices")
    return Point(_position(i, size))


def _position(v: Any, size: int) -> int:
    at = operator.index(v)
    if not -size <= at < size:
        raise IndexError(f"index {at} is out of bounds for axis of size {size}")
    return at % size


def _simplified(at: list[int]) -> Span | Picks:
    if not at:
        return Span(0, 0)
    steps = {b - a for a, b in zip(at, at[1:], strict=False)}
    if len(steps) > 1 or (steps and min(steps) < 1):
        return Picks(tuple(at))
    return Span(at[0], at[-1] + 1, steps.pop() if steps else 1)


@dataclass(frozen=True)
class Selection:
    """What an index selects: one selector an axis."""

    axes: tuple[Point | Span | Picks, ...]
    shape: tuple[int, ...]
    chunks: tuple[int, ...]

    @property
    def empty(self) -> bool:
        return any(not isinstance(a, Point) and len(a) == 0 for a in self.axes)

    @property
    def result_shape(self) -> tuple[int, ...]:
        return tuple(len(a) for a in self.axes if not isinstance(a, Point))

    def cells(self) -> Column:
        """Predicate on d0, d1, ...; lists of positions only give their range, their join does the rest."""
        if self.empty:
            return F.lit(False)
        out = [F.lit(True)]
        for k, a in enumerate(self.axes):
            d = F.col(f"d{k}")
            if isinstance(a, Point):
                out.append(d == a.at)
            elif isinstance(a, Picks):
                out.append(d.between(min(a.at), max(a.at)))
            elif (a.start, a.stop, a.step) != (0, self.shape[k], 1):
                out.append(d.between(a.start, a.stop - 1) & (F.lit(True) if a.step == 1 else (d - a.start) % a.step == 0))
        return reduce(operator.and_, out)

    def touched(self, prefix: str = "c") -> Column:
        """Predicate on chunk columns c0, c1, ...: chunks that hold a selected cell."""
        if self.empty:
            return F.lit(False)
        out = [F.lit(True)]
        for k, (a, size) in enumerate(zip(self.axes, self.chunks, strict=True)):
            c = F.col(f"{prefix}{k}")
            if isinstance(a, Point):
                out.append(c == a.at // size)
            elif isinstance(a, Picks):
                numbers = sorted({x // size for x in a.at})
                out.append(c.isin(numbers) if len(numbers) <= LISTED_CHUNKS else c.between(numbers[0], numbers[-1]))
            else:
                last = a.start + (len(a) - 1) * a.step
                numbers = sorted({x // size for x in range(a.start, a.stop, a.step)}) if a.step > size and len(a) <= LISTED_CHUNKS else None
                out.append(c.isin(numbers) if numbers else c.between(a.start // size, last // size))
        return reduce(operator.and_, out)

    def select(self, cells: DataFrame) -> DataFrame:
        """Rows o0, o1, ... (one for each axis kept) and val of the cells (d0, d1, ..., val) that are selected."""
        out = cells.where(self.cells())
        coords, n = [], 0
        for k, a in enumerate(self.axes):
            if isinstance(a, Point):
                continue
            if isinstance(a, Picks):
                index = cells.sparkSession.createDataFrame(list(enumerate(a.at)), f"p{k} long, d{k} long")
                out = out.join(F.broadcast(index) if len(a) <= BROADCAST_PICKS else index, f"d{k}")
                coords.append(F.col(f"p{k}").alias(f"o{n}"))
            else:
                d = F.col(f"d{k}") - a.start
                coords.append((d if a.step == 1 else F.floor(d / a.step)).cast("long").alias(f"o{n}"))
            n += 1
        return out.select(*coords, "val")

    def coordinates(self, spark: SparkSession) -> DataFrame:
        """o0, ... and d0, ... of all selected cells, from one range; meant for selections that are written."""
        kept = [k for k, a in enumerate(self.axes) if not isinstance(a, Point)]
        total, rest = 1, F.col("id")
        for n in self.result_shape:
            total *= n
        cols: dict[str, Column] = {}
        for o, k in reversed(list(enumerate(kept))):
            a = self.axes[k]
            cols[f"o{o}"] = (rest % len(a)).cast("long") if len(a) else rest
            rest = F.call_function("div", rest, F.lit(max(1, len(a))))
        out = spark.range(total).select(*[cols[f"o{o}"].alias(f"o{o}") for o in range(len(kept))])
        d = []
        for k, a in enumerate(self.axes):
            o = F.col(f"o{kept.index(k)}") if k in kept else None
            d.append((F.lit(a.at) if o is None else a.start + o * a.step if isinstance(a, Span) else F.element_at(F.lit(list(a.at)), (o + 1).cast("int"))).cast("long").alias(f"d{k}"))
        return out.select(*[f"o{o}" for o in range(len(kept))], *d)

    @staticmethod
    def _covered(a: Point | Span | Picks, c: Column, size: int, n: int) -> Column:
        """Predicate on an axis' chunk number: chunks of which a point, a stepped span or a list takes every position."""
        if isinstance(a, Picks):
            each: dict[int, int] = {}
            for p in set(a.at):
                each[p // size] = each.get(p // size, 0) + 1
            full = [i for i, m in each.items() if m == min(size, n - i * size)]
        else:  # what is taken is at least two apart, so only a chunk of one position can be taken whole
            at = range(a.at, a.at + 1) if isinstance(a, Point) else range(a.start, a.stop, a.step)
            if size == 1 and len(at):
                return c.between(at[0], at[-1]) & ((c - at[0]) % at.step == 0)
            full = [(n - 1) // size] if n % size == 1 and n - 1 in at else []
        return c.isin(full) if full else F.lit(False)

    def whole(self) -> Column:
        """Predicate on chunk columns: chunks all of whose cells are selected."""
        out = [F.lit(not self.empty)]
        for k, (a, size) in enumerate(zip(self.axes, self.chunks, strict=True)):
            c, n = F.col(f"c{k}"), self.shape[k]
            low, high = c * size, F.least(c * size + size, F.lit(n))
            if isinstance(a, Span) and a.step == 1:
                out.append((low >= a.start) & (high <= a.stop))
            else:
                out.append(self._covered(a, c, size, n))
        return reduce(operator.and_, out)


def compile_index(index: Any, shape: tuple[int, ...], chunks: tuple[int, ...] | None = None) -> Selection:
    """The selection of array[index] for an array of this shape, cut into such chunks (one chunk by default)."""
    chunks = tuple(max(1, n) for n in shape) if chunks is None else tuple(chunks)
    if len(chunks) != len(shape):
        raise ValueError("chunks and shape differ in their number of axes")
    for n, c in zip(shape, chunks, strict=True):
        if n < 0 or c < 1:
            raise ValueError("no axis is shorter than zero" if n < 0 else "a chunk has at least one cell along each axis")
    parts = list(index) if isinstance(index, tuple) else [index]
    dots = [k for k, x in enumerate(parts) if x is Ellipsis]
    if len(dots) > 1:
        raise IndexError("an index can only have a single ellipsis")
    if len(parts) - len(dots) > len(shape):
        raise IndexError(f"too many indices for array: array is {len(shape)}-dimensional, but {len(parts) - len(dots)} were indexed")
    at = dots[0] if dots else len(parts)
    parts = parts[:at] + [slice(None)] * (len(shape) - len(parts) + len(dots)) + parts[at + 1 :]
    if sum(map(_is_list, parts)) > 1:
        raise NotImplementedError("one list or mask an index; product_index takes more")
    return Selection(tuple(_axis(i, n) for i, n in zip(parts, shape, strict=True)), tuple(shape), chunks)


def product_index(index: tuple, shape: tuple[int, ...], chunks: tuple[int, ...] | None = None) -> Selection:
    """Like compile_index, but several lists are allowed and select the product of their positions."""
    parts = [x if isinstance(x, (slice, int)) or x is Ellipsis else list(x) for x in index]
    parts += [slice(None)] * (len(shape) - len(parts))
    one = [compile_index((x,), (n,)).axes[0] for x, n in zip(parts, shape, strict=True)]
    return Selection(tuple(one), tuple(shape), tuple(chunks or (max(1, n) for n in shape)))
