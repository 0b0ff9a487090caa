"""Integer, path and time functions that the operators share, each as a Column and, where plans need it, in Python."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def range_length(start: Column, stop: Column, step: Column) -> Column:
    """How many numbers range(start, stop, step) has; step is at least 1."""
    last = stop - start - 1
    n = (last - F.pmod(last, step)) / step + 1
    return F.when(stop <= start, F.lit(0)).otherwise(n).cast("long")


def range_end(start: Column, count: Column, step: Column) -> Column:
    """The least stop for which range(start, stop, step) has so many numbers."""
    return F.when(count == 0, start).otherwise(start + (count - 1) * step + 1).cast("long")


def ceil_div(a: Column, b: Column) -> Column:
    """a / b rounded up, for a >= 0 and b > 0, in integers throughout."""
    return ((a - F.pmod(a, b)) / b).cast("long") + F.when(F.pmod(a, b) > 0, 1).otherwise(0)


def next_on_grid(x: Column, a: Column, m: Column) -> Column:
    """The least a + k * m that is not below x."""
    return (a + ceil_div(x - a, m) * m).cast("long")


def parent_path(path: Column) -> Column:
    """Everything before the last slash; empty for a top-level name."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def under(path: Column, prefix: str) -> Column:
    """Whether a path is the prefix itself or lies below it."""
    return (path == prefix) | path.startswith(prefix.rstrip("/") + "/") if prefix else F.lit(True)


def move_prefix(path: Column, old: str, new: str) -> Column:
    """The path with its leading old replaced by new; other paths stay."""
    return F.when(under(path, old), F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def new_version_name() -> str:
    """A name for a version that has none; drawn in Python so that it stays the same when a plan runs again."""
    return str(uuid.uuid4())


def utc(t: datetime.datetime) -> datetime.datetime:
    """A UTC time without its zone, as stored; raises ValueError for any other zone, and for none."""
    if t.utcoffset() != datetime.timedelta(0):
        raise ValueError("times are given in UTC")
    return t.replace(tzinfo=None)


def compatible(a: str, b: str) -> bool:
    """Whether data of Spark type a may go into a dataset of type b: only equal types, all strings being one type."""
    text = {"string", "varchar", "char"}
    return a == b or (a.split("(")[0] in text and b.split("(")[0] in text)


def show_index(index: tuple) -> str:
    """An index as one would write it between brackets."""

    def one(x) -> str:
        if isinstance(x, slice):
            parts = ["" if p is None else str(p) for p in (x.start, x.stop)]
            return ":".join(parts) + (f":{x.step}" if x.step not in (None, 1) else "")
        return "..." if x is Ellipsis else str(list(x)) if hasattr(x, "__len__") else str(x)

    return ", ".join(map(one, index if isinstance(index, tuple) else (index,)))
