"""Digests of chunks: an exact one over raw bytes, and a portable one that any SQL engine can compute."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: NumPy type of each Spark element type whose bytes are hashed.
BYTES = {"boolean": "?", "tinyint": "i1", "smallint": "<i2", "int": "<i4", "bigint": "<i8", "float": "<f4", "double": "<f8"}


def chunk_bytes(cells, extent, kind: str) -> bytes:
    """What an exact digest covers: raw cells in row-major order, or each string's length and UTF-8 bytes, then the shape.

    The element type is not part of it, the shape is: so a trimmed chunk at an edge never equals a full one. Bits count,
    so -0.0 differs from 0.0 and equal bits of not-a-number are equal.
    """
    shape = str(tuple(int(x) for x in extent)).encode("ascii")
    if kind in ("string", "binary"):
        raw = [x.encode() if isinstance(x, str) else bytes(x) for x in cells]
        return b"".join(len(x).to_bytes(8, "little") + x for x in raw) + shape
    if kind in BYTES and not any(x is None for x in cells):
        return np.asarray(cells, dtype=BYTES[kind]).tobytes() + shape
    return b"".join(map(_raw, cells)) + shape


def _raw(x) -> bytes:
    """A value of any type behind its length: records and lists field by field, floats by bits, others by their text."""
    if x is None:
        return b"\xff" * 8
    if isinstance(x, dict):
        out = b"".join(map(_raw, x.values()))
    elif isinstance(x, (list, tuple, np.ndarray)):
        out = b"".join(map(_raw, x))
    elif isinstance(x, (float, np.floating)):
        out = np.float64(x).tobytes()
    else:
        out = bytes(x) if isinstance(x, (bytes, bytearray)) else str(x).encode()
    return len(out).to_bytes(8, "little") + out


def exact_digest(cells: Column, extent: Column, kind: str) -> Column:
    """SHA-256, in hex, of a chunk's raw bytes and shape. SQL has no way to a value's bytes, so Arrow carries the cells."""

    @F.pandas_udf("string")
    def digest(cells, extent):
        from hashlib import sha256

        import pandas as pd

        return pd.Series([sha256(chunk_bytes(c, e, kind)).hexdigest() for c, e in zip(cells, extent, strict=True)])

    return digest(cells, extent)


def portable_text(value: Column, kind: str) -> Column:
    """A cell as text that engines agree on: numbers as decimals of six places, strings as they are."""
    return value if kind == "string" else value.cast("decimal(38,6)").cast("string")


def portable_digest(cells: Column, extent: Column, kind: str) -> Column:
    """SHA-256 of a chunk's extent and cells as text, by built-in functions."""
    return F.sha2(F.concat_ws("|", F.array_join(F.transform(extent, lambda x: x.cast("string")), ","), F.array_join(F.transform(cells, lambda x: portable_text(x, kind)), ",")), 256)
