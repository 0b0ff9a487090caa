"""NumPy arrays as frames of cells and back, for arrays that fit on the driver, where they come from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark type of each NumPy type; unsigned ones take the next wider type.
KINDS = {"b1": "boolean", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "u8": "decimal(20,0)", "f2": "float", "f4": "float", "f8": "double"}


def kind_of(dtype: np.dtype) -> str:
    """The Spark type of an array's elements; records become structs, and complex numbers structs of re and im."""
    if dtype.names:
        return "struct<" + ",".join(f"{n}:{kind_of(dtype[n])}" for n in dtype.names) + ">"
    if dtype.kind in "US" or dtype == object:
        return "binary" if dtype.kind == "S" else "string"
    if dtype.kind == "M":
        return "timestamp_ntz"
    if dtype.kind == "c":
        return "struct<re:double,im:double>"
    return KINDS[f"{dtype.kind}{dtype.itemsize}"]


def _column(flat: np.ndarray):
    import pyarrow as pa

    if flat.dtype.names:
        return pa.StructArray.from_arrays([_column(np.ascontiguousarray(flat[n])) for n in flat.dtype.names], list(flat.dtype.names))
    if flat.dtype.kind == "c":
        return pa.StructArray.from_arrays([pa.array(flat.real.astype("f8")), pa.array(flat.imag.astype("f8"))], ["re", "im"])
    if flat.dtype.kind == "M":
        return pa.array(flat.astype("datetime64[us]"))
    if flat.dtype.kind in "uf" and flat.dtype.itemsize in (1, 2, 4) and flat.dtype.str[1:] in ("u1", "u2", "u4", "f2"):
        return pa.array(flat.astype({"u1": "i2", "u2": "i4", "u4": "i8", "f2": "f4"}[flat.dtype.str[1:]]))
    if flat.dtype.str[1:] == "u8":
        return pa.array([int(x) for x in flat], pa.decimal128(20, 0))
    return pa.array(flat.tolist() if flat.dtype.kind in "USO" else flat)


def cells(spark: SparkSession, array: np.ndarray, prefix: str = "d", kind: str | None = None) -> DataFrame:
    """d0, ..., val (or another prefix) of an array's elements, cast to a Spark type if one is given."""
    import pyarrow as pa

    array = np.asarray(array)
    flat = np.ascontiguousarray(array).ravel()
    places = np.unravel_index(np.arange(flat.size), array.shape) if array.ndim else ()
    names = [f"{prefix}{k}" for k in range(array.ndim)]
    table = pa.Table.from_arrays([*(pa.array(p.astype(np.int64)) for p in places), _column(flat)], [*names, "val"])
    return spark.createDataFrame(table).select(*names, F.col("val").cast(kind or kind_of(array.dtype)).alias("val"))


def dense(cells_df: DataFrame, shape: tuple[int, ...], fill, prefix: str = "d") -> np.ndarray:
    """The array of a frame's cells, on the driver; places that have none hold fill."""
    found = cells_df.toPandas()
    values = found["val"].to_numpy()
    out = np.full(shape, fill, dtype=values.dtype if len(values) else None)
    out[tuple(found[f"{prefix}{k}"].to_numpy() for k in range(len(shape)))] = values if shape else values[0]
    return out
