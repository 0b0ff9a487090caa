"""What several corpus operators share: working tables, columns made safe, and a distributed row order."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, which parts words in every contract of this folder.
BLANK = r"\x20\x09-\x0D"

#: Working tables on local disks have no checksum files. Hadoop starts a `chmod` for each file that it makes there, and
#: until such a process has its own program, it is read as having its JVM's whole memory too.
BARE = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

_ours: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir, or in local tests one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="chunkloom-")
    spark.conf.set("spark.checkpoint.dir", f"file://{found}")
    return f"file://{found}"


@contextmanager
def _with(spark: SparkSession, settings: dict[str, str]):
    """The session with other settings for a while."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def settle(df: DataFrame, tag: str, batch: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends here, and lost executors cost nothing.

    The table stays until the session ends, since the frames made from it are lazy. Shuffle files of the write go when it
    ends. With batch, Arrow's batches have so many rows at most, for wide rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/chunkloom-{tag}-{uuid.uuid4().hex}"
    settings = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    if batch:
        settings["spark.sql.execution.arrow.maxRecordsPerBatch"] = str(batch)
    with _with(spark, settings):
        df.write.options(compression="zstd", **BARE).parquet(path)
    if not _ours:
        atexit.register(_tidy)
    _ours.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again (those already gone are passed over), and let Spark delete
    broadcasts and shuffle files that no frame refers to; of settled tables there are none of the latter.

    Spark finds those when the driver's JVM collects garbage, which a driver with little to do may not need for long.
    """
    for table in tables:
        if table._settled_at not in _ours:
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(table._settled_at)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        _ours.discard(table._settled_at)
    gc.collect()
    spark._jvm.System.gc()


def _tidy() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is None:
            return
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in _ours:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
    except Exception:  # noqa: BLE001  the JVM may be gone by now, and with it any use for the folder
        pass


def plain(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """docs with columns k0, k1, ..., which clash with nothing, and what a column of docs is called there."""
    at = {c.lower(): f"k{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*[f"k{i}" for i in range(len(docs.columns))]), lambda name: at[name.lower()]


def text_of(name: str = "text") -> Column:
    """The text, with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def remainder(name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(name).cast("string")) % n


def held_out(name: str, n: int) -> Column:
    """True where that remainder is 2; rows without an id are never held out."""
    return F.coalesce(remainder(name, n) == 2, F.lit(False))


def numbered(df: DataFrame, order: list[str], tag: str) -> tuple[DataFrame, int]:
    """Rows with row_number (from 0, in the given order), and how many there are.

    Rows are dealt out by ranges of the order columns and sorted within each range, so no task sees more than its
    range. Only one count for each range reaches the driver. Rows equal in all order columns may swap places.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    kept = settle(sorted_, tag)
    parts = kept.groupBy(F.shiftright("_at", 33).alias("part")).count().collect()
    before, start = {}, 0
    for part, n in sorted((r["part"], r["count"]) for r in parts):
        before[part] = start
        start += n
    if not before:
        return kept.withColumn("row_number", F.col("_at")).drop("_at"), 0
    starts = df.sparkSession.createDataFrame(list(before.items()), "_part long, _start long")
    joined = kept.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(starts), "_part")
    return joined.withColumn("row_number", F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_start"), start


_held: dict = {}


def held_by_worker(key, make):
    """What a Python worker keeps from task to task, made at first use. One thing at a time: another key replaces it.

    Workers go on from one operator to the next, and the tables that they look things up in would add up otherwise.
    """
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Drop what the worker holds: for operators that hold nothing themselves, and at the end of tasks that need it no more."""
    if _held:
        import pyarrow as pa

        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def batches(column, most_chars: int = 2_000_000):
    """Slices of an Arrow string column, as (offset, list of str), of about so many characters or one long text."""
    values, begin, n = column, 0, len(column)
    lengths = values.cast("large_string").fill_null("")
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(lengths).to_numpy(zero_copy_only=False).astype(np.int64))
    while begin < n:
        done = int(ends[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(ends, done + most_chars, "right")))
        yield begin, lengths.slice(begin, stop - begin).to_pylist()
        begin = stop
