"""One version for each micro-batch of a stream: the natural form of data that is mostly appended."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from chunkloom.sources.store import VersionStore


def append_batch(store: VersionStore, path: str, batch: DataFrame, number: int, order: Sequence[str], value: str, chunks: Sequence[int] | None = None) -> None:
    """Append a batch's values, in the given order, as version batch-<number>; a batch that was committed is passed over.

    Rows are put in order by one task: a micro-batch is bounded by its trigger.
    """
    name = f"batch-{number:012d}"
    if name in store:
        return
    rows = batch.select(F.col(value).alias("val"), (F.row_number().over(Window.orderBy(*order)) - 1).cast("long").alias("d0"))
    n = rows.count()
    with store.stage(name) as s:
        if path in s.entries:
            s.append(path, rows, n)
        else:
            s.put(path, rows, (n,), chunks=chunks)


def commit_stream(stream: DataFrame, store: VersionStore, path: str, order: Sequence[str], value: str, checkpoint: str, chunks: Sequence[int] | None = None, **trigger) -> StreamingQuery:
    """Start a query that commits each micro-batch; with its checkpoint, each row ends up in the array once."""
    writer = stream.writeStream.foreachBatch(lambda batch, number: append_batch(store, path, batch, number, order, value, chunks)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
