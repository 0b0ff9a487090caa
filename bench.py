"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query runs twice and the better counts."""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from chunkloom import queries as library  # noqa: E402
from chunkloom.sources.store import VersionStore  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = "asof_snapshot_slice asof_many lineage idx_step idx_2d idx_fancy chunk_grid_2d chunk_hash dedup_first_writer dedup_stats setitem_overlay resize_enlarge rechunk chunk_diff cell_diff gc_live_chunks reparent_after_delete hash_exact_bytes".split()


def timed(f) -> float:
    began = time.perf_counter()
    f()
    return time.perf_counter() - began


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def workload(spark: SparkSession, took: dict[str, float]) -> None:
    """A series that grows over ten versions: commits, reads beside a plain Parquet read, a difference, a deletion."""
    root = tempfile.mkdtemp(prefix="bench-")
    cells = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_id").alias("d0"), F.col("value").alias("val")).cache()
    n = cells.count()
    store = VersionStore(spark, f"file://{root}/store")

    def commit(name: str, change) -> None:
        with store.stage(name) as s:
            change(s)

    took["commit_all_new"] = timed(lambda: commit("r0", lambda s: s.put("x", cells.where(F.col("d0") < n // 2), (n // 2,), chunks=(4096,))))
    step = (n - n // 2) // 8
    for i in range(8):
        at = n // 2 + i * step
        rows = cells.where(F.col("d0").between(at, at + step - 1)).withColumn("d0", F.col("d0") - at)
        took["commit_append"] = timed(lambda i=i, rows=rows: commit(f"r{i + 1}", lambda s: s.append("x", rows, step)))
    took["commit_one_cell"] = timed(lambda: commit("r9", lambda s: s.__setitem__(("x", 5), 1.5)))
    head = store[0]["x"]
    took["commit_all_known"] = timed(lambda: commit("r10", lambda s: s.put("x", cells.where(F.col("d0") < len(head)), head.shape)))
    plain = f"{root}/plain"
    cells.where(F.col("d0") < len(head)).write.parquet(plain)
    for name, f in {"read_plain": lambda: drain(spark.read.parquet(plain)), "read_head": lambda: drain(store[0]["x"].stored()), "read_first": lambda: drain(store["r0"]["x"].stored()), "read_slice": lambda: drain(store[0]["x"][1000:9000:3])}.items():
        took[name] = min(timed(f), timed(f))
    took["read_all_versions"] = timed(lambda: [drain(store[v]["x"].stored()) for v in store.versions])
    took["diff_adjacent"] = timed(lambda: drain(store.diff("x", "r8", "r9")))
    took["delete_versions"] = timed(lambda: store.delete_versions([v for v in store.versions if v not in ("r0", "r10")]))


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='bench-')}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    every = library.queries()
    for name in HEADLINE:
        took[name] = min(timed(lambda n=name: drain(every[n](spark, SF))) for _ in range(2))
    workload(spark, took)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in took.items()}, "sf": SF.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
