"""Versions as rows v, prev, vts: chains, ancestors, times, and what happens to them when some are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chunkloom.sources.files import settle

#: Versions whose pointers the driver follows itself; one more, and they are joined instead.
LISTED = 100_000


def daily_chain(events: DataFrame, ts: str = "ts") -> DataFrame:
    """One version a day: its date, the version before it, its last time. The window sees one row a day."""
    days = events.groupBy(F.to_date(ts).alias("v")).agg(F.max(ts).alias("vts"))
    return days.withColumn("prev", F.lag("v").over(Window.orderBy("v")))


def _listed(versions: DataFrame) -> dict | None:
    """Each version's prev, if there are at most LISTED versions; None if there are more."""
    rows = versions.select("v", "prev").limit(LISTED + 1).collect()
    return dict(map(tuple, rows)) if len(rows) <= LISTED else None


def lineage(versions: DataFrame, head) -> DataFrame:
    """v and depth from head (depth 0) back to the root, along prev; no row if there is no such version.

    Up to LISTED versions are walked on the driver, when this is called. Beyond, pointers double: each round joins every
    version's pointer with the pointers of the versions found so far, so rounds grow with the logarithm of the depth.
    """
    spark, kind = versions.sparkSession, versions.schema["v"].dataType.simpleString()
    if (prev := _listed(versions)) is not None:
        out, at = [], head
        while at in prev and len(out) <= len(prev):
            out.append((at, len(out)))
            at = prev[at]
        if len(out) > len(prev):
            raise ValueError("the versions before head form a ring")
        return spark.createDataFrame(out, f"v {kind}, depth int")
    found = settle(versions.where(F.col("v") == F.lit(head)).select("v", F.lit(0).alias("depth")))
    up = settle(versions.where("prev is not null").select("v", "prev").join(versions.select(F.col("v").alias("prev")), "prev", "left_semi"))
    far = 1
    while not found.isEmpty():
        new = found.join(up, "v").select(F.col("prev").alias("v"), (F.col("depth") + far).alias("depth"))
        if new.isEmpty():
            break
        found = settle(found.unionByName(new))
        up = settle(up.join(up.select(F.col("v").alias("prev"), F.col("prev").alias("_next")), "prev").select("v", F.col("_next").alias("prev")))
        far *= 2
    return found


def nth_ancestor(versions: DataFrame, head, n: int) -> DataFrame:
    """The n-th version before head; no row if there are fewer."""
    return lineage(versions, head).where(F.col("depth") == n).select("v")


def asof(versions: DataFrame, t: Column, exact: bool = False) -> DataFrame:
    """The version at time t: one of that very time, or else the latest before it (none with exact)."""
    when = F.col("vts") == t if exact else F.col("vts") <= t
    return versions.where(when).agg(F.max_by("v", F.struct("vts", "v")).alias("v")).where("v is not null")


def asof_join(probes: DataFrame, versions: DataFrame, t: str = "t", bucket: str = "day") -> DataFrame:
    """probes with v, the latest version not after t (null before the first).

    Each version's time until the next is spread over the buckets that it covers, so that the join has a key and no
    side is held whole; within a bucket a range decides. Probes after the last bucket belong to the last version.
    """
    at = Window.orderBy("vts", "v")
    spans = versions.select("v", "vts", F.lead("vts").over(at).alias("until"))
    last = probes.agg(F.max(t).alias("end"))
    spread = spans.crossJoin(F.broadcast(last)).withColumn("until", F.coalesce("until", F.greatest("vts", "end") + F.expr("interval 1 second")))
    keyed = spread.withColumn("bucket", F.explode(F.expr(f"sequence(date_trunc('{bucket}', vts), date_trunc('{bucket}', until), interval 1 {bucket})")))
    right = keyed.select("bucket", F.col("v"), "vts", "until")
    left = probes.withColumn("bucket", F.date_trunc(bucket, t))
    hit = (left[t] >= right["vts"]) & (left[t] < right["until"])
    return left.join(right, (left["bucket"] == right["bucket"]) & hit, "left").select(*[left[c] for c in probes.columns], "v")


def drop_versions(versions: DataFrame, gone: DataFrame, reparent: bool = True) -> DataFrame:
    """versions without those in gone (column v); survivors' prev becomes the nearest kept ancestor, or stays as it was.

    The pointers of versions that go are followed on the driver for up to LISTED of them, and doubled beyond.
    """
    kept = versions.join(gone.select("v"), "v", "left_anti")
    if not reparent:
        return kept
    spark, kind = versions.sparkSession, versions.schema["v"].dataType.simpleString()
    lost = versions.join(gone.select("v"), "v", "left_semi").select("v", "prev")
    if (prev := _listed(lost)) is not None:
        for v in list(prev):
            path = []
            while v in prev:
                path.append(v)
                v = prev[v]
            prev |= dict.fromkeys(path, v)  # later walks stop here
        to = spark.createDataFrame(list(prev.items()), f"v {kind}, prev {kind}")
    else:
        to = settle(lost)
        while not to.join(to.select(F.col("v").alias("prev")), "prev", "left_semi").isEmpty():
            after = to.select(F.col("v").alias("prev"), F.col("prev").alias("_next"), F.lit(True).alias("_lost"))
            to = settle(to.join(after, "prev", "left").select("v", F.when(F.col("_lost"), F.col("_next")).otherwise(F.col("prev")).alias("prev")))
    new = to.select(F.col("v").alias("prev"), F.col("prev").alias("_to"), F.lit(True).alias("_lost"))
    joined = kept.join(new, "prev", "left")
    return joined.select(*[F.when(F.col("_lost"), F.col("_to")).otherwise(F.col("prev")).alias("prev") if c == "prev" else F.col(c) for c in versions.columns])
