"""The engine's operators as queries over the given tables, each with the SQL that DuckDB runs to the same rows.

Arrays are derived from the tables: `events` is a one-dimensional array (event_id, value) that grows by a version a day,
and by user_id a last-writer-wins array; `embeddings` is a dense and `orders` a sparse two-dimensional array; `documents`
is an array of strings; `lineitem` gives axes of labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.functions import scalars
from chunkloom.functions.hashing import exact_digest, portable_digest
from chunkloom.operators import chunks as C
from chunkloom.operators import diff, history, mutate, select, versions
from chunkloom.plans.index import compile_index, product_index

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

CHUNK, USERS, BOX = 256, 16, (64, 16)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


# --- arrays derived from the tables, and the same as SQL


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _series(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).select(F.col("event_id").alias("d0"), F.col("value").alias("val"))


def _length(cells: DataFrame, axis: str = "d0") -> int:
    return cells.agg(F.max(axis)).first()[0] + 1


def _chain(spark: SparkSession, d: str) -> DataFrame:
    return versions.daily_chain(_events(spark, d))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("d0"), F.posexplode("embedding").alias("d1", "val")).select("d0", F.col("d1").cast("long").alias("d1"), F.col("val").cast("double").alias("val"))


def _sparse(spark: SparkSession, d: str) -> DataFrame:
    """orders by customer and month (from 1995): whole cents, so that sums are exact."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    return o.groupBy(F.col("o_custkey").alias("d0"), month.cast("long").alias("d1")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("val"))


def _users(spark: SparkSession, d: str) -> DataFrame:
    """v, d0, val: each user's last value as of each day."""
    days = _events(spark, d).groupBy(F.to_date("ts").alias("day"), F.col("user_id").alias("d0")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("val"))
    from pyspark.sql.window import Window

    until = days.withColumn("until", F.lead("day").over(Window.partitionBy("d0").orderBy("day")))
    chain = _chain(spark, d).select("v")
    held = (F.col("v") >= F.col("day")) & (F.col("until").isNull() | (F.col("v") < F.col("until")))
    return until.join(F.broadcast(chain), held).select("v", "d0", "val")  # one row a day: as many as versions


def _growing(spark: SparkSession, d: str) -> DataFrame:
    """v, c0, n, chunk_hash of the array that grows by a day's events a version; one row a chunk meets the versions."""
    e = _events(spark, d).select(C.chunk_of(F.col("event_id"), CHUNK).alias("c0"), F.struct("event_id", "ts", "value").alias("x"))
    per = e.groupBy("c0").agg(F.array_sort(F.collect_list("x")).alias("xs")).withColumn("since", F.to_date(F.element_at("xs", 1)["ts"]))
    chain = _chain(spark, d).select("v", "vts")
    seen = F.filter("xs", lambda x: x["ts"] <= F.col("vts"))
    at = per.join(F.broadcast(chain), F.col("v") >= F.col("since")).withColumn("seen", seen).where(F.size("seen") > 0)
    cells = F.transform("seen", lambda x: x["value"])
    return at.select("v", "c0", F.size("seen").cast("long").alias("n"), portable_digest(cells, F.array(F.size("seen")), "double").alias("chunk_hash"))


_CHAIN = "days AS (SELECT CAST(ts AS DATE) AS v, max(ts) AS vts FROM events GROUP BY 1), chain AS (SELECT v, vts, lag(v) OVER (ORDER BY v) AS prev FROM days)"
_GROWING = _CHAIN + """, growing AS (SELECT v, event_id // 256 AS c0, count(*) AS n,
  sha256(CAST(count(*) AS VARCHAR) || '|' || string_agg(CAST(CAST(value AS DECIMAL(38,6)) AS VARCHAR), ',' ORDER BY event_id)) AS chunk_hash
  FROM chain JOIN events ON ts <= vts GROUP BY 1, 2)"""
_USERS = _CHAIN + ", users AS (SELECT v, user_id AS d0, arg_max(value, (ts, event_id)) AS val FROM chain JOIN events ON ts <= vts GROUP BY 1, 2)"
_MATRIX = "matrix AS (SELECT vec_id AS d0, CAST(unnest(range(len(embedding))) AS BIGINT) AS d1, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings)"
_SPARSE = "sparse AS (SELECT o_custkey AS d0, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS d1, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS val FROM orders GROUP BY 1, 2)"
_MID = "(SELECT min(ts) + INTERVAL 15 DAY FROM events)"


def _mid(spark: SparkSession, d: str):
    return _events(spark, d).agg((F.min("ts") + F.expr("interval 15 days"))).first()[0]


# --- versions


@query(f"WITH {_CHAIN}, pit AS (SELECT max(vts) AS t FROM chain WHERE vts <= {_MID}) SELECT (d0 - 10) // 3 AS o0, val FROM (SELECT user_id AS d0, arg_max(value, (ts, event_id)) AS val FROM events, pit WHERE ts <= t GROUP BY 1) WHERE d0 >= 10 AND d0 < 100 AND (d0 - 10) % 3 = 0")
def asof_snapshot_slice(spark: SparkSession, d: str) -> DataFrame:
    """The last-writer-wins array at the version as of a time, sliced [10:100:3]."""
    chain = _chain(spark, d)
    v = versions.asof(chain, F.lit(_mid(spark, d))).join(chain, "v").first()
    edits = _events(spark, d).where(F.col("ts") <= F.lit(v["vts"])).select(F.col("user_id").alias("d0"), F.col("value").alias("val"), "ts", "event_id")
    wanted = compile_index(slice(10, 100, 3), (_length(edits),))
    return wanted.select(mutate.last_writes(edits.where(wanted.cells()), ["ts", "event_id"]))


@query(f"WITH {_CHAIN} SELECT CAST(v AS VARCHAR) AS v, CAST(prev AS VARCHAR) AS prev FROM chain")
def version_list(spark: SparkSession, d: str) -> DataFrame:
    """All versions with their parents."""
    return _chain(spark, d).select(F.col("v").cast("string").alias("v"), F.col("prev").cast("string").alias("prev"))


@query(f"WITH RECURSIVE {_CHAIN}, a(v, depth) AS (SELECT max(v), 0 FROM chain UNION ALL SELECT c.prev, depth + 1 FROM a JOIN chain c ON c.v = a.v WHERE c.prev IS NOT NULL) SELECT CAST(v AS VARCHAR) AS v, CAST(depth AS BIGINT) AS depth FROM a")
def lineage(spark: SparkSession, d: str) -> DataFrame:
    """Ancestors of the newest version."""
    chain = _chain(spark, d)
    out = versions.lineage(chain, chain.agg(F.max("v")).first()[0])
    return out.select(F.col("v").cast("string").alias("v"), F.col("depth").cast("long").alias("depth"))


@query(f"WITH {_CHAIN} SELECT CAST(v AS VARCHAR) AS v FROM chain ORDER BY v DESC LIMIT 1 OFFSET 7")
def nth_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """The seventh version before the newest."""
    chain = _chain(spark, d)
    return versions.nth_ancestor(chain, chain.agg(F.max("v")).first()[0], 7).select(F.col("v").cast("string").alias("v"))


@query(f"WITH {_CHAIN}, probes AS (SELECT o_orderkey AS k, (SELECT min(ts) FROM events) + CAST(o_orderkey % 800 AS INTEGER) * INTERVAL 1 HOUR - INTERVAL 12 HOUR AS t FROM orders) SELECT k, CAST(v AS VARCHAR) AS v FROM probes ASOF LEFT JOIN chain ON t >= vts")
def asof_many(spark: SparkSession, d: str) -> DataFrame:
    """The version as of each of many times."""
    start = _events(spark, d).agg(F.min("ts")).first()[0]
    hours = F.expr("make_dt_interval(0, int(o_orderkey % 800) - 12, 0, 0)")
    probes = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), (F.lit(start) + hours).alias("t"))
    return versions.asof_join(probes, _chain(spark, d)).select("k", F.col("v").cast("string").alias("v"))


@query(f"WITH {_CHAIN} SELECT CAST(v AS VARCHAR) AS v FROM chain WHERE vts = (SELECT max(ts) FROM events)")
def asof_exact(spark: SparkSession, d: str) -> DataFrame:
    """The version of an exact time."""
    last = _events(spark, d).agg(F.max("ts")).first()[0]
    return versions.asof(_chain(spark, d), F.lit(last), exact=True).select(F.col("v").cast("string").alias("v"))


@query(f"WITH {_CHAIN} SELECT CAST(v AS VARCHAR) AS v FROM chain WHERE vts < (SELECT min(ts) FROM events)")
def asof_before_first(spark: SparkSession, d: str) -> DataFrame:
    """No version is as old as that."""
    first = _events(spark, d).agg(F.min("ts") - F.expr("interval 1 second")).first()[0]
    return versions.asof(_chain(spark, d), F.lit(first)).select(F.col("v").cast("string").alias("v"))


@query(f"WITH {_CHAIN} SELECT CAST(prev AS VARCHAR) AS head FROM chain WHERE v = (SELECT max(v) FROM chain)")
def head_after_drop(spark: SparkSession, d: str) -> DataFrame:
    """HEAD after the newest version is dropped: its parent."""
    chain = _chain(spark, d)
    newest = chain.agg(F.max_by("v", "vts").alias("v"))
    return versions.drop_versions(chain, newest).agg(F.max_by("v", "vts").cast("string").alias("head"))


@query("WITH e AS (SELECT event_type AS branch, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 2) SELECT branch, branch || '@' || CAST(day AS VARCHAR) AS v, coalesce(branch || '@' || CAST(lag(day) OVER (PARTITION BY branch ORDER BY day) AS VARCHAR), 'root') AS prev FROM e")
def branches(spark: SparkSession, d: str) -> DataFrame:
    """A chain for each event type, all from one root."""
    from pyspark.sql.window import Window

    days = _events(spark, d).select(F.col("event_type").alias("branch"), F.to_date("ts").cast("string").alias("day")).distinct()
    before = F.lag("day").over(Window.partitionBy("branch").orderBy("day"))
    return days.select("branch", F.concat_ws("@", "branch", "day").alias("v"), F.coalesce(F.concat(F.col("branch"), F.lit("@"), before), F.lit("root")).alias("prev"))


@query(f"WITH RECURSIVE {_CHAIN}, gone AS (SELECT v FROM chain WHERE day(v) % 3 <> 0), w(v, anc) AS (SELECT v, prev FROM chain WHERE v NOT IN (SELECT v FROM gone) UNION ALL SELECT w.v, c.prev FROM w JOIN chain c ON c.v = w.anc WHERE w.anc IN (SELECT v FROM gone)) SELECT CAST(v AS VARCHAR) AS v, CAST(anc AS VARCHAR) AS prev FROM w WHERE anc IS NULL OR anc NOT IN (SELECT v FROM gone)")
def reparent_after_delete(spark: SparkSession, d: str) -> DataFrame:
    """Parents of the versions that are left when two of three days go."""
    chain = _chain(spark, d)
    out = versions.drop_versions(chain, chain.where(F.dayofmonth("v") % 3 != 0))
    return out.select(F.col("v").cast("string").alias("v"), F.col("prev").cast("string").alias("prev"))


# --- indexing


def _indexed(index, two: bool = False) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        cells = _matrix(spark, d) if two else _series(spark, d)
        shape = (_length(cells), 64) if two else (_length(cells),)
        at = index(shape) if callable(index) else index
        return compile_index(at, shape, BOX if two else (CHUNK,)).select(cells)

    return run


for _name, _index, _two, _text in [
    ("idx_int", 123, False, "SELECT value AS val FROM events WHERE event_id = 123"),
    ("idx_neg_int", -2, False, "SELECT value AS val FROM events WHERE event_id = (SELECT max(event_id) - 1 FROM events)"),
    ("idx_slice", slice(100, 200), False, "SELECT event_id - 100 AS o0, value AS val FROM events WHERE event_id BETWEEN 100 AND 199"),
    ("idx_step", slice(10, 900, 7), False, "SELECT (event_id - 10) // 7 AS o0, value AS val FROM events WHERE event_id BETWEEN 10 AND 899 AND (event_id - 10) % 7 = 0"),
    ("idx_neg", slice(-50, None), False, "SELECT event_id - (SELECT max(event_id) - 49 FROM events) AS o0, value AS val FROM events WHERE event_id > (SELECT max(event_id) - 50 FROM events)"),
    ("idx_all", Ellipsis, False, "SELECT event_id AS o0, value AS val FROM events"),
    ("idx_empty", slice(5, 5), False, "SELECT event_id AS o0, value AS val FROM events WHERE false"),
    ("idx_fancy", [5, 3, 3, 999], False, "SELECT o0, value AS val FROM (VALUES (0::BIGINT, 5), (1, 3), (2, 3), (3, 999)) t(o0, d0) JOIN events ON event_id = d0"),
    ("idx_fancy_range", list(range(20, 400, 5)), False, "SELECT (event_id - 20) // 5 AS o0, value AS val FROM events WHERE event_id BETWEEN 20 AND 399 AND (event_id - 20) % 5 = 0"),
    ("idx_2d", (slice(10, 100, 3), slice(5, 60, 5)), True, f"WITH {_MATRIX} SELECT (d0 - 10) // 3 AS o0, (d1 - 5) // 5 AS o1, val FROM matrix WHERE d0 BETWEEN 10 AND 99 AND (d0 - 10) % 3 = 0 AND d1 BETWEEN 5 AND 59 AND (d1 - 5) % 5 = 0"),
    ("idx_2d_row", 7, True, f"WITH {_MATRIX} SELECT d1 AS o0, val FROM matrix WHERE d0 = 7"),
    ("idx_ellipsis", (Ellipsis, 3), True, f"WITH {_MATRIX} SELECT d0 AS o0, val FROM matrix WHERE d1 = 3"),
    ("idx_2d_fancy", (slice(0, 50), [63, 0, 63]), True, f"WITH {_MATRIX} SELECT d0 AS o0, o1, val FROM matrix JOIN (VALUES (0::BIGINT, 63), (1, 0), (2, 63)) t(o1, p) ON d1 = p WHERE d0 < 50"),
]:
    _f = _indexed(_index, _two)
    _f.__name__, _f.__doc__ = _name, f"array[{scalars.show_index(_index)}]"
    query(_text)(_f)


@query("SELECT row_number() OVER (ORDER BY event_id) - 1 AS o0, value AS val FROM events WHERE event_type = 'click'")
def idx_mask(spark: SparkSession, d: str) -> DataFrame:
    """The array under a boolean mask that another column gives."""
    e = _events(spark, d)
    return select.masked(_series(spark, d), e.select(F.col("event_id").alias("d0"), (F.col("event_type") == "click").alias("on")))


@query("SELECT event_id - 50 AS o0, event_type, value FROM events WHERE event_id BETWEEN 50 AND 149")
def idx_field(spark: SparkSession, d: str) -> DataFrame:
    """Two fields of a slice of an array of records."""
    e = _events(spark, d)
    records = e.select(F.col("event_id").alias("d0"), F.struct("user_id", "event_type", "value").alias("val"))
    return compile_index(slice(50, 150), (_length(records),)).select(records).select("o0", "val.event_type", "val.value")


@query(f"WITH {_MATRIX} SELECT a.o AS o0, b.o AS o1, val FROM matrix JOIN (VALUES (0::BIGINT, 9), (1, 2), (2, 9)) a(o, p) ON d0 = a.p JOIN (VALUES (0::BIGINT, 1), (1, 40)) b(o, p) ON d1 = b.p")
def idx_product(spark: SparkSession, d: str) -> DataFrame:
    """Lists on both axes, as a product."""
    cells = _matrix(spark, d)
    return product_index(([9, 2, 9], [1, 40]), (_length(cells), 64), BOX).select(cells)


@query("SELECT event_id - 300 AS o0, value AS val FROM events WHERE event_id BETWEEN 300 AND 799")
def idx_chunk_pruned(spark: SparkSession, d: str) -> DataFrame:
    """A slice read from chunks, of which only those that it touches are unpacked."""
    cells = _series(spark, d)
    n = _length(cells)
    wanted = compile_index(slice(300, 800), (n,), (CHUNK,))
    kept = cells.withColumn("c0", C.chunk_of(F.col("d0"), CHUNK)).where(wanted.touched()).drop("c0")
    return wanted.select(C.assemble(C.chunk_cells(kept, (n,), (CHUNK,)), (CHUNK,)))


@query("WITH h AS (SELECT event_id // 256 AS c0, count(*) AS hits FROM events WHERE event_id BETWEEN 100 AND 899 GROUP BY 1) SELECT c0, hits, hits = (SELECT count(*) FROM events WHERE event_id // 256 = h.c0) AS whole FROM h")
def chunk_whole_partial(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that a slice takes in full or in part."""
    cells = _series(spark, d)
    return C.hits_by_chunk(cells.where(F.col("d0").between(100, 899)), (_length(cells),), (CHUNK,))


@query("SELECT event_id AS a, CASE WHEN user_id <= event_id % 50 THEN 0 ELSE (user_id - event_id % 50 - 1) // (1 + event_id % 7) + 1 END AS n, CASE WHEN event_id % 5 = 0 THEN user_id ELSE user_id + (event_id % 5 - 1) * (1 + event_id % 7) + 1 END AS stop, (event_id + 255) // 256 AS up, event_id % 50 + ((user_id + 49) // (1 + event_id % 7) + CASE WHEN (user_id + 49) % (1 + event_id % 7) > 0 THEN 1 ELSE 0 END) * (1 + event_id % 7) AS step FROM events")
def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    """Counts, stops, quotients rounded up and steps, for many ranges."""
    e = _events(spark, d)
    start, step = F.col("event_id") % 50, 1 + F.col("event_id") % 7
    return e.select(
        F.col("event_id").alias("a"), scalars.range_length(start, F.col("user_id"), step).alias("n"), scalars.range_end(F.col("user_id"), F.col("event_id") % 5, step).alias("stop"),
        scalars.ceil_div(F.col("event_id"), F.lit(256)).cast("long").alias("up"), scalars.next_on_grid(start + F.col("user_id") + 49, start, step).alias("step"),
    )


@query(f"WITH {_CHAIN} SELECT CAST(v AS VARCHAR) AS v, max(event_id) + 1 AS length, (max(event_id) + 256) // 256 AS chunks, (max(event_id) + 1) * 8 AS bytes FROM chain JOIN events ON ts <= vts GROUP BY 1")
def version_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Length, number of chunks and bytes of the growing array in every version; a running maximum over days."""
    from pyspark.sql.window import Window

    days = _events(spark, d).groupBy(F.to_date("ts").alias("v")).agg(F.max("event_id").alias("last"))
    n = F.max("last").over(Window.orderBy("v")) + 1
    return days.select(F.col("v").cast("string").alias("v"), n.alias("length"), scalars.ceil_div(n, F.lit(CHUNK)).cast("long").alias("chunks"), (n * 8).alias("bytes"))


@query(f"WITH {_CHAIN} SELECT user_id, min(ts) IS NULL OR min(ts) > (SELECT max(vts) FROM chain) AS empty FROM events GROUP BY 1")
def empty_datasets(spark: SparkSession, d: str) -> DataFrame:
    """Users whose array has no cell in any version: those whose first event no version reaches."""
    chain = _chain(spark, d).agg(F.max("vts").alias("until"))
    firsts = _events(spark, d).groupBy("user_id").agg(F.min("ts").alias("first"))
    return firsts.crossJoin(F.broadcast(chain)).select("user_id", F.coalesce(F.col("first") > F.col("until"), F.lit(True)).alias("empty"))


@query("SELECT DISTINCT source AS path FROM documents UNION SELECT DISTINCT lang FROM documents")
def members_union(spark: SparkSession, d: str) -> DataFrame:
    """Names of staged members (sources) and of stored ones (languages), each once."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select(F.col("source").alias("path")).union(docs.select("lang")).distinct()


# --- chunks, digests, deduplication


@query(f"WITH {_MATRIX} SELECT d0 // 64 AS c0, d1 // 16 AS c1, count(*) AS n, min(val) AS low, max(val) AS high FROM matrix GROUP BY 1, 2")
def chunk_grid_2d(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of a matrix, whose last row of chunks is cut by the edge."""
    cells = _matrix(spark, d)
    out = C.chunk_cells(cells, (_length(cells), 64), BOX, keep_fill=True)
    return out.select("c0", "c1", F.size("cells").cast("long").alias("n"), F.array_min("cells").alias("low"), F.array_max("cells").alias("high"))


@query("SELECT event_id // 256 AS c0, count(*) AS n, sha256(CAST(count(*) AS VARCHAR) || '|' || string_agg(CAST(CAST(value AS DECIMAL(38,6)) AS VARCHAR), ',' ORDER BY event_id)) AS chunk_hash FROM events GROUP BY 1")
def chunk_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digests of a series' chunks."""
    cells = _series(spark, d)
    out = C.hash_chunks(C.chunk_cells(cells, (_length(cells),), (CHUNK,), keep_fill=True))
    return out.select("c0", F.size("cells").cast("long").alias("n"), "chunk_hash")


@query(f"WITH {_MATRIX} SELECT d0, d1, val FROM matrix")
def chunk_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Cells to chunks and back."""
    cells = _matrix(spark, d)
    return C.assemble(C.chunk_cells(cells, (_length(cells), 64), BOX, fill=0.0, keep_fill=True), BOX)


@query("SELECT sha256(text) AS chunk_hash, min(doc_id) AS d0, count(*) AS n FROM documents GROUP BY 1")
def dedup_first_writer(spark: SparkSession, d: str) -> DataFrame:
    """Strings by digest: the first writer of each, and how many there were; counted before the shuffle."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.groupBy(F.sha2("text", 256).alias("chunk_hash")).agg(F.min("doc_id").alias("d0"), F.count("*").alias("n"))


@query("WITH a AS (SELECT doc_id AS d0, sha256(text) AS h, CASE WHEN source < 'src1' THEN 0 WHEN source < 'src2' THEN 1 ELSE 2 END AS origin FROM documents) SELECT h AS chunk_hash, min(origin) AS origin, arg_min(d0, (origin, d0)) AS d0 FROM a GROUP BY 1")
def dedup_priority(spark: SparkSession, d: str) -> DataFrame:
    """One place for each digest: fill before base before staged, then the first."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    origin = F.when(F.col("source") < "src1", 0).when(F.col("source") < "src2", 1).otherwise(2)
    found = docs.select(F.sha2("text", 256).alias("chunk_hash"), origin.alias("origin"), F.col("doc_id").alias("d0"))
    return C.dedup(found, order=["origin", "d0"])


@query(f"WITH {_GROWING}, first AS (SELECT chunk_hash, min(v) AS born FROM growing GROUP BY 1) SELECT CAST(v AS VARCHAR) AS v, count(*) FILTER (v = born) AS written, count(*) FILTER (v <> born) AS reused FROM growing JOIN first USING (chunk_hash) GROUP BY 1")
def dedup_stats(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written and reused by each version of the growing array."""
    g = _growing(spark, d)
    born = g.groupBy("chunk_hash").agg(F.min("v").alias("born"))
    return g.join(born, "chunk_hash").groupBy(F.col("v").cast("string").alias("v")).agg(F.count_if(F.col("v") == F.col("born")).alias("written"), F.count_if(F.col("v") != F.col("born")).alias("reused"))


@query(f"WITH {_GROWING}, one AS (SELECT chunk_hash, count(*) AS refs, max(n) AS n FROM growing GROUP BY 1) SELECT CAST(sum(refs) AS BIGINT) AS refs, count(*) AS chunks, CAST(sum(refs * n) AS BIGINT) AS logical_cells, CAST(sum(n) AS BIGINT) AS stored_cells FROM one")
def dedup_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Cells that all versions show, and cells that are stored."""
    return history.storage(_growing(spark, d), F.col("n"))


@query(f"WITH {_GROWING}, old AS (SELECT DISTINCT chunk_hash FROM growing WHERE v < (SELECT max(v) FROM chain)) SELECT c0, n, chunk_hash, chunk_hash IN (SELECT chunk_hash FROM old) AS known FROM growing WHERE v = (SELECT max(v) FROM chain)")
def commit_plan(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of the newest version: known ones, which are referred to, and unknown ones, which a commit appends."""
    g = _growing(spark, d)
    last = _chain(spark, d).agg(F.max("v")).first()[0]
    new, pool = g.where(F.col("v") == F.lit(last)).drop("v"), g.where(F.col("v") < F.lit(last)).select("chunk_hash").distinct()
    return C.unknown(new, pool).withColumn("known", F.lit(False)).unionByName(C.reused(new, pool).withColumn("known", F.lit(True)))


@query(f"WITH {_SPARSE}, have AS (SELECT DISTINCT d0 // 32 AS c0, d1 // 12 AS c1 FROM sparse), g AS (SELECT CAST(a AS BIGINT) AS c0, CAST(b AS BIGINT) AS c1 FROM range((SELECT max(d0) // 32 + 1 FROM sparse)) x(a), range(7) y(b)) SELECT g.c0, g.c1, have.c0 IS NULL AS fill FROM g LEFT JOIN have ON g.c0 = have.c0 AND g.c1 = have.c1")
def manifest_with_fill(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of a sparse array, with those that are only fill."""
    cells = _sparse(spark, d)
    n = _length(cells)
    stored = C.chunk_cells(cells, (n, 84), (32, 12)).select("c0", "c1", F.lit(False).alias("stored"))
    rows = -(-n // 32) * 32
    return C.grid(spark, (rows, 84), (32, 12)).drop("extent").join(stored, ["c0", "c1"], "left").select("c0", "c1", F.coalesce("stored", F.lit(True)).alias("fill"))


@query(f"WITH {_GROWING} SELECT c0, n, chunk_hash FROM growing WHERE v = (SELECT max(v) FROM chain WHERE vts <= {_MID})")
def manifest_at_version(spark: SparkSession, d: str) -> DataFrame:
    """The chunks that the version as of a time refers to."""
    v = versions.asof(_chain(spark, d), F.lit(_mid(spark, d))).first()["v"]
    return _growing(spark, d).where(F.col("v") == F.lit(v)).drop("v")


# --- edits


@query("WITH u AS (SELECT event_id AS d0, value * 2 AS val FROM events WHERE event_type = 'purchase') SELECT event_id AS d0, coalesce(u.val, value) AS val FROM events LEFT JOIN u ON d0 = event_id")
def setitem_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Some cells replaced by staged ones."""
    staged = _events(spark, d).where("event_type = 'purchase'").select(F.col("event_id").alias("d0"), (F.col("value") * 2).alias("val"))
    return mutate.overlay(_series(spark, d), staged)


@query("SELECT event_id AS d0, CASE WHEN event_id BETWEEN 256 AND 899 THEN -1.0 ELSE value END AS val FROM events")
def setitem_whole_chunk(spark: SparkSession, d: str) -> DataFrame:
    """A slice that covers chunks in full: those are not read from the base."""
    base = _series(spark, d)
    wanted = compile_index(slice(256, 900), (_length(base),), (CHUNK,))
    return mutate.set_whole_chunks(base, base.where(wanted.cells()).withColumn("val", F.lit(-1.0)), (CHUNK,), wanted.whole())


@query(f"WITH {_MATRIX} SELECT d0, d1, CASE WHEN d0 % 2 = 0 AND d0 < 100 AND d1 = 5 THEN 0.5 ELSE val END AS val FROM matrix")
def setitem_broadcast(spark: SparkSession, d: str) -> DataFrame:
    """One value for a strided column."""
    cells = _matrix(spark, d)
    return mutate.set_where(cells, compile_index((slice(0, 100, 2), 5), (_length(cells), 64)).cells(), F.lit(0.5))


@query("SELECT user_id AS d0, arg_max(value, (ts, event_id)) AS val FROM events GROUP BY 1")
def last_writes(spark: SparkSession, d: str) -> DataFrame:
    """The last of many edits of each cell."""
    e = _events(spark, d).select(F.col("user_id").alias("d0"), F.col("value").alias("val"), "ts", "event_id")
    return mutate.last_writes(e, ["ts", "event_id"])


@query(f"WITH {_MATRIX} SELECT d0, d1, val FROM matrix WHERE d0 < 101 AND d1 < 33")
def resize_shrink(spark: SparkSession, d: str) -> DataFrame:
    """A smaller shape on both axes."""
    return mutate.resize(_matrix(spark, d), (101, 33))


@query("SELECT x AS d0, CAST(coalesce(value, 5.0) AS DOUBLE) AS val FROM range((SELECT max(event_id) + 301 FROM events)) t(x) LEFT JOIN events ON event_id = x")
def resize_enlarge(spark: SparkSession, d: str) -> DataFrame:
    """A larger shape, in full: new cells hold fill."""
    cells = _series(spark, d)
    n = _length(cells) + 300
    return C.dense_cells(mutate.resize(cells, (n,)), (n,), fill=5.0)


@query("SELECT event_id AS d0, value AS val FROM events UNION ALL SELECT event_id + (SELECT max(event_id) + 1 FROM events), -value FROM events WHERE event_id < 100")
def append_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows put behind the last."""
    cells = _series(spark, d)
    return mutate.append_rows(cells, cells.where("d0 < 100").withColumn("val", -F.col("val")), _length(cells))


@query("SELECT CASE WHEN event_id >= 500 THEN event_id + 10 ELSE event_id END AS d0, value AS val FROM events UNION ALL SELECT event_id + 500, 0.0 FROM events WHERE event_id < 10")
def insert_middle(spark: SparkSession, d: str) -> DataFrame:
    """Ten rows put in before position 500."""
    cells = _series(spark, d)
    return mutate.insert_rows(cells, cells.where("d0 < 10").withColumn("val", F.lit(0.0)), 500, 10)


@query("SELECT CASE WHEN event_id >= 600 THEN event_id - 100 ELSE event_id END AS d0, value AS val FROM events WHERE event_id < 500 OR event_id >= 600")
def delete_middle(spark: SparkSession, d: str) -> DataFrame:
    """A hundred rows taken out."""
    return mutate.delete_rows(_series(spark, d), 500, 600)


_LABELS = "l AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS label, l_returnflag, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS val FROM lineitem GROUP BY 1, 2), ax AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS d0 FROM (SELECT DISTINCT label FROM l WHERE l_returnflag IN ('A', 'N')))"


@query(f"WITH {_LABELS} SELECT d0, l_returnflag AS part, val FROM l JOIN ax USING (label) WHERE l_returnflag IN ('A', 'N')")
def axis_union(spark: SparkSession, d: str) -> DataFrame:
    """Two arrays over months, scattered onto the union of their axes."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    label = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    cells = li.groupBy(label.alias("label"), F.col("l_returnflag").alias("part")).agg(F.sum(F.round("l_quantity").cast("long")).alias("val"))
    old, new = cells.where("part = 'A'"), cells.where("part = 'N'")
    axis = mutate.axis_union(old, new)
    return mutate.scatter(old.unionByName(new), axis).select("d0", "part", "val")


@query("SELECT event_id AS d0, CAST(trunc(value) AS BIGINT) AS val FROM events")
def astype_int(spark: SparkSession, d: str) -> DataFrame:
    """Values as whole numbers, cut towards zero."""
    return mutate.astype(_series(spark, d), "bigint")


@query("SELECT p_partkey AS d0, CASE WHEN p_size = 1 THEN 99 ELSE p_size END AS val FROM part")
def refill(spark: SparkSession, d: str) -> DataFrame:
    """Cells that hold the old fill value get the new one."""
    return mutate.refill(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("d0"), F.col("p_size").alias("val")), 1, 99)


@query("SELECT event_id // 100 AS c0, count(*) AS n, sha256(CAST(count(*) AS VARCHAR) || '|' || string_agg(CAST(CAST(value AS DECIMAL(38,6)) AS VARCHAR), ',' ORDER BY event_id)) AS chunk_hash FROM events GROUP BY 1")
def rechunk(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 256 cut anew into chunks of 100."""
    cells = _series(spark, d)
    n = _length(cells)
    old = C.chunk_cells(cells, (n,), (CHUNK,), keep_fill=True)
    out = C.hash_chunks(C.chunk_cells(C.assemble(old, (CHUNK,)), (n,), (100,), keep_fill=True))
    return out.select("c0", F.size("cells").cast("long").alias("n"), "chunk_hash")


@query("SELECT event_id // 256 AS c0, CASE WHEN bool_or(event_id BETWEEN 300 AND 700) THEN 'staged' ELSE 'base' END AS origin, count(*) AS n FROM events GROUP BY 1")
def changes(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that a staged slice touches, and the rest from the base."""
    cells = _series(spark, d)
    n = _length(cells)
    wanted = compile_index(slice(300, 701), (n,), (CHUNK,))
    base = C.chunk_cells(cells, (n,), (CHUNK,), keep_fill=True)
    touched = cells.withColumn("c0", C.chunk_of(F.col("d0"), CHUNK)).where(wanted.touched()).drop("c0")
    staged = C.chunk_cells(mutate.set_where(touched, wanted.cells(), F.lit(0.0)), (n,), (CHUNK,), keep_fill=True)
    return mutate.changes(base, staged, ["c0"]).select("c0", "origin", F.size("cells").cast("long").alias("n"))


# --- differences and history


_USER_CHUNKS = _USERS + ", uc AS (SELECT v, d0 // 16 AS c0, count(*) AS n, sha256(CAST(count(*) AS VARCHAR) || '|' || string_agg(CAST(d0 AS VARCHAR) || '=' || CAST(CAST(val AS DECIMAL(38,6)) AS VARCHAR), ',' ORDER BY d0)) AS chunk_hash FROM users GROUP BY 1, 2)"


def _user_chunks(spark: SparkSession, d: str) -> DataFrame:
    u = _users(spark, d).groupBy("v", C.chunk_of(F.col("d0"), USERS).alias("c0")).agg(F.array_sort(F.collect_list(F.struct("d0", "val"))).alias("x"))
    text = F.array_join(F.transform("x", lambda x: F.concat(x["d0"].cast("string"), F.lit("="), x["val"].cast("decimal(38,6)").cast("string"))), ",")
    return u.select("v", "c0", F.size("x").cast("long").alias("n"), F.sha2(F.concat_ws("|", F.size("x").cast("string"), text), 256).alias("chunk_hash"))


@query(f"WITH {_USER_CHUNKS}, a AS (SELECT * FROM uc WHERE v = (SELECT min(v) FROM chain)), b AS (SELECT * FROM uc WHERE v = (SELECT max(v) FROM chain)) SELECT coalesce(a.c0, b.c0) AS c0, coalesce(a.n, b.n) AS n, CASE WHEN a.c0 IS NULL THEN 'added' WHEN b.c0 IS NULL THEN 'deleted' ELSE 'modified' END AS change, a.chunk_hash AS old_hash, b.chunk_hash AS new_hash FROM a FULL JOIN b ON a.c0 = b.c0 AND a.n = b.n WHERE a.chunk_hash IS DISTINCT FROM b.chunk_hash")
def chunk_diff(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that differ between the first and the last version; the extent is part of a chunk's place."""
    u = _user_chunks(spark, d)
    first, last = _chain(spark, d).agg(F.min("v"), F.max("v")).first()
    return diff.chunk_diff(u.where(F.col("v") == F.lit(first)), u.where(F.col("v") == F.lit(last)), ["c0", "n"])


@query(f"WITH {_USERS}, a AS (SELECT * FROM users WHERE v = (SELECT min(v) FROM chain)), b AS (SELECT * FROM users WHERE v = (SELECT max(v) FROM chain)) SELECT coalesce(a.d0, b.d0) AS d0, CASE WHEN a.d0 IS NULL THEN 'added' WHEN b.d0 IS NULL THEN 'deleted' ELSE 'modified' END AS change, a.val AS old_val, b.val AS new_val FROM a FULL JOIN b ON a.d0 = b.d0 WHERE a.val IS DISTINCT FROM b.val")
def cell_diff(spark: SparkSession, d: str) -> DataFrame:
    """Cells that differ between the first and the last version."""
    u = _users(spark, d)
    first, last = _chain(spark, d).agg(F.min("v"), F.max("v")).first()
    return diff.cell_diff(u.where(F.col("v") == F.lit(first)), u.where(F.col("v") == F.lit(last)), ["d0"])


@query(f"WITH {_GROWING}, p AS (SELECT v, lag(v) OVER (ORDER BY v) AS prev FROM chain), x AS (SELECT g.*, p.prev FROM growing g JOIN p USING (v)) SELECT CAST(coalesce(b.v, a2.v) AS VARCHAR) AS v, coalesce(b.c0, a2.c0) AS c0, coalesce(b.n, a2.n) AS n, CASE WHEN a2.c0 IS NULL THEN 'added' WHEN b.c0 IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM x b FULL JOIN (SELECT p.v, a.c0, a.n, a.chunk_hash FROM growing a JOIN p ON p.prev = a.v) a2 ON b.v = a2.v AND b.c0 = a2.c0 AND b.n = a2.n WHERE b.chunk_hash IS DISTINCT FROM a2.chunk_hash")
def diff_resized_edge(spark: SparkSession, d: str) -> DataFrame:
    """Differences of every version to its parent as the array grows: a longer edge is a deletion and an addition."""
    g = _growing(spark, d)
    chain = _chain(spark, d).select("v", "prev")
    before = g.withColumnRenamed("v", "prev").join(F.broadcast(chain), "prev").drop("prev")
    out = diff.chunk_diff(before, g, ["v", "c0", "n"])
    return out.select(F.col("v").cast("string").alias("v"), "c0", "n", "change")


@query(f"WITH {_GROWING} SELECT DISTINCT chunk_hash FROM growing WHERE day(v) % 10 = 0")
def gc_live_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that the versions to keep refer to."""
    return history.live_chunks(_growing(spark, d), _chain(spark, d).where(F.dayofmonth("v") % 10 == 0))


@query(f"WITH {_GROWING} SELECT DISTINCT chunk_hash FROM growing WHERE chunk_hash NOT IN (SELECT chunk_hash FROM growing WHERE day(v) % 10 = 0)")
def gc_reclaimed(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that go with the other versions."""
    return history.reclaimed(_growing(spark, d), _chain(spark, d).where(F.dayofmonth("v") % 10 == 0))


@query(f"WITH {_USERS} SELECT CAST(v AS VARCHAR) AS v, d0, CAST(trunc(CASE WHEN val = 0 THEN -1 ELSE val END) AS BIGINT) AS val FROM users")
def modify_metadata_all_versions(spark: SparkSession, d: str) -> DataFrame:
    """Another fill value and element type for all versions, as one plan."""
    changed = history.replay(_users(spark, d), lambda x: mutate.astype(mutate.refill(x, 0.0, -1.0), "bigint"))
    return changed.withColumn("v", F.col("v").cast("string"))


@query("SELECT event_id // 256 AS c0 FROM events WHERE event_id // 256 % 4 = 1 GROUP BY 1")
def fsck_rehash(spark: SparkSession, d: str) -> DataFrame:
    """A check of all digests finds the chunks that were damaged."""
    cells = _series(spark, d)
    stored = C.hash_chunks(C.chunk_cells(cells, (_length(cells),), (CHUNK,), keep_fill=True))
    damaged = stored.withColumn("cells", F.when(F.col("c0") % 4 == 1, F.transform("cells", lambda x, i: F.when(i == 0, x + 1).otherwise(x))).otherwise(F.col("cells")))
    return history.check_digests(damaged, C.hash_chunks).select("c0")


@query("WITH p AS (SELECT DISTINCT 'raw/' || source || '/' || lang AS path FROM documents) SELECT path, 'raw/' || split_part(path, '/', 2) AS parent, replace(path, 'raw/src1/', 'moved/') AS moved FROM p WHERE path LIKE 'raw/src1/%'")
def namespace(spark: SparkSession, d: str) -> DataFrame:
    """Datasets below a group, their parents, and their paths once the group has moved."""
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.col("source").isNotNull() & F.col("lang").isNotNull())
    paths = docs.select(F.concat_ws("/", F.lit("raw"), "source", "lang").alias("path")).distinct()
    return paths.where(scalars.under(F.col("path"), "raw/src1")).select("path", scalars.parent_path(F.col("path")).alias("parent"), scalars.move_prefix(F.col("path"), "raw/src1", "moved").alias("moved"))


@query(f"WITH {_SPARSE} SELECT d0, d1, val FROM sparse WHERE d0 BETWEEN 10 AND 60 AND d1 < 24")
def sparse_read(spark: SparkSession, d: str) -> DataFrame:
    """A box of a sparse array: only stored cells come up."""
    cells = _sparse(spark, d)
    wanted = compile_index((slice(10, 61), slice(0, 24)), (_length(cells), 84), (32, 12))
    return cells.where(wanted.cells())


# --- beyond SQL: raw bytes, files, callbacks


@query()
def hash_exact_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Digests over raw bytes of a matrix' chunks."""
    cells = _matrix(spark, d)
    out = C.chunk_cells(cells, (_length(cells), 64), BOX, keep_fill=True)
    return out.select("c0", "c1", exact_digest(F.col("cells"), F.col("extent"), "double").alias("chunk_hash"))


def _store(spark: SparkSession, d: str):
    """All versions of the daily chain. A day whose events lie behind the last is appended; any other is put whole."""
    import datetime

    from chunkloom.sources.store import VersionStore, scratch

    store = VersionStore(spark, scratch(spark))
    e = _events(spark, d)
    days = e.where("ts is not null").groupBy(F.to_date("ts").alias("v")).agg(F.min("event_id").alias("low"), F.max("event_id").alias("high")).orderBy("v").collect()
    n = 0
    for v, low, high in days:
        end = v + datetime.timedelta(days=1)
        with store.stage(str(v)) as s:
            if n and low >= n:
                rows = e.where((F.col("ts") >= F.lit(v)) & (F.col("ts") < F.lit(end))).select((F.col("event_id") - n).alias("d0"), F.col("value").alias("val"))
                s.append("series/value", rows, high + 1 - n)
            else:
                cells = e.where(F.col("ts") < F.lit(end)).select(F.col("event_id").alias("d0"), F.col("value").alias("val"))
                s.put("series/value", cells, (max(n, high + 1),), chunks=(CHUNK,))
        n = max(n, high + 1)
    return store


_KNOWN = "days AS (SELECT DISTINCT CAST(ts AS DATE) AS v FROM events WHERE ts IS NOT NULL)"


@query(
    f"""WITH {_KNOWN}, known AS (SELECT event_id, value FROM events WHERE CAST(ts AS DATE) <= (SELECT max(v) FROM days WHERE v < (SELECT max(v) FROM days)))
    SELECT o.o0, CASE WHEN k.event_id IS NULL THEN 0 ELSE k.value END AS val
    FROM (SELECT unnest(range(0, 97)) AS o0) o LEFT JOIN known k ON k.event_id = 10 + 3 * o.o0"""
)
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A slice of the version before the newest, of one version a day, read back from a store."""
    return _store(spark, d)[-1]["series/value"][10:300:3]


@query(
    """SELECT p.d0, CASE WHEN e.event_id IS NULL THEN 0 ELSE e.value * 2 END AS val
    FROM (SELECT unnest(range(0, (SELECT max(event_id) + 1 FROM events WHERE ts IS NOT NULL))) AS d0) p
    LEFT JOIN events e ON e.event_id = p.d0 AND e.ts IS NOT NULL"""
)
def replay_callback(spark: SparkSession, d: str) -> DataFrame:
    """The newest version after all cells of all days' versions went through a callback, each distinct chunk once."""
    store = _store(spark, d)
    store.transform("series/value", lambda x: x * 2)
    return store[0]["series/value"].cells()


def queries() -> dict[str, Query]:
    """Name to query."""
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    return dict(_sql)
