"""Token counts through a digest cache.

The cache is a Parquet table (tokenizer, content, n_tokens), parted by the tokenizer-version digest. Counting joins the
digests of contents to it, encodes one row of each content that it lacks, appends those counts, and joins again.
"""

from __future__ import annotations

import os
import uuid
from hashlib import sha256
from importlib.metadata import version

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkloom.llm._common import batches, held_by_worker, settle, shared_dir

SCHEMA = "content binary, n_tokens long, tokenizer string"


def library(path: str) -> str:
    """The library that reads a tokenizer file: by its ending."""
    ending = path.rsplit(".", 1)[-1]
    if ending not in ("json", "model"):
        raise ValueError(f"no library is known for .{ending} files")
    return {"json": "tokenizers", "model": "sentencepiece"}[ending]


def tokenizer_digest(path: str) -> str:
    """Digest of the file's contents, the library and its version: counts made with another are never taken over."""
    with open(path, "rb") as f:
        return sha256(b"\0".join([f.read(), library(path).encode(), version(library(path)).encode(), b"plain text, no added tokens"])).hexdigest()


def _counter(kind: str, file: bytes):
    return held_by_worker(("counter", kind, sha256(file).digest()), lambda: _made(kind, file))


def _made(kind: str, file: bytes):
    if kind == "sentencepiece":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=file)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(file.decode())
    model.no_truncation()
    model.no_padding()
    batch = getattr(model, "encode_batch_fast", model.encode_batch)
    return lambda texts: [len(x.ids) for x in batch(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every document.

    Contents are normalised by taking null as empty, and no further, since any other change could alter a count. The
    cache lies at cache_path; with None it starts empty in the shared folder. Repeated rows, with or without an id, are
    each answered; equal contents are encoded once. Other columns are ignored.
    """
    spark, kind, ours = docs.sparkSession, library(tokenizer), tokenizer_digest(tokenizer)
    cache_path = cache_path or f"{shared_dir(spark)}/chunkloom-counts-{uuid.uuid4().hex}"
    with open(tokenizer, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    keyed = settle(slim.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "digests")

    spark.createDataFrame([], SCHEMA).write.mode("ignore").partitionBy("tokenizer").parquet(cache_path)
    stored = spark.read.schema(SCHEMA).parquet(cache_path).where(F.col("tokenizer") == ours).select("content", "n_tokens")
    firsts = keyed.groupBy("content").agg(F.min("doc_id").alias("first"))
    misses = firsts.join(stored, "content", "left_anti").withColumnRenamed("content", "missing")
    texts = slim.join(misses, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("content") == F.col("missing")), "left_semi").select("content", "text")

    def count(parts):
        import pyarrow as pa

        counts, met = _counter(kind, file.value), set()
        for part in parts:
            content = part.column("content").to_pylist()
            fresh = [i for i, c in enumerate(content) if c not in met and not met.add(c)]  # an id may repeat with its text
            part = part.take(pa.array(fresh, pa.int64()))
            n = [c for _, texts in batches(part.column("text")) for c in counts(texts)]
            yield pa.RecordBatch.from_arrays([part.column("content"), pa.array(n, pa.int64())], ["content", "n_tokens"])

    texts.mapInArrow(count, "content binary, n_tokens long").dropDuplicates(["content"]).withColumn("tokenizer", F.lit(ours)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    spark.catalog.refreshByPath(cache_path)
    now = spark.read.schema(SCHEMA).parquet(cache_path).where(F.col("tokenizer") == ours)
    counts = now.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))  # a content may be stored twice, never with two counts
    return keyed.join(counts, "content", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
