"""Small files beside Parquet tables, through Hadoop's file systems, so that any store that Spark reads will do."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Files:
    """File operations below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        where, fs = self._at(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        where, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def read(self, path: str) -> str:
        where, fs = self._at(path)
        stream = fs.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a file that appears at once and whole; False if there is one of that name, or one is being written.

        The name is claimed by creating an empty file without leave to overwrite, which one writer only is granted by
        file systems with a name server and by object stores with conditional writes. A writer that dies between its
        claim and its file leaves the claim, which then has to be deleted by hand.
        """
        claim, fs = self._at(f"{path}.claim")
        try:
            fs.create(claim, False).close()
        except Exception:
            if fs.exists(claim):  # which exception says that a file exists differs from store to store
                return False
            raise
        try:
            where, _ = self._at(path)
            if fs.exists(where):
                return False
            half, _ = self._at(f"{path}.{uuid.uuid4().hex}.tmp")
            stream = fs.create(half, False)
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()
            return bool(fs.rename(half, where))
        finally:
            fs.delete(claim, False)

    def delete(self, path: str) -> None:
        where, fs = self._at(path)
        fs.delete(where, True)


def scratch(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir, or in local tests below a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or "cluster" in master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='chunkloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written to a scratch folder and read again, which ends its lineage."""
    where = scratch(df.sparkSession)
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)
