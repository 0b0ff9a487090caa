"""A store of versions: arrays as immutable manifests of content-addressed chunks, in Parquet.

    root/meta/000000000001.json      versions, HEAD, datasets; the highest number counts, and is written last
    root/chunks/<dataset>/<part>/    chunks that a commit added: chunk_hash, extent, cells, in order of chunk_hash
    root/manifest/<dataset>/<commit>/  a version's chunks: c0, ..., extent, chunk_hash, and the part that holds each

A read opens the manifest, and of the chunks only the parts that the wanted ones are in.

A commit that fails leaves files that no metadata names, which are never read. There is one writer: publishing fails if
another has published meanwhile. Chunks are looked up by digest among all of a dataset's, of all versions and branches.
"""

from __future__ import annotations

import contextlib
import datetime
import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from chunkloom.functions.hashing import BYTES
from chunkloom.functions.scalars import compatible, new_version_name, utc
from chunkloom.operators import chunks as C
from chunkloom.operators import diff, mutate
from chunkloom.plans.index import compile_index
from chunkloom.sources import arrays
from chunkloom.sources.files import Files, scratch, settle

FORMAT = 1
#: Chunk shape of one-dimensional arrays for which none is given; others must give one.
DEFAULT_CHUNK = 4096
RESERVED = "versions"
#: Chunks up to which a read names them one by one.
FEW_CHUNKS = 1000
CODECS = ("zstd", "gzip", "snappy", "lz4", "none")


class VersionStore:
    """All versions of a set of datasets below one folder, made if there is none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.root = self.files.root
        if not self._numbers():
            self._publish({"format": FORMAT, "head": "", "seq": 0, "versions": {}, "datasets": {}}, 0)
        found = self._meta()["format"]
        if found > FORMAT:
            raise ValueError(f"the store has format {found}; this library knows {FORMAT}")

    # metadata

    def _numbers(self) -> list[int]:
        return [int(n[:-5]) for n in self.files.names("meta") if n.endswith(".json")]

    def _meta(self) -> dict[str, Any]:
        number = max(self._numbers())
        return json.loads(self.files.read(f"meta/{number:012d}.json")) | {"number": number}

    def _publish(self, meta: dict[str, Any], number: int) -> None:
        text = json.dumps({k: v for k, v in meta.items() if k != "number"}, sort_keys=True)
        if not self.files.publish(f"meta/{number + 1:012d}.json", text):
            raise RuntimeError("another writer has published meanwhile")

    # versions

    @property
    def versions(self) -> list[str]:
        """Names, in order of commit."""
        known = self._meta()["versions"]
        return sorted(known, key=lambda v: known[v]["seq"])

    @property
    def head(self) -> str:
        """The current version; empty before the first."""
        return self._meta()["head"]

    @head.setter
    def head(self, name: str) -> None:
        meta = self._meta()
        if name not in meta["versions"]:
            raise ValueError(f"Version {name!r} not found")
        self._publish(meta | {"head": name}, meta["number"])

    def versions_frame(self) -> DataFrame:
        """v, prev, vts, seq of all versions."""
        rows = [(n, v["prev"] or None, datetime.datetime.fromisoformat(v["ts"]), v["seq"]) for n, v in self._meta()["versions"].items()]
        return self.spark.createDataFrame(rows, "v string, prev string, vts timestamp_ntz, seq long")

    def ancestor(self, n: int, of: str | None = None) -> str:
        """The n-th version before HEAD (or another)."""
        known, at = self._meta()["versions"], of or self.head
        if at not in known:
            raise IndexError(f"Version {at!r} not found")
        for _ in range(n):
            before = known[at]["prev"]
            if not before:
                raise IndexError(f"{of or 'HEAD'} has fewer than {n} versions before it")
            if before not in known:
                raise KeyError(before)
            at = before
        return at

    def asof(self, t: datetime.datetime, exact: bool = False) -> str:
        """The version of that very time, or else the latest before it."""
        when = utc(t).isoformat()
        known = sorted(((v["ts"], v["seq"], n) for n, v in self._meta()["versions"].items()), key=lambda x: (datetime.datetime.fromisoformat(x[0]), x[1]))
        same = [n for ts, _, n in known if datetime.datetime.fromisoformat(ts) == datetime.datetime.fromisoformat(when)]
        before = [n for ts, _, n in known if datetime.datetime.fromisoformat(ts) < datetime.datetime.fromisoformat(when)]
        if same or (before and not exact):
            return same[0] if same else before[-1]
        raise KeyError(f"no version {'at' if exact else 'at or before'} {t}")

    def __getitem__(self, which: str | int | datetime.datetime) -> Version:
        meta = self._meta()
        if isinstance(which, datetime.datetime):
            which = self.asof(which)
        elif isinstance(which, int):
            if which > 0:
                raise IndexError("only 0 and negative numbers count back from HEAD")
            which = self.ancestor(-which)
        if which.startswith("/"):
            raise ValueError("version names do not begin with a slash")
        if which not in meta["versions"]:
            raise KeyError(f"Version {which!r} not found")
        return Version(self, which, meta)

    def __contains__(self, name: str) -> bool:
        return name in self._meta()["versions"]

    # writing

    @contextlib.contextmanager
    def stage(self, name: str | None = None, prev: str | None = None, timestamp: datetime.datetime | None = None, make_current: bool = True) -> Iterator[Stage]:
        """A new version to edit; it is committed at the end of the block, or not at all if the block raises.

        prev is HEAD by default, and the empty string stands for the root.
        """
        meta, name = self._meta(), name or new_version_name()
        prev = meta["head"] if prev is None else prev
        if name in meta["versions"] or name.startswith("/"):
            raise ValueError(f"a version cannot be named {name!r}: it exists or begins with a slash")
        if prev and prev not in meta["versions"]:
            raise ValueError(f"Version {prev!r} not found")
        at = utc(timestamp) if timestamp else datetime.datetime.now(datetime.UTC).replace(tzinfo=None)
        stage = Stage(self, meta, name, prev)
        try:
            yield stage
            stage._commit(at, make_current)
        finally:
            stage.open = False

    def drop_version(self, name: str, reparent: bool = True) -> None:
        """Take a version out of the metadata only. HEAD falls back to its parent; its children get it as theirs."""
        meta = self._meta()
        if name not in meta["versions"]:
            raise KeyError(f"Version {name!r} not found")
        prev = meta["versions"].pop(name)["prev"]
        if reparent:
            for v in meta["versions"].values():
                v["prev"] = prev if v["prev"] == name else v["prev"]
        meta["head"] = prev if meta["head"] == name else meta["head"]
        self._publish(meta, meta["number"])

    def delete_versions(self, names: str | Sequence[str]) -> None:
        """Take versions out, give survivors their nearest kept ancestor, and drop chunks that nothing refers to."""
        meta, gone = self._meta(), {names} if isinstance(names, str) else set(names)
        if missing := gone - set(meta["versions"]):
            raise ValueError(f"no such versions: {sorted(missing)}")
        known = meta["versions"]

        def kept(v: str) -> str:
            while v in gone:
                v = known[v]["prev"]
            return v

        meta["head"] = kept(meta["head"])
        meta["versions"] = {n: v | {"prev": kept(v["prev"])} for n, v in known.items() if n not in gone}
        old = {p: list(d["pool"].values()) for p, d in meta["datasets"].items()}
        for path in list(meta["datasets"]):
            self._sweep(meta, path)
        self._publish(meta, meta["number"])
        for p, dirs in old.items():
            for x in set(dirs) - set(meta["datasets"].get(p, {"pool": {}})["pool"].values()):
                self.files.delete(x)

    def _manifests(self, meta: dict[str, Any], path: str) -> list[str]:
        return sorted({v["datasets"][path]["manifest"] for v in meta["versions"].values() if path in v["datasets"]} - {""})

    def _sweep(self, meta: dict[str, Any], path: str) -> None:
        """Drop chunks that no manifest names; only parts that hold such chunks are written anew, under their old name."""
        used = self._manifests(meta, path)
        if not any(path in v["datasets"] for v in meta["versions"].values()):
            del meta["datasets"][path]
            return
        spec = meta["datasets"][path]
        if not used:
            spec["pool"] = {}
            return
        live = self._listed(path, len(spec["chunks"]), used).select("chunk_hash").distinct()
        counts = self._digests(meta, path).join(live.withColumn("live", F.lit(1)), "chunk_hash", "left").groupBy("part").agg(F.count("*").alias("n"), F.count("live").alias("live")).collect()
        for r in counts:
            if r["live"] == 0:
                del spec["pool"][r["part"]]
            elif r["live"] < r["n"]:
                kept = self._pool(meta, path, [r["part"]]).join(live, "chunk_hash", "left_semi")
                spec["pool"][r["part"]] = self._write(kept.sortWithinPartitions("chunk_hash"), "chunks", path, spec["codec"], f"{r['part']}.{uuid.uuid4().hex}")

    def _listed(self, path: str, axes: int, manifests: Sequence[str]) -> DataFrame:
        cols = ", ".join(f"{c} long" for c in C.names("c", axes))
        return self.spark.read.schema(f"{cols}, extent array<int>, chunk_hash string, part string").parquet(*[f"{self.root}/{m}" for m in manifests])

    def _pool(self, meta: dict[str, Any], path: str, parts: Sequence[str] | None = None) -> DataFrame | None:
        """chunk_hash, extent, cells of all parts of a dataset, or of some."""
        spec = meta["datasets"].get(path, {"pool": {}})
        dirs = [d for p, d in spec["pool"].items() if parts is None or p in parts]
        return self.spark.read.schema(f"chunk_hash string, extent array<int>, cells array<{spec['dtype']}>").parquet(*[f"{self.root}/{x}" for x in dirs]) if dirs else None

    def _digests(self, meta: dict[str, Any], path: str) -> DataFrame:
        """chunk_hash and part of all stored chunks; cells are not read."""
        pool = self._pool(meta, path)
        if pool is None:
            return self.spark.createDataFrame([], "chunk_hash string, part string")
        folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
        return pool.select("chunk_hash", F.substring_index(folder, ".", 1).alias("part"))

    def _write(self, df: DataFrame, kind: str, path: str, codec: str, name: str | None = None) -> str:
        where = f"{kind}/{path.replace('/', '.')}/{name or uuid.uuid4().hex}"
        df.write.option("compression", codec).parquet(f"{self.root}/{where}")
        return where

    def diff(self, path: str, old: str, new: str, payload: bool = False) -> DataFrame:
        """c0, ..., extent, change, old_hash, new_hash of chunks that differ, with both sides' cells if asked for."""
        a, b = self[old][path], self[new][path]
        keys = [*C.names("c", len(a.shape)), "extent"]
        out = diff.chunk_diff(a.manifest(), b.manifest(), keys)
        pool = self._pool(self._meta(), path)
        if payload and pool is not None:
            cells = pool.select("chunk_hash", "cells")
            for side in ("old", "new"):
                out = out.join(cells.withColumnRenamed("chunk_hash", f"{side}_hash").withColumnRenamed("cells", f"{side}_cells"), f"{side}_hash", "left")
        return out

    def replay(self, path: str, change: Callable[[DataFrame, str], Any], chunks: Sequence[int] | None = None, dtype: str | None = None, fill: Any = None, codec: str | None = None) -> None:
        """Rewrite a dataset in all versions that have it: change gets all cells (also those that no chunk stores) and the
        version's name. It gives the new cells, or them and a new shape, or None to drop the dataset there.

        Each version is computed whole; `transform` is the way for functions of single cells, and for huge sparse arrays.
        """
        meta = self._meta()
        if path not in meta["datasets"]:
            raise KeyError(path)
        old = meta["datasets"][path]
        made = old | {"pool": {}, "chunks": list(chunks or old["chunks"]), "dtype": dtype or old["dtype"], "fill": old["fill"] if fill is None else fill, "codec": codec or old["codec"]}
        fresh = json.loads(json.dumps(meta)) | {"number": meta["number"]}
        fresh["datasets"][path] = made
        kept = False
        for name in sorted(meta["versions"], key=lambda v: meta["versions"][v]["seq"]):
            entry = meta["versions"][name]["datasets"].get(path)
            if entry is None:
                continue
            found = change(Dataset(self, meta, name, path).cells(), name)
            if found is None:
                del fresh["versions"][name]["datasets"][path]
                continue
            cells, shape = found if isinstance(found, tuple) else (found, entry["shape"])
            rows = C.chunk_cells(mutate.astype(cells, made["dtype"]), shape, made["chunks"], made["fill"])
            fresh["versions"][name]["datasets"][path] |= {"shape": list(shape), "manifest": _store_chunks(self, fresh, path, rows, len(shape), None)}
            kept = True
        if not kept:
            del fresh["datasets"][path]
        self._replace(meta, fresh, path)

    def _replace(self, meta: dict[str, Any], fresh: dict[str, Any], path: str) -> None:
        self._publish(fresh, meta["number"])
        for x in [*meta["datasets"][path]["pool"].values(), *self._manifests(meta, path)]:
            self.files.delete(x)

    def transform(self, path: str, change: Callable[[Column], Column], dtype: str | None = None, codec: str | None = None) -> None:
        """Put every cell of a dataset through a function, in all versions at once: every distinct chunk is computed once.

        The fill value goes through it too, and with it all cells that no chunk stores.
        """
        meta = self._meta()
        if path not in meta["datasets"]:
            raise KeyError(path)
        old = meta["datasets"][path]
        kind = dtype or old["dtype"]
        fill = self.spark.range(1).select(change(C.filler(old["fill"], old["dtype"])).cast(kind).alias("x")).first()["x"]
        made = old | {"pool": {}, "dtype": kind, "fill": stored_fill(fill), "codec": codec or old["codec"]}
        fresh = json.loads(json.dumps(meta)) | {"number": meta["number"]}
        fresh["datasets"][path] = made
        pool, part = self._pool(meta, path), uuid.uuid4().hex
        if pool is not None:
            new = pool.select(F.col("chunk_hash").alias("old"), "extent", F.transform("cells", lambda x: change(x).cast(kind)).alias("cells"))
            blank = ~F.exists("cells", lambda x: ~x.eqNullSafe(C.filler(made["fill"], kind)))
            hashed = settle(C.hash_chunks(new, exact=True).withColumn("blank", blank))
            made["pool"] = {part: self._write(hashed.where("not blank").dropDuplicates(["chunk_hash"]).select("chunk_hash", "extent", "cells").sortWithinPartitions("chunk_hash"), "chunks", path, made["codec"], part)}
            names = hashed.where("not blank").select(F.col("old").alias("chunk_hash"), F.col("chunk_hash").alias("new"))
            axes = len(old["chunks"])
            for m in self._manifests(meta, path):
                listed = self._listed(path, axes, [m]).join(names, "chunk_hash").select(*C.names("c", axes), "extent", F.col("new").alias("chunk_hash"), F.lit(part).alias("part"))
                where = self._write(listed.sortWithinPartitions(*C.names("c", axes)), "manifest", path, made["codec"])
                for v in fresh["versions"].values():
                    if path in v["datasets"] and v["datasets"][path]["manifest"] == m:
                        v["datasets"][path]["manifest"] = where
        self._replace(meta, fresh, path)

    def modify_metadata(self, path: str, chunks: Sequence[int] | None = None, dtype: str | None = None, fill: Any = None, codec: str | None = None) -> None:
        """Another chunk shape, element type, fill value or codec in all versions; cells equal to the old fill get the new."""
        if codec not in (None, *CODECS):
            raise ValueError(f"codec must be one of {CODECS}")
        spec = self._meta()["datasets"][path]
        kind = dtype or spec["dtype"]

        def change(x: Column) -> Column:
            return x if fill is None else F.when(x.eqNullSafe(C.filler(spec["fill"], spec["dtype"])), C.filler(fill, kind)).otherwise(x.cast(kind))

        if fill is not None or dtype is not None or codec is not None or chunks is None:
            self.transform(path, change, dtype, codec)
        if chunks is not None and list(chunks) != spec["chunks"]:
            self._rechunk(path, list(chunks))

    def _rechunk(self, path: str, chunks: list[int]) -> None:
        """Another chunk shape; stored chunks only, one version after another."""
        meta = self._meta()
        fresh = json.loads(json.dumps(meta)) | {"number": meta["number"]}
        fresh["datasets"][path] |= {"pool": {}, "chunks": chunks}
        done: dict[str, str] = {}
        for name, v in meta["versions"].items():
            entry = v["datasets"].get(path)
            if entry is None or not entry["manifest"]:
                continue
            key = json.dumps([entry["manifest"], entry["shape"]])
            if key not in done:
                rows = C.chunk_cells(Dataset(self, meta, name, path).stored(), entry["shape"], chunks, meta["datasets"][path]["fill"])
                done[key] = _store_chunks(self, fresh, path, rows, len(chunks), None)
            fresh["versions"][name]["datasets"][path]["manifest"] = done[key]
        self._replace(meta, fresh, path)

    def rebuild(self, path: str) -> None:
        """Compute all digests of a dataset again from its cells, and store its chunks under them."""
        self.transform(path, lambda x: x)

    def check(self, path: str) -> DataFrame:
        """Stored chunks whose digest is not that of their cells: stored, found."""
        from chunkloom.operators.history import check_digests

        pool = self._pool(self._meta(), path)
        return check_digests(pool, lambda x: C.hash_chunks(x, exact=True)).select("stored", "found")


def stored_fill(value: Any) -> Any:
    """A fill value as metadata keeps it: JSON's types as they are, structs as dicts, others as text that Spark casts back."""
    if isinstance(value, Row):
        return {k: stored_fill(v) for k, v in value.asDict().items()}
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode()
    return value.item() if hasattr(value, "item") else value if value is None or isinstance(value, (bool, int, float, str, dict)) else str(value)


def zero(dtype: str) -> Any:
    """The fill value of a Spark type for which none is given."""
    kind = DataType.fromDDL(dtype)
    if isinstance(kind, StructType):
        return {f.name: zero(f.dataType.simpleString()) for f in kind.fields}
    simple = kind.simpleString()
    return "" if simple.startswith(("string", "varchar", "char", "binary")) else False if simple == "boolean" else "1970-01-01 00:00:00" if simple.startswith("timestamp") else "1970-01-01" if simple == "date" else 0


def _store_chunks(store: VersionStore, meta: dict[str, Any], path: str, rows: DataFrame, axes: int, keep: DataFrame | None, keep_fill: bool = False) -> str:
    """Add unknown chunks to the pool as a part, and write a manifest of rows and of what is kept; the manifest's folder.

    Of what is kept, chunks that rows have too go. Rows that hold fill only are not stored unless keep_fill is set. The
    plan behind rows runs once: they and their digests are written aside first.
    """
    spec, c = meta["datasets"][path], C.names("c", axes)
    blank = F.lit(False) if keep_fill else ~F.exists("cells", lambda x: ~x.eqNullSafe(C.filler(spec["fill"], spec["dtype"])))
    hashed = C.hash_chunks(rows.select(*c, "extent", "cells"), exact=True).withColumn("blank", blank)
    staged = f"staging/{uuid.uuid4().hex}"
    hashed.write.parquet(f"{store.root}/{staged}")
    all_ = store.spark.read.schema(hashed.schema).parquet(f"{store.root}/{staged}")
    hashed = all_.where("not blank").drop("blank")
    keep = keep if keep is None else keep.join(all_.select(*c), c, "left_anti").select(*c, "extent", "chunk_hash", "part")
    part, seen = uuid.uuid4().hex, Observation()
    placed = hashed.withColumn("part", F.lit(part))
    if spec["pool"]:
        known = store._digests(meta, path).groupBy("chunk_hash").agg(F.min("part").alias("known"))
        placed = hashed.join(known, "chunk_hash", "left").withColumn("part", F.coalesce("known", F.lit(part))).drop("known")
    fresh = placed.where(F.col("part") == part).dropDuplicates(["chunk_hash"]).select("chunk_hash", "extent", "cells").sortWithinPartitions("chunk_hash")
    where = store._write(fresh.observe(seen, F.count(F.lit(1)).alias("n")), "chunks", path, spec["codec"], part)
    if seen.get["n"]:
        spec["pool"] = spec["pool"] | {part: where}
    else:
        store.files.delete(where)
    listed = placed.select(*c, "extent", "chunk_hash", "part")
    where = store._write((listed if keep is None else listed.unionByName(keep)).sortWithinPartitions(*c), "manifest", path, spec["codec"])
    store.files.delete(staged)
    return where


class Version:
    """A committed version: its datasets, groups and attributes."""

    def __init__(self, store: VersionStore, name: str, meta: dict[str, Any]):
        self.store, self.name, self.meta = store, name, meta

    @property
    def prev(self) -> str:
        return self.meta["versions"][self.name]["prev"]

    @property
    def timestamp(self) -> datetime.datetime:
        return datetime.datetime.fromisoformat(self.meta["versions"][self.name]["ts"])

    def datasets(self, group: str = "") -> list[str]:
        """Paths of all datasets below a group."""
        prefix = group.strip("/") + "/" if group.strip("/") else ""
        return sorted(p for p in self.meta["versions"][self.name]["datasets"] if p.startswith(prefix))

    def members(self, group: str = "") -> list[str]:
        """Names directly below a group, of datasets and groups."""
        skip = len(group.strip("/") + "/") if group.strip("/") else 0
        return sorted({p[skip:].split("/")[0] for p in self.datasets(group)})

    def visit(self, f: Callable[[str, Dataset], Any]) -> Any:
        """f(path, dataset) for all datasets until one returns something."""
        for p in self.datasets():
            if (out := f(p, self[p])) is not None:
                return out
        return None

    def __contains__(self, path: str) -> bool:
        return path.strip("/") in self.meta["versions"][self.name]["datasets"] or bool(self.datasets(path))

    def __getitem__(self, path: str) -> Dataset:
        path = path.strip("/")
        if path not in self.meta["versions"][self.name]["datasets"]:
            raise KeyError(path)
        return Dataset(self.store, self.meta, self.name, path)

    def get(self, path: str, default: Any = None) -> Any:
        return self[path] if path.strip("/") in self.meta["versions"][self.name]["datasets"] else default


class Dataset:
    """One array of a version."""

    def __init__(self, store: VersionStore, meta: dict[str, Any], version: str, path: str):
        self.store, self.path, self.meta = store, path, meta
        self.entry, self.spec = meta["versions"][version]["datasets"][path], meta["datasets"][path]

    shape = property(lambda self: tuple(self.entry["shape"]))
    chunks = property(lambda self: tuple(self.spec["chunks"]))
    dtype = property(lambda self: self.spec["dtype"])
    fill = property(lambda self: self.spec["fill"])
    attrs = property(lambda self: dict(self.entry["attrs"]))
    ndim = property(lambda self: len(self.shape))

    @property
    def size(self) -> int:
        n = 1
        for x in self.shape:
            n *= x
        return n

    @property
    def n_chunks(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks, strict=True))

    @property
    def nbytes(self) -> int | None:
        """Bytes of all cells; None for strings."""
        import numpy as np

        return self.size * np.dtype(BYTES[self.dtype]).itemsize if self.dtype in BYTES else None

    def __len__(self) -> int:
        return self.shape[0]

    def manifest(self) -> DataFrame:
        """c0, ..., extent, chunk_hash, part of stored chunks; a missing one holds fill."""
        spark = self.store.spark
        if not self.entry["manifest"]:
            cols = ", ".join(f"{c} long" for c in C.names("c", self.ndim))
            return spark.createDataFrame([], f"{cols}, extent array<int>, chunk_hash string, part string")
        return self.store._listed(self.path, self.ndim, [self.entry["manifest"]])

    def chunk_rows(self, only=None) -> DataFrame:
        """c0, ..., extent, cells of stored chunks, or of those that a predicate on c0, ... takes.

        The manifest is asked first which parts hold them, and of a few chunks for their digests, by which the reader
        skips row groups; so a read does not open what other versions have added.
        """
        listed = self.manifest() if only is None else self.manifest().where(only)
        pool = None
        if self.entry["manifest"] and self.spec["pool"]:
            few = listed.select("part", "chunk_hash").limit(FEW_CHUNKS + 1).collect() if only is not None else None
            if few is not None and len(few) <= FEW_CHUNKS:
                pool = self.store._pool(self.meta, self.path, sorted({r["part"] for r in few}))
                pool = pool if pool is None else pool.where(F.col("chunk_hash").isin([r["chunk_hash"] for r in few]))
            elif len(self.spec["pool"]) == 1:
                pool = self.store._pool(self.meta, self.path)
            else:
                pool = self.store._pool(self.meta, self.path, [r["part"] for r in listed.select("part").distinct().collect()])
        if pool is None:
            return listed.drop("chunk_hash", "part").withColumn("cells", F.array().cast(f"array<{self.dtype}>")).where(F.lit(False))
        return listed.drop("part").join(pool.select("chunk_hash", "cells"), "chunk_hash").drop("chunk_hash")

    def stored(self, only=None) -> DataFrame:
        """d0, ..., val of cells in stored chunks."""
        return C.assemble(self.chunk_rows(only), self.chunks)

    def cells(self) -> DataFrame:
        """d0, ..., val of all cells."""
        return C.dense_cells(self.stored(), self.shape, self.fill)

    def load(self) -> DataFrame:
        """All cells, kept in memory from their first use on."""
        return self.cells().cache()

    def __iter__(self) -> Iterator[DataFrame]:
        """A frame for each position of the first axis: o0, ... of the other axes, and val."""
        for i in range(len(self)):
            yield self[i]

    def __getitem__(self, index: Any) -> DataFrame:
        """o0, ..., val of the selected cells. Only chunks that hold some are read; only selected places are filled."""
        wanted = compile_index(index, self.shape, self.chunks)
        o = C.names("o", len(wanted.result_shape))
        found = wanted.select(self.stored(wanted.touched()))
        if wanted.empty:
            return found
        every = wanted.coordinates(self.store.spark).select(*o)
        found = found.withColumn("_in", F.lit(True))
        joined = every.join(found, o, "left") if o else every.join(found, F.lit(True), "left")  # one cell at most
        return joined.select(*o, F.when(F.col("_in"), F.col("val")).otherwise(C.filler(self.fill, self.dtype)).alias("val"))


class Stage:
    """A version in the making. Edits are plans; nothing is read or hashed before the commit."""

    def __init__(self, store: VersionStore, meta: dict[str, Any], name: str, prev: str):
        self.store, self.name, self.prev, self.open = store, name, prev, True
        self.meta = json.loads(json.dumps(meta)) | {"number": meta["number"]}
        self.entries = json.loads(json.dumps(meta["versions"][prev]["datasets"])) if prev else {}
        self.staged: dict[str, tuple[DataFrame, bool]] = {}  # chunk rows, and whether they are all of the dataset

    def _guard(self) -> None:
        if not self.open:
            raise ValueError("the version is committed")

    def _spec(self, path: str, dtype: str, ndim: int, chunks: Sequence[int] | None, fill: Any, codec: str | None) -> dict[str, Any]:
        if path == RESERVED or path.startswith(RESERVED + "/"):
            raise ValueError(f"{RESERVED!r} is a reserved name")
        if ndim < 1:
            raise ValueError("an array has at least one axis")
        old = self.meta["datasets"].get(path)
        if old is None:
            if chunks is None and ndim > 1:
                raise ValueError("chunks must be given for more than one axis")
            if codec not in (None, *CODECS):
                raise ValueError(f"codec must be one of {CODECS}")
            if dtype == "string" and fill not in (None, ""):
                raise ValueError("strings have the empty string as fill")
            old = {"dtype": dtype, "chunks": list(chunks or [DEFAULT_CHUNK]), "fill": zero(dtype) if fill is None else stored_fill(fill), "codec": codec or "zstd", "pool": {}}
            self.meta["datasets"][path] = old
            return old
        same = compatible(dtype, old["dtype"]), chunks is None or list(chunks) == old["chunks"], fill is None or stored_fill(fill) == old["fill"], codec in (None, old["codec"]), len(old["chunks"]) == ndim
        if not all(same):
            raise ValueError("type, chunks, fill, codec and axes of a dataset are the same in all versions")
        return old

    def put(self, path: str, cells: DataFrame, shape: Sequence[int], chunks: Sequence[int] | None = None, fill: Any = None, codec: str | None = None, attrs: dict[str, str] | None = None, keep_fill: bool = False) -> None:
        """A whole array from its cells (d0, ..., val); those not given hold fill."""
        self._guard()
        path = path.strip("/")
        spec = self._spec(path, dict(cells.dtypes)["val"], len(shape), chunks, fill, codec)
        known = self.entries.get(path, {}).get("attrs", {})
        self.entries[path] = {"shape": list(shape), "attrs": known | (attrs or {}), "manifest": "", "keep_fill": keep_fill}
        self.staged[path] = (C.chunk_cells(cells, shape, spec["chunks"], spec["fill"], keep_fill=True), True)

    def create_dataset(self, path: str, shape: Sequence[int] | None = None, data: Any = None, dtype: str | None = None, chunks: Sequence[int] | None = None, fill: Any = None, codec: str | None = None, attrs: dict[str, str] | None = None) -> None:
        """A dataset from an array (or nested lists), which may be cast to a Spark type; without data, a sparse one."""
        if data is None:
            return self.create(path, shape, dtype or "double", chunks, fill, codec, attrs)
        array = np.asarray(data)
        if shape is not None:
            array = array.reshape(shape)
        known = self.meta["datasets"].get(path.strip("/"))
        if chunks is None and known is None and array.ndim > 1:
            chunks = [min(n, max(1, round(DEFAULT_CHUNK ** (1 / array.ndim)))) or 1 for n in array.shape]
        self.put(path, arrays.cells(self.store.spark, array, "d", dtype), array.shape, chunks, fill, codec, attrs)

    def astype(self, path: str, dtype: str) -> None:
        """All of a dataset's cells cast to another type; like any type, it holds for all versions of the dataset's path, so the path must be new or deleted in all others."""
        self._rewrite(path, lambda cells, _: cells.select(*cells.columns[:-1], F.col("val").cast(dtype)), dtype=dtype)

    def insert(self, path: str, rows: DataFrame, before: int, count: int) -> None:
        """count rows (d0 from 0, ..., val) before a position of the first axis."""
        shape = self.entries[path.strip("/")]["shape"]
        self._rewrite(path, lambda cells, _: mutate.insert_rows(cells, rows, before, count), [shape[0] + count, *shape[1:]])

    def remove(self, path: str, start: int, stop: int) -> None:
        """Positions start to stop - 1 of the first axis taken out."""
        shape = self.entries[path.strip("/")]["shape"]
        self._rewrite(path, lambda cells, _: mutate.delete_rows(cells, start, stop), [shape[0] - (stop - start), *shape[1:]])

    def _rewrite(self, path: str, change: Callable[[DataFrame, str], DataFrame], shape: Sequence[int] | None = None, dtype: str | None = None) -> None:
        self._guard()
        path = path.strip("/")
        entry, spec = self.entries[path], self.meta["datasets"][path]
        if dtype is not None and dtype != spec["dtype"]:
            if any(path in v["datasets"] for v in self.meta["versions"].values()):
                raise ValueError("the type of a dataset is the same in all versions; VersionStore.transform changes them all")
            spec |= {"dtype": dtype, "fill": zero(dtype)}
        cells = change(C.assemble(self._rows(path, F.lit(True)), spec["chunks"]), self.name)
        entry["shape"] = list(shape or entry["shape"])
        entry.pop("least", None)
        self.staged[path] = (C.chunk_cells(cells, entry["shape"], spec["chunks"], spec["fill"], keep_fill=True), True)

    def create(self, path: str, shape: Sequence[int], dtype: str = "double", chunks: Sequence[int] | None = None, fill: Any = None, codec: str | None = None, attrs: dict[str, str] | None = None) -> None:
        """A sparse array: fill everywhere, and no chunk stored."""
        self._guard()
        path = path.strip("/")
        self._spec(path, dtype, len(shape), chunks, fill, codec)
        self.entries[path] = {"shape": list(shape), "attrs": attrs or {}, "manifest": ""}
        self.staged.pop(path, None)

    def attrs(self, path: str, **values: str) -> dict[str, str]:
        """Set attributes of a dataset; all of them."""
        self._guard()
        self.entries[path]["attrs"] = self.entries[path]["attrs"] | values
        return self.entries[path]["attrs"]

    def delete(self, path: str) -> None:
        """Take out a dataset, or all below a group."""
        self._guard()
        path = path.strip("/")
        gone = [p for p in self.entries if p == path or p.startswith(path + "/")]
        if not gone:
            raise KeyError(path)
        for p in gone:
            del self.entries[p]
            self.staged.pop(p, None)

    def _committed(self, path: str) -> Dataset:
        return Dataset(self.store, self.meta | {"versions": {"": {"datasets": self.entries}}}, "", path)

    def _rows(self, path: str, only) -> DataFrame:
        """Chunk rows as they are now: staged ones, and the others from the parent."""
        rows, all_ = self.staged.get(path, (None, False))
        base = self._committed(path).chunk_rows(only & self._visible(path))
        if rows is None:
            return base
        mine, c = rows.where(only), C.names("c", len(self.entries[path]["shape"]))
        return mine if all_ else mine.unionByName(base.join(rows.select(*c), c, "left_anti"))

    def _visible(self, path: str):
        """Predicate on the parent's chunks: those that no resize since has cut off."""
        out = F.lit(True)
        for k, n in enumerate(self.entries[path].get("least", [])):
            out = out & (F.col(f"c{k}") * self.meta["datasets"][path]["chunks"][k] < n)
        return out

    def __setitem__(self, key: str | tuple[str, Any], value: Any) -> None:
        """stage[path, index] = a value, an array that broadcasts to the selection, or a frame o0, ..., val over it. Only
        chunks it touches are rewritten. stage[path] = an array makes a dataset of it, or replaces one."""
        self._guard()
        if isinstance(key, str):
            self.create_dataset(key, data=value)
            return
        path, index = key[0].strip("/"), key[1] if len(key) == 2 else tuple(key[1:])
        entry, spec = self.entries[path], self.meta["datasets"][path]
        shape, chunks, n = entry["shape"], spec["chunks"], len(entry["shape"])
        wanted = compile_index(index, tuple(shape), tuple(chunks))
        if wanted.empty:
            return
        places = wanted.coordinates(self.store.spark)
        o = C.names("o", len(wanted.result_shape))
        if isinstance(value, (np.ndarray, list)):
            value = arrays.cells(self.store.spark, np.broadcast_to(np.asarray(value), wanted.result_shape), "o", spec["dtype"])
        if isinstance(value, DataFrame):
            new = places.join(value, o) if o else places.join(value.select("val"), F.lit(True))
        else:
            new = places.withColumn("val", C.filler(stored_fill(value), spec["dtype"]) if isinstance(value, (dict, Row, bytes, datetime.date)) else F.lit(value.item() if isinstance(value, np.generic) else value))
        new = mutate.astype(new.select(*C.names("d", n), "val"), spec["dtype"])
        old = C.assemble(self._rows(path, wanted.touched() & ~wanted.whole()), chunks)
        self._stage(path, C.chunk_cells(mutate.merge(old, new), shape, chunks, spec["fill"], keep_fill=True))

    def _stage(self, path: str, rows: DataFrame) -> None:
        had, all_ = self.staged.get(path, (None, False))
        c = C.names("c", len(self.entries[path]["shape"]))
        self.staged[path] = (rows if had is None else had.join(rows.select(*c), c, "left_anti").unionByName(rows), all_)

    def resize(self, path: str, shape: Sequence[int] | int, axis: int | None = None) -> None:
        """Another shape, or another size of one axis. Chunks beyond it go, and only chunks at the edges are rewritten."""
        self._guard()
        path = path.strip("/")
        entry, spec = self.entries[path], self.meta["datasets"][path]
        old, chunks, n = entry["shape"], spec["chunks"], len(entry["shape"])
        if axis is not None:
            if not -n <= axis < n:
                raise ValueError(f"axis {axis} is out of bounds for {n} axes")
            shape = [shape if k == axis % n else x for k, x in enumerate(old)]
        if isinstance(shape, int) or len(shape) != n:
            raise TypeError(f"the array has {n} axes")
        if any(x < 0 for x in shape):
            raise ValueError("sizes are not negative")
        within, edge = F.lit(True), F.lit(False)
        for k in range(n):
            within = within & (F.col(f"c{k}") * chunks[k] < shape[k])
            changed = F.least(F.lit(chunks[k]), old[k] - F.col(f"c{k}") * chunks[k]) != F.least(F.lit(chunks[k]), shape[k] - F.col(f"c{k}") * chunks[k])
            edge = edge | changed
        rows = self._rows(path, within & edge)
        had, all_ = self.staged.get(path, (None, False))
        entry["shape"] = list(shape)
        entry["least"] = [min(x, y) for x, y in zip(entry.get("least", old), shape, strict=True)]
        if had is not None:
            self.staged[path] = (had.where(within), all_)
        self._stage(path, C.chunk_cells(mutate.resize(C.assemble(rows, chunks), shape), shape, chunks, spec["fill"], keep_fill=True))

    def append(self, path: str, rows: DataFrame, count: int) -> None:
        """count rows (d0 from 0, ..., val) behind the last; only the last chunks are rewritten."""
        path = path.strip("/")
        at, n = self.entries[path]["shape"][0], len(self.entries[path]["shape"])
        self.resize(path, at + count, 0)
        o = [F.col(f"d{k}").alias(f"o{k}") for k in range(n)]
        self[path, (slice(at, at + count), ...)] = rows.select(*o, "val")

    def _commit(self, at: datetime.datetime, make_current: bool) -> None:
        for path, (rows, all_) in self.staged.items():
            entry, spec = self.entries[path], self.meta["datasets"][path]
            n = len(entry["shape"])
            kept = self._committed(path).manifest().where(self._visible(path)) if not all_ and entry["manifest"] else None
            entry["manifest"] = _store_chunks(self.store, self.meta, path, rows, n, kept, entry.pop("keep_fill", False))
        for entry in self.entries.values():
            entry.pop("least", None)
            entry.pop("keep_fill", None)
        seq = self.meta["seq"] + 1
        self.meta["versions"][self.name] = {"prev": self.prev, "ts": at.isoformat(), "seq": seq, "datasets": self.entries}
        self.meta["datasets"] = {p: d for p, d in self.meta["datasets"].items() if d["pool"] or any(p in v["datasets"] for v in self.meta["versions"].values())}
        self.store._publish(self.meta | {"head": self.name if make_current else self.meta["head"], "seq": seq}, self.meta["number"])


__all__ = ["Dataset", "Stage", "Version", "VersionStore", "scratch"]
