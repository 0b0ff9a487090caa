"""The store: commits, branches, errors, edits against NumPy, deletion, history, streams."""

import datetime
import itertools

import numpy as np
import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkloom.sources.store import VersionStore


@pytest.fixture
def store(spark, tmp_path):
    return VersionStore(spark, f"file://{tmp_path}/store")


def cells(spark, array):
    d = ", ".join(f"d{k} long" for k in range(array.ndim))
    kind = {"i": "bigint", "f": "double", "U": "string"}[array.dtype.kind]
    rows = [(*map(int, at), v.item()) for at, v in np.ndenumerate(array)]
    return spark.createDataFrame(rows, f"{d}, val {kind}")


def dense(dataset):
    out = np.full(dataset.shape, dataset.fill, dtype=object)
    for r in dataset.stored().collect():
        out[tuple(r[:-1])] = r["val"]
    return out.tolist()


def put(store, name, array, path="x", **more):
    with store.stage(name, **more) as s:
        s.put(path, cells(store.spark, array), array.shape, chunks=[10] * array.ndim)


def test_commit_read_and_reuse(spark, store):
    a = np.arange(35)
    put(store, "r0", a)
    put(store, "r1", a)
    assert store.versions == ["r0", "r1"] and store.head == "r1"
    assert len(store._meta()["datasets"]["x"]["pool"]) == 1  # nothing new was stored
    with store.stage("r2") as s:
        s["x", 3] = 100
    b = a.copy()
    b[3] = 100
    assert dense(store["r2"]["x"]) == b.tolist() and dense(store["r1"]["x"]) == a.tolist()
    assert store.diff("x", "r1", "r2").select("c0", "change").collect() == [(0, "modified")]
    assert sorted((r["o0"], r["val"]) for r in store[0]["x"][2:9:3].collect()) == [(0, 2), (1, 5), (2, 8)]
    assert store["r2"]["x"][3].collect()[0]["val"] == 100
    assert store[-2].name == "r0" and store["r2"]["x"].n_chunks == (4,) and store["r2"]["x"].nbytes == 280


def test_lookup_errors(store):
    put(store, "r0", np.arange(3))
    for key, error in (("nope", KeyError), ("/r0", ValueError), (1, IndexError), (-1, IndexError)):
        with pytest.raises(error):
            store[key]
    with pytest.raises(ValueError):
        put(store, "r0", np.arange(3))
    with pytest.raises(ValueError):
        put(store, "r1", np.arange(3), prev="nope")
    with pytest.raises(ValueError):
        store.head = "nope"


def test_times(store):
    t = [datetime.datetime(2024, 1, d, tzinfo=datetime.UTC) for d in (1, 2, 3)]
    put(store, "a", np.arange(3), timestamp=t[0])
    put(store, "b", np.arange(4), timestamp=t[2])
    assert store.asof(t[1]) == "a" and store.asof(t[2]) == "b" and store[t[2]].name == "b"
    with pytest.raises(KeyError):
        store.asof(t[1], exact=True)
    with pytest.raises(KeyError):
        store.asof(t[0] - datetime.timedelta(seconds=1))
    with pytest.raises(ValueError):
        store.asof(datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone(datetime.timedelta(hours=1))))


def test_rollback_and_guards(store):
    put(store, "r0", np.arange(5))
    with pytest.raises(ZeroDivisionError), store.stage("r1") as s:
        s["x", 0] = 9
        1 / 0
    assert store.versions == ["r0"] and store.head == "r0"
    with pytest.raises(ValueError):
        s["x", 0] = 9
    with store.stage("r1") as s, pytest.raises(ValueError):
        s.put("versions", cells(store.spark, np.arange(2)), (2,))
    with store.stage("r2") as s, pytest.raises(ValueError):
        s.put("x", cells(store.spark, np.arange(2)), (2,), chunks=(7,))
    with store.stage("r3") as s, pytest.raises(ValueError):
        s.create("m", (3, 3))


def test_groups_attributes_and_deletion(store):
    with store.stage("r0") as s:
        for p in ("a", "g/b", "g/h/c"):
            s.put(p, cells(store.spark, np.arange(3)), (3,))
        s.attrs("a", unit="m")
    with store.stage("r1") as s:
        s.delete("g/h")
        s.attrs("a", note="x")
    assert store["r0"].members("g") == ["b", "h"] and store["r0"].members() == ["a", "g"]
    assert store["r1"].datasets() == ["a", "g/b"] and "g/h" not in store["r1"] and "g" in store["r1"]
    assert store["r1"]["a"].attrs == {"unit": "m", "note": "x"} and store["r0"]["a"].attrs == {"unit": "m"}
    assert store["r0"].visit(lambda p, d: p if p.startswith("g") else None) == "g/b"


def test_sparse_huge(store):
    with store.stage("r0") as s:
        s.create("x", (10**11,), dtype="bigint", chunks=(10**4,), fill=1)
    with store.stage("r1") as s:
        s["x", 5 * 10**10] = 7
    x = store["r1"]["x"]
    assert x.manifest().count() == 1 and store["r0"]["x"].manifest().count() == 0
    assert sorted(r["val"] for r in x[5 * 10**10 - 1 : 5 * 10**10 + 2].collect()) == [1, 1, 7]


def test_strings_do_not_run_together(store):
    put(store, "r0", np.array(["a", "b", "cd"]))
    put(store, "r1", np.array(["ab", "", "cd"]))
    assert dense(store["r0"]["x"]) == ["a", "b", "cd"] and dense(store["r1"]["x"]) == ["ab", "", "cd"]


@given(st.data())
@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck), phases=[Phase.generate])
def test_edits_against_numpy(spark, tmp_path_factory, data):
    store = VersionStore(spark, f"file://{tmp_path_factory.mktemp('model')}/s")
    shape = tuple(data.draw(st.lists(st.integers(1, 7), min_size=1, max_size=2)))
    a = np.arange(np.prod(shape)).reshape(shape)
    with store.stage("r0") as s:
        s.put("x", cells(spark, a), shape, chunks=[3] * len(shape), fill=42)
    with store.stage("r1") as s:
        for _ in range(data.draw(st.integers(1, 3))):
            if data.draw(st.booleans()):
                new = tuple(data.draw(st.integers(1, 8)) for _ in shape)
                s.resize("x", new)
                b = np.full(new, 42)
                common = tuple(slice(0, min(p, q)) for p, q in zip(a.shape, new, strict=True))
                b[common] = a[common]
                a = b
            else:
                at = tuple(slice(data.draw(st.integers(0, n - 1)), None, data.draw(st.integers(1, 3))) for n in a.shape)
                v = data.draw(st.integers(-9, 9))
                s[("x", *at)] = v
                a = a.copy()
                a[at] = v
    assert dense(store["r1"]["x"]) == a.tolist()
    live = [r["chunk_hash"] for r in store["r1"]["x"].manifest().collect()]
    assert len(live) <= np.prod(store["r1"]["x"].n_chunks) and store.check("x").isEmpty()


def test_what_a_resize_cuts_off_stays_gone(spark, store):
    put(store, "r0", np.arange(30))
    with store.stage("r1") as s:
        s.resize("x", (5,))
        s.resize("x", (30,))
    assert dense(store["r1"]["x"]) == [*range(5), *[0] * 25]


def test_append(spark, store):
    put(store, "r0", np.arange(12))
    with store.stage("r1") as s:
        s.append("x", cells(spark, np.arange(5) + 100), 5)
    assert dense(store["r1"]["x"]) == [*range(12), *range(100, 105)]
    both = store["r0"]["x"].manifest().join(store["r1"]["x"].manifest(), "chunk_hash").count()
    assert both == 1  # the full chunk is shared


@pytest.mark.parametrize("gone", list(itertools.permutations(["r1", "r2", "r3"], 2))[:3])
def test_delete_versions(spark, store, gone):
    arrays = {"r0": np.arange(26)}
    put(store, "r0", arrays["r0"])
    for i, n in enumerate((17, 26, 30)):
        arrays[f"r{i + 1}"] = np.arange(n) + i
        put(store, f"r{i + 1}", arrays[f"r{i + 1}"])
    store.delete_versions(list(gone))
    for name in store.versions:
        assert dense(store[name]["x"]) == arrays[name].tolist()
    used = {r["chunk_hash"] for n in store.versions for r in store[n]["x"].manifest().collect()}
    assert {r["chunk_hash"] for r in store._pool(store._meta(), "x").collect()} == used
    chain = [store[n].prev for n in store.versions]
    assert chain == ["", *store.versions[:-1]]
    with pytest.raises(ValueError):
        store.delete_versions("nope")


def test_drop_version(store):
    for n in ("a", "b", "c"):
        put(store, n, np.arange(3))
    store.drop_version("b", reparent=False)
    with pytest.raises(KeyError):
        store.ancestor(2)
    store.drop_version("c")
    assert store.head == "b" or store.head == "a" or store.head == ""


def test_modify_metadata(store):
    put(store, "r0", np.array([0, 1, 2, 0, 5]))
    put(store, "r1", np.array([0, 0, 2]))
    store.modify_metadata("x", chunks=(2,), dtype="double", fill=-1.0)
    assert dense(store["r0"]["x"]) == [-1.0, 1.0, 2.0, -1.0, 5.0] and dense(store["r1"]["x"]) == [-1.0, -1.0, 2.0]
    assert store["r0"]["x"].chunks == (2,) and store["r0"]["x"].dtype == "double"


def test_replay_can_drop(store):
    put(store, "r0", np.arange(4))
    put(store, "r1", np.arange(5))
    store.replay("x", lambda df, v: None if v == "r0" else df.withColumn("val", F.col("val") * 2))
    assert "x" not in store["r0"] and dense(store["r1"]["x"]) == [0, 2, 4, 6, 8]


def test_recreated_dataset_reuses_chunks(store):
    a = np.array([1, 2, 7, 8, 0, 0])
    put(store, "r0", a)
    with store.stage("r1") as s:
        s.delete("x")
    put(store, "r2", a, prev="r1")
    assert len(store._meta()["datasets"]["x"]["pool"]) == 1 and dense(store["r2"]["x"]) == a.tolist()


def test_stream_commits(spark, store, tmp_path):
    from chunkloom.streaming.commits import append_batch, commit_stream

    for i in range(3):
        spark.range(i * 10, i * 10 + 10).select("id", (F.col("id") * 2.0).alias("value")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = commit_stream(stream, store, "x", ["id"], "value", str(tmp_path / "ck"), chunks=(8,), availableNow=True)
    q.awaitTermination()
    assert len(store.versions) == 3 and sorted(dense(store[0]["x"])) == [2.0 * i for i in range(30)]
    append_batch(store, "x", spark.range(1).select("id", F.lit(1.0).alias("value")), 0, ["id"], "value")
    assert len(store.versions) == 3  # a batch that was committed is passed over


@pytest.mark.parametrize("name", ["small_fraction_changes_sparse", "mostly_appends_dense"])
def test_workloads(store, name):
    from chunkloom.plans import workloads

    workloads.run(store, name, 2, chunk=256)
    mix = workloads.MIXES[name]
    grown = mix.inserts - mix.deletes + mix.appends
    assert [store[v][name].shape for v in store.versions] == [(mix.rows + i * grown,) for i in range(3)]
    assert store[0][name].cells().select("d0").distinct().count() == len(store[0][name])


def test_iteration_and_rebuild(store):
    put(store, "r0", np.arange(6).reshape(2, 3))
    assert [sorted(r["val"] for r in row.collect()) for row in store[0]["x"]] == [[0, 1, 2], [3, 4, 5]]
    store.rebuild("x")
    assert dense(store[0]["x"]) == [[0, 1, 2], [3, 4, 5]] and store[0]["x"].load().count() == 6


def test_replay_reaches_cells_that_no_chunk_stores(store):
    with store.stage("r0") as s:
        s.create("x", (6,), dtype="double", chunks=(2,), fill=1.0)
        s.create("y", (10**11,), dtype="double", chunks=(10**4,), fill=1.0)
    with store.stage("r1") as s:
        s["x", 0] = 5.0
        s["y", 7] = 3.0
    store.transform("y", lambda x: x + 1)
    assert store["r0"]["y"].fill == 2.0 and store["r0"]["y"].manifest().isEmpty()
    assert sorted(r["val"] for r in store["r1"]["y"][6:9].collect()) == [2.0, 2.0, 4.0]
    twice = [np.full(6, 2.0), np.array([10.0, 2, 2, 2, 2, 2])]
    store.replay("x", lambda df, v: df.withColumn("val", F.col("val") * 2))
    assert [dense(store[v]["x"]) for v in ("r0", "r1")] == [a.tolist() for a in twice]
    store.transform("x", lambda x: x * x + 1)
    assert [dense(store[v]["x"]) for v in ("r0", "r1")] == [(a * a + 1).tolist() for a in twice] and store["r0"]["x"].fill == 2.0
    assert store.check("x").isEmpty()
    store.replay("x", lambda df, v: (df.where("d0 < 3"), (3,)) if v == "r1" else None)
    assert "x" not in store["r0"] and dense(store["r1"]["x"]) == [101.0, 5.0, 5.0]


def test_a_read_opens_only_the_parts_it_needs(store):
    put(store, "r0", np.arange(40))
    for i in range(1, 4):
        with store.stage(f"r{i}") as s:
            s["x", 10 * i] = -i
    assert len(store._meta()["datasets"]["x"]["pool"]) == 4
    one = store["r3"]["x"].chunk_rows(F.col("c0") == 2)
    assert len({f.rsplit("/", 2)[1] for f in one.inputFiles() if "/chunks/" in f}) == 1 and one.count() == 1
    store.delete_versions(["r1", "r2"])
    assert len(store._meta()["datasets"]["x"]["pool"]) == 4  # each change lives on in the newest version
    assert dense(store["r3"]["x"])[::10] == [0, -1, -2, -3] and dense(store["r0"]["x"]) == list(range(40))


RECORDS = np.array([(1, 0.5, "a"), (2, -0.0, ""), (0, 0.0, "ccc")], dtype=[("n", "i4"), ("x", "f8"), ("s", "U3")])
ARRAYS = {
    "ints": np.arange(7, dtype="i2"), "unsigned": np.array([0, 2**32 - 1], dtype="u4"), "huge": np.array([0, 2**64 - 1], dtype="u8"), "flags": np.array([True, False, True]), "grid": np.arange(12.0).reshape(3, 4),
    "text": np.array(["a", "", "longer"]), "bytes": np.array([b"a", b"bc"]), "times": np.array(["2024-01-01T10:00:00", "1970-01-01"], dtype="datetime64[s]"), "complex": np.array([1 + 2j, 0]), "records": RECORDS,
}


def test_arrays_of_many_types(store):
    with store.stage("r0") as s:
        for path, a in ARRAYS.items():
            s[path] = a
        s.create("sparse", (5,), dtype="struct<n:int,s:string>", chunks=(2,))
    v = store["r0"]
    for path, a in ARRAYS.items():
        got = {tuple(r)[:-1]: r["val"] for r in v[path].cells().collect()}
        assert v[path].shape == a.shape and len(got) == a.size
        for at, x in np.ndenumerate(a):
            want = tuple(x) if a.dtype.names else (x.real, x.imag) if a.dtype.kind == "c" else bytes(x) if a.dtype.kind == "S" else x.item()
            have = got[at]
            assert (tuple(have) if isinstance(have, tuple) else bytes(have) if isinstance(have, bytearray) else int(have) if path == "huge" else have) == want
        assert store.check(path).isEmpty()
    assert {tuple(r["val"]) for r in v["sparse"].cells().collect()} == {(0, "")}


def test_arrays_and_frames_into_selections(spark, store):
    a = np.arange(20).reshape(4, 5)
    put(store, "r0", a)
    one = spark.createDataFrame([(77,)], "val long")
    with store.stage("r1") as s:
        s["x", 1:3, ::2] = np.array([[1, 2, 3], [4, 5, 6]])
        s["x", 0] = [9, 8, 7, 6, 5]
        s["x", 3, 4] = one
    a[1:3, ::2], a[0], a[3, 4] = [[1, 2, 3], [4, 5, 6]], [9, 8, 7, 6, 5], 77
    assert dense(store["r1"]["x"]) == a.tolist()
    assert store["r1"]["x"][3, 4].first()["val"] == 77 and store["r1"]["x"][0, 0].first()["val"] == 9
    with store.stage("r2") as s:
        s.insert("x", cells(spark, np.full((2, 5), -1)), 1, 2)
        s.remove("x", 0, 1)
    assert dense(store["r2"]["x"]) == [[-1] * 5, [-1] * 5, *a[1:].tolist()]


def test_long_chains(spark, monkeypatch):
    """A thousand versions, walked on the driver and by pointers that double."""
    from chunkloom.operators import versions as V

    chain = spark.range(1000).select(F.col("id").alias("v"), F.when(F.col("id") > 0, F.col("id") - 1).alias("prev"), F.timestamp_seconds("id").alias("vts"))
    for listed in (100_000, 10):
        monkeypatch.setattr(V, "LISTED", listed)
        assert sorted(map(tuple, V.lineage(chain, 700).collect())) == [(v, 700 - v) for v in range(701)]
        kept = V.drop_versions(chain, chain.where("v % 9 <> 4").select("v")).orderBy("v").collect()
        assert [(r["v"], r["prev"]) for r in kept] == [(v, v - 9 if v > 4 else None) for v in range(4, 1000, 9)]
    assert V.lineage(chain, 5000).count() == 0 and V.nth_ancestor(chain, 700, 3).first()["v"] == 697
