"""Every query with SQL gives the same rows as DuckDB."""

import math

import pytest

from chunkloom import queries as library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def rows(frame):
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 9) if isinstance(v, float) else v
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(clean, r)) for r in frame.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_same_rows(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    assert rows(library.queries()[name](spark, data).toPandas()) == rows(con.sql(library.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(library.queries()) - set(library.oracle_sql())))
def test_runs(spark, data, name):
    assert library.queries()[name](spark, data).count() > 0


def test_entry_without_corpus_operators(spark, tmp_path):
    """The entry module works where the corpus folder and its pipeline have been taken away."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "chunkloom", tmp_path / "chunkloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert 'chunk_hash' in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin"})


def test_store_holds_every_day(spark, tmp_path):
    """Both store queries equal a brute-force result over five days, of which one fills a gap and one starts with one."""
    import datetime

    ids = [range(0, 200), range(200, 270), [*range(275, 400)], [270, 272], range(400, 420)]
    events = [(i, datetime.datetime(2024, 1, 1 + day, 23, 59, 59) if k % 2 else datetime.datetime(2024, 1, 1 + day), i / 4 + 1) for day, those in enumerate(ids) for k, i in enumerate(those)]
    spark.createDataFrame(events, "event_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    store = library._store(spark, str(tmp_path))
    assert store.versions == [f"2024-01-0{k}" for k in range(1, 6)]
    for day, name in enumerate(store.versions):
        known = {i: x for i, t, x in events if t.day <= day + 1}
        assert {tuple(r) for r in store[name]["series/value"].cells().select("d0", "val").collect()} == {(i, known.get(i, 0.0)) for i in range(max(known) + 1)}
    known = {i: x for i, t, x in events if t.day <= 4}
    got = library.store_roundtrip(spark, str(tmp_path)).select("o0", "val").collect()
    assert sorted(map(tuple, got)) == [(o, known.get(i, 0.0)) for o, i in enumerate(range(10, 300, 3))]
    known = {i: 2 * x for i, _, x in events}
    got = library.replay_callback(spark, str(tmp_path)).select("d0", "val").collect()
    assert sorted(map(tuple, got)) == [(i, known.get(i, 0.0)) for i in range(420)]
