"""Queries of plans/streams.py against their SQL."""

import duckdb
import pytest

from millrace.plans import catalogue, streams

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalogue.queries().items() if f.__module__ == streams.__name__]


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for table in ("events", "orders", "documents", "conversations", "lineitem", "customer"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return db


#: Streams and files don't depend on chunks: once is enough.
CASES = [(n, c) for n in NAMES for c in (300, 1_000_000) if c > 300 or not n.startswith(("stream_", "file_"))]


@pytest.mark.parametrize("name,chunk", CASES)
def test_agrees_with_sql(spark, monkeypatch, db, name, chunk):
    from millrace import positions

    monkeypatch.setattr(positions, "CHUNK_ROWS", chunk)
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    found = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert got == want and got
