"""The driver's contract."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "group_id", "started", "ended", "n", "cents"] and df.count() > 0


def test_every_query_with_sql_is_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_catalogue_agrees_with_sql(spark):
    import duckdb

    from millrace.plans import catalogue

    db = duckdb.connect()
    for table in ("customer", "events", "orders", "lineitem", "documents", "conversations"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    sql = catalogue.oracle_sql()
    for name, query in catalogue.queries().items():
        df = query(spark, SF)
        columns = sorted(df.columns)
        got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
        assert got, name
        if name in sql:
            found = db.execute(sql[name])
            names = [d[0] for d in found.description]
            assert sorted(names) == columns, name
            want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
            assert got == want, name


def test_without_the_corpus_operators(tmp_path):
    """The rest imports and runs where the llm folders and the pipeline are gone."""
    for p in ROOT.iterdir():
        if p.name in ("millrace", "__spark_entry__.py"):
            os.symlink(p, tmp_path / p.name) if p.name != "millrace" else (tmp_path / "millrace").mkdir()
    for p in (ROOT / "millrace").iterdir():
        if p.name != "llm":
            os.symlink(p, tmp_path / "millrace" / p.name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
