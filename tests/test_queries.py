"""Every registered query against DuckDB on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from courierlake.plans import catalog

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in os.listdir(DIR):
        con.execute(f"create view {p.removesuffix('.parquet')} as select * from read_parquet('{DIR}/{p}')")
    return con


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(f"{r[i]:.6g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    found = rows_of([tuple(r) for r in df.collect()], df.columns)
    if name in SQL:
        cursor = duck.execute(SQL[name])
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        assert found == rows_of(cursor.fetchall(), names)


def test_entry(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_corpus_operators(tmp_path):
    """A copy without the subpackage, its tests and the pipeline still imports and has all the other queries."""
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in [*e.queries(), *e.oracle_sql()]))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ""})
    assert done.stdout.split() == [str(len(QUERIES)), "0"]
