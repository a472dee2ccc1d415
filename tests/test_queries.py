"""Every registered query of the document jobs against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from doclake.jobs import queries as q

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(q.queries())


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in glob.glob(f"{SMALL}/*.parquet"):
        out.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return str(v)
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = q.queries()[name](spark, SMALL)
    rows = got.collect()
    sql = q.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = con.sql(sql)
    assert table(got.columns, rows) == table(want.columns, want.fetchall())


def test_entry_without_the_training_operators(tmp_path):
    """The entry module works in a copy that lacks the llm folders and the pipeline."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/doclake", tmp_path / "doclake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
