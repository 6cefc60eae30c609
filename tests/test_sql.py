"""The array queries against their SQL, and the entry point without the optional part."""

import datetime
import os
import shutil
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from chunkframe import queries

REPO = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    made = duckdb.connect()
    for t in os.listdir(SF):
        made.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    return made


@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, con, name):
    df = queries.queries()[name](spark, SF)
    done = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in done.description]
    want = sorted(repr(tuple(map(plain, r))) for r in done.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(map(plain, r))) for r in df.select(*columns).collect()) == want


def test_without_the_optional_part(tmp_path):
    """Without the llm folders and the pipeline the entry point offers the other queries."""
    shutil.copytree(REPO / "chunkframe", tmp_path / "chunkframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.array_queries.queries()) and e.oracle_sql() and callable(e.entry)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
