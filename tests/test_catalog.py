"""Every query with SQL gives the SQL's rows."""

import importlib
import shutil
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from themeloom import catalog

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return Counter(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, con, name):
    got, want = catalog.queries()[name](spark, DATA).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and len(got)


def test_works_without_the_llm_folders(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "themeloom", tmp_path / "themeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, timeout=120)


def test_entry_has_a_stable_schema(spark):
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.columns == ["topic", "place", "term", "score"]
