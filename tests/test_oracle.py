"""Every query with oracle SQL gives the oracle's rows, on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from tessera.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cur = duck.execute(ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    expected = sorted(repr(tuple(plain(r[i]) for i in at)) for r in cur.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in sorted(names))) for r in df.collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry_works_without_the_training_data_operators(tmp_path):
    """In a copy without their folders the entry imports, lists the other queries and runs."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    gone = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "*.pyc")
    shutil.copytree(root, tmp_path / "repo", ignore=gone)
    code = (
        "import sys; import __spark_entry__ as e; from pyspark.sql import SparkSession\n"
        "assert not any(m.startswith('tessera.llm') for m in sys.modules)\n"
        "assert not [n for n in e.queries() if n == 'pipeline' or n.startswith('op')] and set(e.oracle_sql()) <= set(e.queries())\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "print(len(e.queries()), e.entry(spark).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    n, rows = map(int, done.stdout.split()[-2:])
    assert n == len(QUERIES) and rows > 0


def test_import_errors_inside_the_operators_are_not_hidden(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "*.pyc"))
    (tmp_path / "repo" / "tessera" / "llm").mkdir()
    (tmp_path / "repo" / "tessera" / "llm" / "queries.py").write_text("import no_such_module\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", env=env, capture_output=True, text=True, timeout=100)
    assert done.returncode and "no_such_module" in done.stderr
