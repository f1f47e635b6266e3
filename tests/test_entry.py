from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from promptlattice.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@needs_data
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, SF).toArrow()
    want = con.sql(catalogue.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    cols = sorted(got.column_names)
    rows = lambda t: sorted(repr([r[c] for c in cols]) for r in t.to_pylist())
    assert rows(got) == rows(want)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 13


def test_every_query_of_the_catalogue_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL) and set(catalogue.QUERIES) <= set(entry.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in ("__spark_entry__.py", "promptlattice"):
        subprocess.run(["cp", "-r", f"{root}/{name}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", f"{tmp_path}/promptlattice/llm"], check=True)
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert got.stdout.split() == [str(len(catalogue.QUERIES))] * 2, got.stderr
