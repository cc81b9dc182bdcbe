"""Every query with SQL against DuckDB on the smallest tables; the others give rows; and the entry works without the corpus operators."""

import datetime
import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from evgraph import diagram_queries, queries  # noqa: F401  the entry registers the rest

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return float(x) if type(x).__name__ == "Decimal" else x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(spark, con, name):
    got = queries.QUERIES[name](spark, SMALL)
    expected = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got.columns, got.collect()) == rows(expected.columns, expected.fetchall())


def test_every_row_becomes_a_file(spark, con):
    parts, nations = (con.sql(f"SELECT * FROM {t}").fetchall() for t in ("part", "nation"))
    assert queries.QUERIES["npm_packages"](spark, SMALL).count() == len(parts) and len(nations) > 3
    assert queries.QUERIES["workflow_jobs"](spark, SMALL).where("job <> 'first'").count() == len(nations)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "evgraph", tmp_path / "evgraph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries()); assert not [q for q in e.queries() if q.startswith('op') and q[2:3].isdigit() or q == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
