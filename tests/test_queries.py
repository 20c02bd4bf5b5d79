"""Every query outside the llm subpackage: rows at the smallest scale, and the rows of its SQL where it has one."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from colloquy.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(rows):
    return sorted((tuple(("f", repr(v)) if isinstance(v, float) else (type(v).__name__, str(v)) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    d = registry.QUERIES[name](spark, sf)
    columns = sorted(d.columns)
    got = comparable(tuple(r[c] for c in columns) for r in d.collect())
    assert got
    if name in registry.ORACLE_SQL:
        r = con.sql(registry.ORACLE_SQL[name])
        assert sorted(r.columns) == columns
        at = [r.columns.index(c) for c in columns]
        assert comparable(tuple(row[k] for k in at) for row in r.fetchall()) == got


def test_entry_without_the_llm_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/colloquy", tmp_path / "colloquy", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline'] and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
