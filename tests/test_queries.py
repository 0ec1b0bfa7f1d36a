"""Every registered query that has SQL against DuckDB on the smallest tables (a third of them; the driver runs all)."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
import zlib

import duckdb
import pytest

import __spark_entry__
from ledgerloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = sorted(n for n in registry.ORACLE_SQL if zlib.crc32(n.encode()) % 3 == 0)


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return connection


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}" if value else "0"
    return str(value)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, db, name):
    found = registry.QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    wanted = db.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in wanted.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(row[names.index(c)]) for c in columns) for row in wanted.fetchall())
    assert sorted(tuple(shown(row[c]) for c in columns) for row in found.collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_training_data_folders(tmp_path):
    """With the subpackage, or the subpackage and the pipeline, deleted the entry module imports and lists the rest."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for gone in (("ledgerloom/llm",), ("ledgerloom/llm", "corpus_pipeline.py")):
        copy = tmp_path / str(len(gone))
        shutil.copytree(os.path.join(here, "ledgerloom"), copy / "ledgerloom", ignore=shutil.ignore_patterns("__pycache__"))
        for name in ("__spark_entry__.py", "corpus_pipeline.py"):
            if os.path.exists(os.path.join(here, name)):
                shutil.copy(os.path.join(here, name), copy / name)
        for name in gone:
            if (copy / name).is_dir():
                shutil.rmtree(copy / name)
            elif (copy / name).exists():
                (copy / name).unlink()
        code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and not any(q.startswith('op') and q[2].isdigit() for q in e.queries()); assert 'pipeline' not in e.queries(); e.oracle_sql()"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
