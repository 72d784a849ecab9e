"""The registered queries against their SQL, and the package without its training-data part."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from tidemark import queries

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent


def normal(rows, columns):
    plain = lambda v: None if v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem", "nation"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.RUNS))
def test_query_equals_its_sql(spark, db, name):
    df = queries.RUNS[name](spark, SF)
    cursor = db.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert normal(df.collect(), df.columns) == normal(cursor.fetchall(), columns)


def test_without_the_training_data_part(tmp_path):
    """A copy without the llm folders and the pipeline imports and keeps the engine's queries."""
    code = f"""
import shutil, sys
shutil.copytree({str(REPO)!r}, {str(tmp_path / 'copy')!r}, ignore=lambda d, names: [n for n in names if n in ('llm', 'corpus_pipeline.py', '.git', 'tests', '__pycache__')])
sys.path.insert(0, {str(tmp_path / 'copy')!r})
import __spark_entry__ as e
assert 'flagship' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_no_import_of_the_training_data_part():
    for p in (REPO / "tidemark").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "llm" not in p.read_text(), p
