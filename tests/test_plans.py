"""Every plan query against its SQL, and the driver's entry points."""

import glob
import os
import re
import subprocess
import sys

import duckdb
import pytest

from quillstone.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{src}'")
    return con


def plain(rows):
    return sorted(str(tuple(round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == columns
        assert plain(map(tuple, rows)) == plain(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_everything_else_works_without_the_training_package(tmp_path):
    for name in os.listdir(HERE):
        if name not in (".git", "corpus_pipeline.py", "quillstone"):
            (tmp_path / name).symlink_to(os.path.join(HERE, name))
    (tmp_path / "quillstone").mkdir()
    for name in os.listdir(os.path.join(HERE, "quillstone")):
        if name != "llm":
            (tmp_path / "quillstone" / name).symlink_to(os.path.join(HERE, "quillstone", name))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dense_knn' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_nothing_imports_the_training_package():
    for path in glob.glob(f"{HERE}/quillstone/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"^\s*(from|import)\b.*\bllm\b", open(path).read(), re.M), path
