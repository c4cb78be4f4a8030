"""Every registered query of the core runs, and equals its SQL where it has one."""

import os

import duckdb
import pytest

from claimweave.plans import registry

DATA = "/root/testdata/sf0.001"
SLOW = {"p1_found", "p2_wide", "p4_paths"}  # covered elsewhere


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def test_entry_imports_without_llm():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_everything_but_llm_works_with_that_subpackage_taken_away(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/claimweave", tmp_path / "claimweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert 'p1_found' in n and 'p3_found' not in n and e.llm_registry is None; print(len(n))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert got.returncode == 0 and int(got.stdout) == len(registry.queries()), got.stderr


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    if name in registry.oracle_sql():
        listed = ", ".join(f'"{c}"' for c in columns)
        want = sorted(tuple(map(str, r)) for r in con.sql(f"select {listed} from ({registry.oracle_sql()[name]})").fetchall())
        assert got == want
