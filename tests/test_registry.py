"""Every query with an oracle matches DuckDB at sf0.001; entry() smoke."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "scripts"))

SF = "/root/testdata/sf0.001"

import __spark_entry__ as entry  # noqa: E402

ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    from oracle_check import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_oracle_keys_are_queries():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    from oracle_check import canon

    sdf = entry.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    res = duck.execute(ORACLE[name])
    drows = res.fetchall()
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert canon(srows, sdf.columns) == canon(drows, dcols)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_entry_smoke(spark):
    out = entry.entry(spark)
    rows = out.collect()
    assert len(rows) == 4
    assert {"model", "accuracy", "precision", "recall", "f1", "specificity", "auc"} <= set(out.columns)


def test_registry_without_the_optional_folders(tmp_path):
    """A copy without the sub-package keeps every other query, the pipeline's file or not."""
    import shutil
    import subprocess

    skip = shutil.ignore_patterns(".git", "__pycache__", "llm")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=skip)
    assert not (tmp_path / "repo/tabstat/llm").exists() and (tmp_path / "repo/corpus_pipeline.py").exists()
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    from tabstat.plans.registry import ORACLE, QUERIES

    assert out.stdout.split()[-2:] == [str(len(QUERIES)), str(len(ORACLE))]
