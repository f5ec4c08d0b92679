"""Every query of the catalogue against its SQL."""

import pytest

from cellgrid import queries

from .duck import compare, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, con, name):
    compare(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(queries.queries()) <= set(entry.queries())


def test_the_rest_stands_without_llm(tmp_path):
    """With the subpackage away, and the pipeline's module there or not, the entry point imports and has the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/cellgrid", tmp_path / "cellgrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'agg_count' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
    if os.path.exists(f"{root}/corpus_pipeline.py"):
        shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
