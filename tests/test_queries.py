"""Every registered query of the library against its SQL, and those without SQL for a stable result."""

import os

import pytest

from quire import plans
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_matches_sql(spark, name):
    same(plans.QUERIES[name](spark, SF), plans.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    df = plans.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_entry_registers_all():
    import __spark_entry__ as e

    assert set(plans.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_training_data_operators(tmp_path):
    """The rest works where the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/quire", tmp_path / "quire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(x.startswith('op') and x[2].isdigit() for x in q); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=False)
    assert done.returncode == 0, done.stderr
