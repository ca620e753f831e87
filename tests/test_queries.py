import subprocess
import sys

import pytest

import __spark_entry__ as driver
from snapforge.plans import snapshots  # noqa: F401
from snapforge.plans.catalog import QUERIES, SQL
from tests.compare import same
from tests.conftest import CHECKED, ROOT


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    same(QUERIES[name](spark, CHECKED), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    assert QUERIES[name](spark, CHECKED).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() == 8
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_without_the_training_data_operators(tmp_path):
    (tmp_path / "snapforge").mkdir()
    code = f"""
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name.startswith("snapforge.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as e
assert len(e.queries()) >= 40 and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
