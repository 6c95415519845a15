"""Every registered query against its oracle SQL on the smallest tables; the others must run."""

import os

import oracle
import pytest

from quoin.plans import catalog, pages  # noqa: F401

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLES:
        assert oracle.differences(df, con, catalog.ORACLES[name]) == []
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_imports_without_a_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= len(catalog.QUERIES)
