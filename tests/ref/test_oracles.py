"""Every query that has a SQL form against DuckDB; the others run and have rows."""

import pytest

import oracle
from docweft import plans
from docweft.plans.cases import CASES


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, sf, con, name):
    oracle.compare(spark, con, plans.QUERIES[name], plans.ORACLES[name], sf)


REPLACED = sorted(n for n, (q, _) in CASES.items() if plans.QUERIES[n] is not q)


@pytest.mark.parametrize("name", REPLACED)
def test_written_cases(spark, sf, con, name):
    """Cases whose name a query of a table has taken."""
    oracle.compare(spark, con, *CASES[name], sf)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_has_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_import_needs_no_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
