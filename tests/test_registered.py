"""Every registered query against its SQL on the smallest tables."""

import os

import harness
import pytest

from tablegrist.plans.reports import load_all

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REPORTS = load_all()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


@pytest.fixture(scope="module")
def con():
    return harness.duck(SF)


@pytest.mark.parametrize("name", list(REPORTS))
def test_report(spark, con, name):
    r = REPORTS[name]
    df = r.run(spark, SF)
    if r.sql is None:
        assert df.columns and df.count() > 0
    else:
        assert harness.differences(df, con, r.sql) == []
