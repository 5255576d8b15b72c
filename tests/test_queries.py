"""Every query with an SQL form, against that SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    result, _ = compare(spark, con, name, SF)
    assert result.startswith("ok"), result


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "institute_type"
    assert df.count() > 0
    assert df.filter("difficulty_pct < 0 or difficulty_pct > 100").count() == 0
