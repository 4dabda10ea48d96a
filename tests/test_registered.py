"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from check_oracles import check, connect

SF = "/root/testdata/sf0.001"
NAMES = list(entry_module.queries())

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


def test_names_line_up():
    assert set(entry_module.oracle_sql()) <= set(NAMES)
    plain = {n for n in NAMES if n != "pipeline" and not n.startswith("op")}
    assert plain <= set(entry_module.oracle_sql())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["qid", "n_results"] and df.count() > 0


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, connection, name):
    assert check(spark, connection, name, SF) is None
