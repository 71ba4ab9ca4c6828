"""Every registered query against its checking SQL, and rules for their plans."""

import os
import re

import pytest
from checking import compare, connect

import __spark_entry__ as driver
from mendframe.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.CHECKS))
def test_query_equals_its_sql(spark, con, name):
    df = driver.queries()[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    if name not in ("sql_subquery",):
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert not re.search(r"BatchEvalPython|ArrowEvalPython|MapInPandas|FlatMapGroupsInPandas", plan)
    assert compare(df, con, driver.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.CHECKS)))
def test_query_without_sql_gives_rows(spark, name):
    assert driver.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert {r["issue_type"] for r in rows} >= {"null", "type_error", "outlier", "duplicate"}


def test_counts_known_for_the_larger_tables(spark):
    larger = "/root/testdata/sf0.01"
    if not os.path.isdir(larger):
        pytest.skip("no larger tables")
    rows = driver.queries()["issue_breakdown"](spark, larger).collect()
    got = {r["issue_type"]: r["n"] for r in rows}
    assert got["type_error"] == 147 and got["constraint"] == 143 and got["duplicate"] == 133
    assert got["fk_violation"] == 72 and got["whitespace"] == 178 and got["inconsistent_category"] == 169
